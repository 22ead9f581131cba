"""SimHash near-duplicates by anchor-point covering.

Fingerprints: A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles are three words joined by
a space (repeats included; fewer words: the whole sequence), each hashed by XXH64 with seed 42. A bit is 1 if it is set in
over half the hashes; no words give fingerprint zero, which links like any other.

Links (2 or fewer differing bits): the anchors are the words of a covering code, the product of two perfect binary Golay
codes over bits 0-22 and 23-45 (covering radius 3 each, 2^24 anchors). Each fingerprint has its home anchor within the
covering radius, and is replicated to every anchor within the radius plus the threshold: if two fingerprints differ in
d1 + d2 <= 2 bits of the two halves, the second lies within 3 + d1 and 3 + d2 of the first one's home. Per anchor, home
fingerprints are compared with all that were sent there. An anchor with many members (a large group of near copies) is not
compared pair by pair: two fingerprints link there if and only if one word is within one bit of both, so that its members
are grouped by the 65 words around each, which is linear. Each task emits a spanning forest of its links, not the pairs.
An anchor with more members than a task should hold (MEMBERS) passes them on as they come: they are grouped by those words in
one more exchange, where no group can have more than 65 distinct fingerprints.

Equal fingerprints count once in all this. Null texts are empty texts. Rows are kept, also repeated ones; a null doc_id
stays null and takes part with the others, but never names a component unless all of it is null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, utf8
from .components import components

SEED, SHINGLE, THRESHOLD = 42, 3, 2

#: Members from which an anchor's fingerprints are linked through their one-bit neighbourhoods.
CROWDED = 48

#: Members of an anchor that a task holds at once; beyond them they are linked in an exchange of their own.
MEMBERS = 1 << 21
#: Rows that a task collects before it compares the anchors that are whole.
ROWS = 1 << 18

#: The Golay code's generator, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else ()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=False)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, *carried: Column) -> DataFrame:
    """(doc_id, fp) and the carried columns for each row of documents, fp being the fingerprint's 64 bits as a signed long."""
    prepare(documents.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields[2:])]))


class Golay:
    """The (23, 12) code: syndromes by table, and the error patterns of weight up to 5 by syndrome and weight."""

    def __init__(self):
        def remainder(v: int) -> int:
            for bit in range(22, 10, -1):
                if v >> bit & 1:
                    v ^= GENERATOR << (bit - 11)
            return v

        self.high = np.array([remainder(i << 11) for i in range(1 << 12)], np.int64)
        patterns = np.array([sum(1 << b for b in c) for w in range(6) for c in combinations(range(23), w)], np.int64)
        weight = np.maximum(np.bitwise_count(patterns).astype(np.int64), 3)  # up to the covering radius: one a syndrome
        syndrome = self.syndrome(patterns)
        self.by = []
        for w in (3, 4, 5):
            own = patterns[weight == w]
            order = np.argsort(syndrome[weight == w], kind="stable")
            counts = np.bincount(syndrome[weight == w], minlength=1 << 11)
            self.by.append((own[order], counts, np.cumsum(counts) - counts))

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return (v & 0x7FF) ^ self.high[v >> 11]

    def home(self, v: np.ndarray) -> np.ndarray:
        """The number of the code word within distance 3."""
        patterns, _, starts = self.by[0]
        return (v ^ patterns[starts[self.syndrome(v)]]) >> 11

    def around(self, v: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into v, number of a code word) for all code words at a distance: up to 3, 4 or 5."""
        patterns, counts, starts = self.by[weight - 3]
        s = self.syndrome(v)
        many = counts[s]
        row = np.repeat(np.arange(len(v)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[s], many)
        return row, (v[row] ^ patterns[k]) >> 11


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fps & 0x7FFFFF, (fps >> 23) & 0x7FFFFF


def home_anchor(fps: np.ndarray) -> np.ndarray:
    low, high = halves(fps)
    return (golay().home(low) << 12) | golay().home(high)


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, anchor) for all anchors within the covering radius plus the threshold."""
    code, (low, high) = golay(), halves(fps)
    rows, anchors = [], []
    for a, b in ((3, 3), (3, 4), (3, 5), (4, 3), (5, 3), (4, 4)):
        row, one = code.around(low, a)
        again, other = code.around(high[row], b)
        rows.append(row[again])
        anchors.append((one[again] << 12) | other)
    return np.concatenate(rows), np.concatenate(anchors)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


#: A word and the 64 words at one bit from it.
SPHERE = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))


def sphere_links(index: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all members at 2 or fewer bits: neighbours in the order of a common word within one bit."""
    out_a, out_b = [], []
    parts = max(1, -(-len(words) * len(SPHERE) // (1 << 22)))
    for part in range(parts):  # bounds the memory: one share of the common words at a time
        keys, owners = [], []
        for k in range(0, len(words), 1 << 16):
            z = (words[k : k + (1 << 16), None] ^ SPHERE).ravel()
            own = np.repeat(index[k : k + (1 << 16)], len(SPHERE))
            if parts > 1:
                mine = (z * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part
                z, own = z[mine], own[mine]
            keys.append(z)
            owners.append(own)
        z, own = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(z, kind="stable")
        z, own = z[order], own[order]
        same = z[1:] == z[:-1]
        out_a.append(own[:-1][same])
        out_b.append(own[1:][same])
    return np.concatenate(out_a), np.concatenate(out_b)


def compare(anchors: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root) over whole anchors, sorted by anchor: a spanning forest of the links between distinct fingerprints."""
    if not len(anchors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(anchors)])))
    wide = np.repeat(sizes > 1, sizes)
    anchors, fps = anchors[wide], fps[wide]
    sizes = sizes[sizes > 1]
    if not len(sizes):
        return fps, fps
    starts = np.cumsum(sizes) - sizes
    home = home_anchor(fps) == anchors
    homes = np.add.reduceat(home.astype(np.int64), starts)
    nodes, number = np.unique(fps, return_inverse=True)
    words = fps.view(np.uint64)
    a, b = [], []
    few = (sizes <= CROWDED) & (homes > 0)
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(home & few[group])
    for k in range(0, len(at), 1 << 16):
        own = at[k : k + (1 << 16)]
        many = sizes[group[own]]
        x = np.repeat(own, many)
        y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[group[own]], many)
        near = np.flatnonzero(np.bitwise_count(words[x] ^ words[y]) <= THRESHOLD)
        a.append(number[x[near]])
        b.append(number[y[near]])
    for g in np.flatnonzero((sizes > CROWDED) & (homes > 0)).tolist():
        part = slice(starts[g], starts[g] + sizes[g])
        x, y = sphere_links(number[part], words[part])
        a.append(x)
        b.append(y)
    if not a:
        return nodes[:0], nodes[:0]
    label = forest(len(nodes), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def sphere_edges(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between fingerprints (fp: long, no repeats) at 2 or fewer bits: each with the least of those that share a
    word within one bit, of which there are 65 at most."""
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    words = fps.select(F.explode(around).alias("word"), "fp")
    return words.withColumn("u", F.min("fp").over(Window.partitionBy("word"))).filter("u != fp").select("u", F.col("fp").alias("v")).distinct()


def links(distinct: DataFrame, *, members: int = MEMBERS, rows: int = ROWS) -> DataFrame:
    """Edges (u, v) between the fingerprints of distinct (fp: long, no repeats) whose components are those of all links."""

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k in range(0, len(fps), 1 << 13):
                at, anchors = replicas(fps[k : k + (1 << 13)])
                yield pa.RecordBatch.from_arrays([pa.array(anchors.astype(np.int32)), pa.array(fps[k : k + (1 << 13)][at])], names=["anchor", "fp"])

    def emit(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def per_anchor(batches):
        """Edges, and the members of an anchor that has too many with no v."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, passing = 0, None  # the rows held; the anchor whose members are passed on
        for batch in batches:
            anchors, fps = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            if passing is not None:
                end = int(np.searchsorted(anchors, passing, side="right"))
                if end:
                    yield emit(fps[:end], [None] * end)
                anchors, fps = anchors[end:], fps[end:]
                if not len(anchors):
                    continue
                passing = None
            held.append((anchors, fps))
            count += len(anchors)
            if count < rows:
                continue
            anchors, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on in the next batch
            if last:
                yield emit(*compare(anchors[:last], fps[:last]))
            held, count = [(anchors[last:], fps[last:])], 0
            if len(anchors) - last > members:
                passing, held = anchors[-1], []
                yield emit(fps[last:], [None] * (len(fps) - last))
        if held:
            yield emit(*compare(*(np.concatenate(x) for x in zip(*held, strict=True))))

    replicated = distinct.mapInArrow(spread, "anchor int, fp long")
    found = cut(replicated.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(per_anchor, "u long, v long"))
    crowd = found.filter("v IS NULL").select(F.col("u").alias("fp")).distinct()
    return found.filter("v IS NOT NULL").unionByName(sphere_edges(crowd))


def rooted(rows: DataFrame, least: Column) -> DataFrame:
    """(fp, root, least) for each distinct fp of rows: root names its component, least is an aggregate of its rows."""
    first = rows.groupBy("fp").agg(least.alias("least"))
    roots = components(links(first.select("fp"))).withColumnRenamed("node", "fp")
    return first.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents, which needs doc_id and text."""
    rows = cut(fingerprints(documents))
    placed = rooted(rows, F.min("doc_id"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
