"""Benchmark decontamination: an FM-index per training shard, searched for the windows of benchmark items.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is 13 consecutive words of an item;
an item of fewer words, but not none, is one window. Each Arrow batch of documents is a training shard. Its words become
symbols: a word of the benchmark has its number, any other word is a break. Runs between breaks that are at least as long
as the shortest window (no other run can hold one) are the text of the shard's index. Windows are found by backward
search through the wavelet matrix, occurrences are located by sampled suffix positions, and their spans are merged.

The benchmark's windows go to the tasks in blocks of about BLOCK_BYTES of text, one after the other: each is a pass of its own
over the documents that keeps only the rows with occurrences, and its windows are freed before the next one. So neither the
driver nor a worker ever holds more than one block (about 90 bytes for each of its bytes).

Null and empty texts have no words and are never contaminated. Null items have no windows; a null item_id
counts as an empty one. Repeated rows are kept and
each gets its own result. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, cut, prepare, scalar, utf8
from .fm_index import FMIndex

WINDOW = 13
BLOCK_BYTES = 2 << 20
#: 20 * hit words >= words: the share of hit words from which a document counts as contaminated.
SHARE = 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Windows:
    """The windows of some benchmark items as symbols, with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        held: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                held.setdefault(tuple(ids[i : i + size]), set()).add(number[name])
        self.lengths = np.array([len(w) for w in held], np.int64)
        self.patterns = np.array([(0,) * (size - len(w)) + w for w in held], np.int32).reshape(len(held), size)
        self.item_counts = np.array([len(x) for x in held.values()], np.int64)
        self.items = np.array([i for x in held.values() for i in sorted(x)], np.int64)
        self.item_starts = np.cumsum(self.item_counts) - self.item_counts

    def find(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Words, merged hit spans and items of each text of a shard."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        spans: list = [[] for _ in texts]
        items: list = [[] for _ in texts]
        if not len(self.lengths) or not sizes.sum():
            return sizes.tolist(), spans, items
        get = self.symbols.get
        coded = np.fromiter(chain.from_iterable(chain(map(get, w, repeat(0)), (0,)) for w in words), np.int32, int(sizes.sum()) + len(texts))
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        # Runs of benchmark words; each ends at a break, since every text is followed by one.
        inside = coded != 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= self.lengths.min()
        begin, end = begin[long], end[long]
        if not len(begin):
            return sizes.tolist(), spans, items
        lengths = end - begin + 1
        offsets = np.cumsum(lengths) - lengths
        source = np.arange(lengths.sum()) - np.repeat(offsets - begin, lengths)
        index = FMIndex(coded[source], len(self.symbols))
        low, high = index.search(self.patterns, self.lengths)
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        if not len(which):
            return sizes.tolist(), spans, items
        rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        at = source[index.locate(rows)]
        cover = np.zeros(len(coded) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.lengths[which], -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0]))))
        owner = np.searchsorted(starts, edges[::2], side="right") - 1
        for d, a, b in zip(owner.tolist(), (edges[::2] - starts[owner]).tolist(), (edges[1::2] - starts[owner]).tolist(), strict=True):
            spans[d].append((a, b))
        pairs = np.unique((np.searchsorted(starts, at, side="right") - 1) * len(counts) + which)
        document, window = pairs // len(counts), pairs % len(counts)
        many = self.item_counts[window]
        item = self.items[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.item_starts[window], many)]
        pairs = np.unique(np.repeat(document, many) * len(self.names) + item)
        for d, i in zip((pairs // len(self.names)).tolist(), (pairs % len(self.names)).tolist(), strict=True):
            items[d].append(self.names[i])
        return sizes.tolist(), spans, items


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The windows of benchmark (item_id, text) as one broadcast after the other, each of about block_bytes of text, and whether
    it is the only one. A broadcast is freed when the next one is asked for."""
    spark = prepare(benchmark.sparkSession)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-int(scalar(bench, "coalesce(sum(octet_length(text)), 0)")) // block_bytes))
    for block in range(blocks):
        part = bench.filter(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {block}")) if blocks > 1 else bench
        held = spark.sparkContext.broadcast(Windows([("" if r[0] is None else r[0], r[1].encode()) for r in part.collect()]))
        yield held, blocks == 1
        if blocks > 1:
            held.unpersist()


def hits(windows: Windows, texts: list[bytes | None]):
    """(words, merged spans, items) of each text."""
    for a, b in chunks(texts):
        yield from zip(*windows.find(texts[a:b]), strict=True)


SPANS = "array<struct<first: long, end: long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def found(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of documents (with text) and n_words, spans and items of each row."""
    added = f"n_words long, spans {SPANS}, items array<string>"

    def searched(rows: DataFrame, held) -> DataFrame:
        names = [*rows.columns, "n_words", "spans", "items"]

        def run(batches):
            for batch in batches:
                out = list(hits(held.value, utf8(batch.column(names.index("text")))))
                columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([[{"first": x, "end": y} for x, y in r[1]] for r in out], _SPANS), pa.array([r[2] for r in out], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

        return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(added).fields]))

    rows, parts, counts = None, None, None
    for held, only in blocks_of(benchmark, block_bytes):
        if only:
            return searched(documents, held)
        if rows is None:  # a number for each row that stays the same in all passes
            rows = cut(documents.withColumn("row_", F.monotonically_increasing_id()))
        part = cut(searched(rows.select("row_", "text"), held).select("row_", "n_words", "spans", "items").filter("n_words > 0" if counts is None else "size(spans) > 0"))
        counts = part.select("row_", "n_words") if counts is None else counts
        some = part.filter("size(spans) > 0").select("row_", "spans", "items")
        parts = some if parts is None else parts.unionByName(some)
    fold = """aggregate(array_sort(spans), cast(array() as array<struct<first: bigint, end: bigint>>), (a, x) ->
        if(size(a) > 0 and x.first <= element_at(a, -1).end, concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"""
    merged = parts.groupBy("row_").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("spans", F.expr(fold))
    out = rows.join(counts, "row_", "left").join(merged, "row_", "left").drop("row_")
    return out.withColumns({"n_words": F.coalesce("n_words", F.lit(0)), "spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))})


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])


def contaminated(words: Column, hit: Column) -> Column:
    return (hit > 0) & (SHARE * hit >= words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, hit words, items with occurring windows, merged spans (in words) and whether it is
    contaminated. documents needs doc_id and text, benchmark item_id and text."""
    rows = found(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, block_bytes)
    told = rows.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans")
    return told.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"), "items", "spans")


def kept(documents: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents, with all their columns, that are not contaminated."""
    taken = [f"in_{k}" for k in range(len(documents.columns))]  # own names, whatever those of the documents are
    named = documents.toDF(*["text" if c == "text" else t for c, t in zip(documents.columns, taken, strict=True)])
    rows = found(named, benchmark, block_bytes).filter(~contaminated(F.col("n_words"), hit_words()))
    return rows.select(*[F.col("text" if c == "text" else t).alias(c) for c, t in zip(documents.columns, taken, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
