"""Runs of repeating words, by matching aligned blocks and extending their recurrences.

Words are runs of characters other than ASCII white space. A run is a stretch of consecutive words with smallest period q
(words q apart are identical) and length >= max(12, 2q) that no neighbouring word extends keeping that period.

The documents of a part of an Arrow batch are one sequence of word numbers, parted by numbers that occur once; no run can hold
such a number. For each power of two B, the blocks of B words that start at multiples of B are the keys of an Aho-Corasick
automaton, which is run over the words behind them. In a run of period q and length L, the first L - q words recur q words on,
and any 2B - 1 of them hold an aligned block: B = 2 finds period 6, B = 4 the other periods up to 14, and each larger B those
from 2B - 1 to 4B - 2. Only occurrences at such distances count. Each is extended word by word to both sides; what is long
enough is a run, whose period is the smallest distance that gives this stretch.

Only blocks all of whose words recur at these distances become keys. Blocks inside a run known from a smaller B, whose period
divides all distances at which they can recur, are left out, and so are occurrences that would extend to no more than a known
run. Both leave the result as it is. Automata are made scale by scale, of one part or one long document at a time.

Null texts are empty texts: no words, no runs. Rows keep their doc_id, also a null or repeated one; whole texts are searched,
and no rows give no rows. Other columns don't matter.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, utf8

LEAST = 12
#: Bytes of texts that are one sequence (one text at least).
PART_BYTES = 4 << 20
#: Steps that all occurrences are extended together; the few that go on are compared in growing slices.
STEPS = 32


def scales(longest: int):
    """(block size, smallest and largest distance) that find all runs in documents of up to so many words."""
    yield 2, 6, 6
    yield 4, 1, 14
    size = 8
    while 2 * (2 * size - 1) <= longest:
        yield size, 2 * size - 1, 4 * size - 2
        size *= 2


class Places:
    """Where each word of a sequence occurs."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        order = np.argsort(words, kind="stable")
        self.keys = words[order] * self.n + order

    def any(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether each word occurs at a place from first to last."""
        at = np.searchsorted(self.keys, words * self.n + first)
        return self.keys[np.minimum(at, self.n - 1)] <= words * self.n + np.minimum(last, self.n - 1)


def _any(places: Places, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    inside = first < places.n
    inside[inside] = places.any(words[inside], first[inside], last[inside]) & (np.searchsorted(places.keys, words[inside] * places.n + first[inside]) < places.n)
    return inside


def _blocks(w: np.ndarray, places: Places, size: int, low: int, high: int, runs: np.ndarray) -> np.ndarray:
    """Starts of the aligned blocks that can recur low to high words on and aren't settled by a known run."""
    count = len(w) // size
    inside = runs[(runs[:, 2] <= size) & (runs[:, 1] - runs[:, 0] >= high + size)]
    marks = np.zeros(count + 1, np.int64)
    a, b = -(-inside[:, 0] // size), (inside[:, 1] - high - size) // size + 1
    np.add.at(marks, a[b > a], 1)
    np.add.at(marks, b[b > a], -1)
    p = np.flatnonzero(np.cumsum(marks[:-1]) == 0) * size
    done = 0
    while done < size and len(p):
        more = min(size - done, max(1, done))
        at = p[:, None] + np.arange(done, done + more)
        p = p[_any(places, w[at].ravel(), (at + low).ravel(), (at + high).ravel()).reshape(at.shape).all(axis=1)]
        done += more
    return p


def _windows(w: np.ndarray, p: np.ndarray, size: int, low: int, high: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the recurrences of each block can lie. A block of two periods of a known run recurs in this run at multiples of
    its period only, which can't leave it; what else there is begins in the run's last period or behind it."""
    begin, end = p + low, np.minimum(p + high + size, len(w))
    for s, e, q in runs[(runs[:, 1] - runs[:, 0] >= size) & (2 * runs[:, 2] <= size)].tolist():
        a, b = np.searchsorted(p, (s, e - size + 1))
        begin[a:b] = np.maximum(begin[a:b], e - q + 1)
    return begin, end


def _occurrences(w: np.ndarray, p: np.ndarray, size: int, low: int, high: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, distance) of the recurrences of the blocks that start at p."""
    begin, end = _windows(w, p, size, low, high, runs)
    p, begin, end = (x[begin + size <= end] for x in (p, begin, end))
    if not len(p):
        return p, p
    names: dict[tuple, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    content = np.empty(len(p), np.int64)
    for k, a in enumerate(p.tolist()):
        key = tuple(w[a : a + size].tolist())
        content[k] = names.setdefault(key, len(names))
        if content[k] == len(names) - 1:
            automaton.add_word(key, int(content[k]))
    automaton.make_automaton()
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    last = end[np.concatenate((new[1:] - 1, [len(p) - 1]))]
    which, where = [], []
    for a, b in zip(begin[new].tolist(), last.tolist(), strict=True):
        for stop, name in automaton.iter(tuple(w[a:b].tolist())):
            which.append(name)
            where.append(a + stop - size + 1)
    which, where = np.array(which, np.int64), np.array(where, np.int64)
    order = np.lexsort((p, content))
    starts, keys = p[order], content[order] * len(w) + p[order]
    a = np.searchsorted(keys, which * len(w) + np.maximum(where - high, 0))
    b = np.maximum(a, np.searchsorted(keys, which * len(w) + np.maximum(where - low, -1), "right"))
    each = b - a
    at = np.repeat(a, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return starts[at], np.repeat(where, each) - starts[at]


def _new(p: np.ndarray, d: np.ndarray, size: int, runs: np.ndarray) -> np.ndarray:
    """Which occurrences (in the order of p) are not inside a known run, at a multiple of its period, too far from its length
    to leave it."""
    new = np.ones(len(p), bool)
    for s, e, q in runs[runs[:, 1] - runs[:, 0] >= size + 1].tolist():
        a, b = np.searchsorted(p, (s, e - size + 1))
        own = d[a:b]
        new[a:b] &= ~((own % q == 0) & (p[a:b] + own + size <= e) & (e - s >= own + q))
    return new


def _reach(w: np.ndarray, at: np.ndarray, d: np.ndarray, step: int) -> np.ndarray:
    """How many words from each place on, forwards (step 1) or backwards (-1), equal those d words on. w ends in numbers that
    occur once."""
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for _ in range(STEPS):
        i = at[live] + step * out[live]
        good = (i >= 0) & (i + d[live] < len(w))
        live, i = live[good], i[good]
        live = live[w[i] == w[i + d[live]]]
        out[live] += 1
        if not len(live):
            return out
    for k in live.tolist():
        slice_, gap = 2 * STEPS, int(d[k])
        while True:
            i = int(at[k]) + step * int(out[k])
            m = min(slice_, len(w) - gap - i) if step > 0 else min(slice_, i + 1)
            if m <= 0:
                break
            a = i if step > 0 else i - m + 1
            differ = np.flatnonzero((w[a : a + m] != w[a + gap : a + gap + m])[::step])
            if len(differ):
                out[k] += differ[0]
                break
            out[k] += m
            slice_ = min(2 * slice_, 1 << 16)
    return out


def runs_of(w: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, end, period) of all runs in the numbers w (from 1 on), by start, then period. longest: a bound of the words of
    a stretch without a number that occurs once."""
    w = np.asarray(w, np.int64)
    runs = np.zeros((0, 3), np.int64)
    if len(w) < LEAST:
        return runs
    places = Places(w)
    for size, low, high in scales(longest or len(w)):
        p = _blocks(w, places, size, low, high, runs)
        if not len(p):
            continue
        p, d = _occurrences(w, p, size, low, high, runs)
        order = np.argsort(p, kind="stable")
        p, d = p[order], d[order]
        new = _new(p, d, size, runs)
        order = np.lexsort((p[new], d[new]))
        p, d = p[new][order], d[new][order]
        if not len(p):
            continue
        # Blocks that follow each other and recur at one distance are parts of one stretch: its first and last ones are extended.
        first = np.concatenate(([True], (p[1:] != p[:-1] + size) | (d[1:] != d[:-1])))
        last = np.concatenate((first[1:], [True]))
        a, b, d = p[first], p[last] + size, d[first]
        start, end = a - _reach(w, a - 1, d, -1), b + _reach(w, b, d, 1) + d
        good = (end - start >= LEAST) & (end - start >= 2 * d)
        runs = np.concatenate((runs, np.column_stack((start, end, d))[good]))
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))] if len(runs) else runs
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def search(texts: list[bytes | None]) -> list[tuple[np.ndarray, bytes]]:
    """For each text its runs (start, end, period, in words) and the words that stay, joined by one space: a word goes if any
    run holds it after the run's first period."""
    words = [t.split() if t else [] for t in texts]
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(x) + 1 for x in words], np.int64)
    offsets = np.cumsum(sizes) - sizes
    w = np.empty(int(sizes.sum()), np.int64)
    for x, at in zip(words, offsets.tolist(), strict=True):
        w[at : at + len(x)] = [numbers.setdefault(v, len(numbers) + 1) for v in x]
    w[offsets + sizes - 1] = np.arange(len(texts)) + len(numbers) + 1
    runs = runs_of(w, int(sizes.max(initial=1)) - 1)
    gone = np.zeros(len(w) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    gone = np.cumsum(gone) > 0
    cuts = np.searchsorted(runs[:, 0], np.append(offsets, len(w)))
    out = []
    for k, (x, at) in enumerate(zip(words, offsets.tolist(), strict=True)):
        own = runs[cuts[k] : cuts[k + 1]] - [at, at, 0]
        kept = [v for v, g in zip(x, gone[at : at + len(x)].tolist(), strict=True) if not g] if len(own) else x
        out.append((own, b" ".join(kept)))
    return out


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(documents: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, runs: array of (start, length, period) by start, then period, collapsed: the text's words without those that
    only repeat, joined by one space) for each row of documents."""
    prepare(documents.sparkSession)

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in chunks(texts, part_bytes):
                found = search(texts[a:b])
                rows = np.concatenate([r for r, _ in found])
                ends = np.cumsum([0, *(len(r) for r, _ in found)])
                each = pa.StructArray.from_arrays([pa.array(x) for x in (rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2])], fields=list(RUN))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array([c.decode() for _, c in found], pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """documents with repetitions in a tenth of the texts: if h = crc32(doc_id as text) ends in 0, each word from a on is the
    word a + (i - a) % p of the text, g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8), n being its words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(words, 1, a), unit), 1, n), " ")
    return documents.withColumn("text", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")))


def told(found: DataFrame) -> DataFrame:
    """The digest columns of periodic_runs' rows."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return told(periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
