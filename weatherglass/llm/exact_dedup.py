"""Exact de-duplication in two passes with a Bloom filter: only rows whose text may repeat are shuffled.

Texts are equal when they are identical after deleting ASCII white space (\\x20, \\x09-\\x0D); a text's key is the SHA-256 of
what is left. Pass one sets k bits a key in a filter that tells bits set once from bits set more often. Each task makes its own
part of the filter, the parts are merged segment by segment (twice is what is twice in one of them, or in both once), and only
the bits set twice reach the driver and the tasks. Pass two asks for each row whether all its bits are set twice. If one is
not, the text is the only one of its kind and the row passes straight through, without any exchange. The others are grouped by
key, so that false alarms of the filter cost a little shuffle and change nothing.

The filter has 12 bits a row or more up to FILTER_BYTES; beyond that many rows it lets more unique rows through to the
grouping, and the result stays the same. Of equal texts, the row with the most code points in the original text stays, then
that with the smallest doc_id; a null id comes last. Of rows that are equal in all this, one stays. Groups are counted before
their exchange; a group of more than a hundred-thousandth of all rows (and over HOT_ROWS) gets its result by a broadcast of at
most 100,000 such groups, so that no key brings many rows into a task.

Null texts are empty texts, and equal to those of white space only. No rows give no rows. Other columns are carried along
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, prepare

#: The bytes that are deleted before texts are compared.
WHITE = " \t\n\x0b\x0c\r"
#: Most bytes of the filter, which driver and Python workers hold.
FILTER_BYTES = 64 << 20
BITS_PER_ROW, MOST_HASHES = 12, 4
#: Bits of a segment of the filter: the unit in which it is compressed and merged.
SEGMENT = 1 << 20
#: Rows of a task whose bits are sent together, and groups in which the tasks' parts are merged first.
PENDING, FAN = 1 << 20, 64
#: Rows of one text from which it can count as hot, and how many texts can be hot at most.
HOT_ROWS, HOT_GROUPS = 1000, 100_000


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def key() -> Column:
    """The 32 bytes that stand for a normalised text."""
    return F.unhex(F.sha2(normalised(_text()), 256))


class Filter:
    """Positions of keys in a filter of 2^log bits, and which of its bits more than one key or row has set."""

    def __init__(self, rows: int, most_bytes: int = FILTER_BYTES):
        want = max(SEGMENT, rows * BITS_PER_ROW)
        self.bits = max(SEGMENT, min(1 << (want - 1).bit_length(), 1 << ((8 * most_bytes).bit_length() - 1)))
        self.hashes = max(1, min(MOST_HASHES, round(0.69 * self.bits / max(rows, 1))))
        self.twice = np.zeros(self.bits // 8, np.uint8)

    def positions(self, keys: list[bytes]) -> np.ndarray:
        """One row a key, one column a hash: sums of two halves of the key."""
        words = np.frombuffer(b"".join(keys), "<u8").reshape(len(keys), -1)
        step = words[:, 1] | np.uint64(1)
        with np.errstate(over="ignore"):
            return np.column_stack([(words[:, 0] + np.uint64(i) * step) & np.uint64(self.bits - 1) for i in range(self.hashes)]).astype(np.int64)

    def again(self, keys: list[bytes]) -> np.ndarray:
        """Whether each key may belong to more than one row; false is certain."""
        at = self.positions(keys)
        return ((self.twice[at >> 3] >> (at & 7)) & 1).all(axis=1)


def _zipped(positions: np.ndarray) -> bytes:
    flags = np.zeros(SEGMENT, bool)
    flags[positions] = True
    return zlib.compress(np.packbits(flags, bitorder="little"), 1)


def _parts(positions: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's bits as (segment, part, once, twice)."""
    found, counts = np.unique(positions, return_counts=True)
    segments = np.unique(found // SEGMENT)
    rows = []
    for s in segments.tolist():
        a, b = np.searchsorted(found, (s * SEGMENT, (s + 1) * SEGMENT))
        own = found[a:b] - s * SEGMENT
        rows.append((s, _zipped(own), _zipped(own[counts[a:b] > 1])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "part", "once", "twice"])


SCHEMA = "segment int, part int, once binary, twice binary"


def _merged(key, table):
    once, twice = (np.zeros(SEGMENT // 8, np.uint8) for _ in range(2))
    for a, b in zip(table.column("once"), table.column("twice"), strict=True):
        a, b = (np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8) for x in (a, b))
        twice |= b | (once & a)
        once |= a
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "once": pa.array([zlib.compress(once, 1)], pa.binary()), "twice": pa.array([zlib.compress(twice, 1)], pa.binary())})


def fitted(keys: DataFrame, rows: int, most_bytes: int = FILTER_BYTES) -> Filter:
    """The filter of all keys, a DataFrame of one binary column."""
    empty = Filter(rows, most_bytes)

    def run(batches):
        part, held, n = TaskContext.get().partitionId() % FAN, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(empty.positions(batch.column(0).to_pylist()).ravel())
                n += batch.num_rows
            if n >= PENDING:
                yield _parts(np.concatenate(held), part)
                held, n = [], 0
        if held:
            yield _parts(np.concatenate(held), part)

    parts = keys.mapInArrow(run, SCHEMA)
    for by in (("segment", "part"), ("segment",)):
        parts = parts.groupBy(*by).applyInArrow(_merged, SCHEMA)
    out = Filter(rows, most_bytes)
    for r in parts.select("segment", "twice").toLocalIterator():
        out.twice[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def _again(spark, found: Filter, column: str) -> Column:
    known = spark.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def again(keys: pa.Array) -> pa.Array:
        return pa.array(known.value.again(keys.to_pylist()))

    return again(F.col(column))


#: The order of rows with equal texts: the first stays.
def _first(chars: str, doc_id: str, row: str) -> Column:
    return F.min(F.struct((-F.col(chars)).alias("chars"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row")))


def exact_duplicates(documents: DataFrame, *, most_bytes: int = FILTER_BYTES, hot_rows: int = HOT_ROWS, counted: dict | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of documents. counted, if given, gets the numbers of all
    rows and of those that pass two sends on."""
    spark = prepare(documents.sparkSession)
    chars = F.char_length(_text()).cast("long")
    thin = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), chars.alias("chars"), key().alias("key"), F.monotonically_increasing_id().alias("row")))
    n = thin.count()
    marked = thin.withColumn("again", _again(spark, fitted(thin.select("key"), n, most_bytes), "key"))
    rest = cut(marked.filter("again").drop("again"))
    if counted is not None:
        counted |= {"rows": n, "sent": rest.count()}
    alone = marked.filter(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "key")
    groups = cut(rest.groupBy("key").agg(F.count("*").alias("group_size"), _first("chars", "doc_id", "row").alias("first")))
    groups = groups.select("key", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("first"))
    crowd = max(hot_rows, n // HOT_GROUPS)
    hot = F.broadcast(groups.filter(F.col("group_size") > crowd))
    found = rest.join(hot, "key").unionByName(rest.join(hot.select("key"), "key", "left_anti").join(groups.filter(F.col("group_size") <= crowd), "key"))
    told = found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "key")
    return alone.unionByName(told).withColumn("text_sha256", F.lower(F.hex("key"))).drop("key")


def deduplicated(documents: DataFrame, *, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of documents that stay, all columns as they are. Rows whose text can't repeat are not shuffled; the others are
    written to the shared folder, and only their keys and numbers are grouped."""
    spark = prepare(documents.sparkSession)
    names = fresh(documents, "key", "chars", "row", "again", "id")
    k, chars, row, again, doc_id = names
    rows = documents.withColumns({k: key(), chars: F.char_length(_text()), doc_id: F.col("doc_id").cast("long")})
    keys = cut(rows.select(F.col(k).alias("key")))
    marked = rows.withColumn(again, _again(spark, fitted(keys, keys.count(), most_bytes), k))
    rest = cut(marked.filter(F.col(again)).withColumn(row, F.monotonically_increasing_id()))
    first = rest.groupBy(k).agg(_first(chars, doc_id, row).alias("first")).select(F.col("first.row").alias(row))
    stay = rest.join(first, row, "left_semi")
    return marked.filter(~F.col(again)).select(*documents.columns).unionByName(stay.select(*documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS key FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY key) AS group_size, row_number() OVER w = 1 AS kept, key AS text_sha256
FROM keyed WINDOW w AS (PARTITION BY key ORDER BY chars DESC, doc_id NULLS LAST)
"""
