"""Sharding by histogram sort: near-equal bytes per shard, in the order of (text hash, doc_id), with DataFrame operations only.

Rows are ordered by (XXH64 of the text, doc_id), so that equal texts are neighbours. The splitters between shards are found
by counting: each round sums the exact bytes between candidate boundaries inside the ranges that still hold a splitter
(4096 a range, by the next 12 bits of the key), until a range is within TOLERANCE of a shard's bytes or holds one text.
The splitter then goes to the range's nearer edge. A group of equal texts stays in one shard unless it is larger than
GROUP_SHARE of a shard (else one side of the splitter would miss its size by more than that); a larger one is cut inside by
doc_id in the same way, and rows of it that share a doc_id as well by a number that each row has got. Only counts per candidate
reach the driver, at most 4096 for each splitter. The rows are then exchanged once, by shard.

The law is `bytes`: sizes (UTF-8 bytes of the text plus 16; null: 16) are near equal. slot numbers the rows of a shard from
0 in key order. Null texts are a group of their own; a null doc_id counts as the smallest; repeated rows are kept, each with
a slot, and may lie in several shards; an empty table gives no rows. A single row larger than a shard stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, ROW_BYTES = 40, 16
STEP = 12
TOLERANCE, GROUP_SHARE = 0.001, 0.125
#: Rows that one task numbers; shards with more are numbered in several parts.
PART_ROWS = 20_000_000
LEAST = -(1 << 63)


def keyed(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"),
        F.monotonically_increasing_id().alias("r"),
        *carry,
    )


def _nearer(target: int, low: tuple[int, int], high: tuple[int, int]) -> int:
    """Each of low and high: bytes below it and the key."""
    return low[1] if target - low[0] <= high[0] - target else high[1]


def _search(rows: DataFrame, by: list[str], column: str, goals: dict, start: int, share: float, whole: bool) -> tuple[dict, dict]:
    """goals: number of a splitter -> (group values, target in bytes from the group's begin). Boundaries of column for each,
    and, if whole, the single values that are too large for one shard: number -> (value, bytes below it)."""
    found, inside = {}, {}
    active = {i: (group, target, None, 0) for i, (group, target) in goals.items()}
    shift, before = max(0, start - STEP), start
    while active:
        bucket = F.shiftright(column, shift)
        some = rows
        if before < 64 or by:
            held = {(g, p) for g, _, p, _ in active.values()}
            keep = F.lit(False)
            if by:
                for g, p in sorted(held, key=str):
                    keep = keep | ((F.col(by[0]) == g) & (F.lit(True) if p is None else F.shiftright(column, before) == p))
            else:
                keep = F.shiftright(column, before).isin([p for _, p in held]) if all(p is not None for _, p in held) else F.lit(True)
            some = rows.filter(keep)
        counted: dict = {}
        for r in some.groupBy(*by, bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.min(column).alias("low"), F.max(column).alias("high")).collect():
            counted.setdefault(r[by[0]] if by else None, []).append((r["bucket"], r["bytes"], r["low"], r["high"]))
        for x in counted.values():
            x.sort()
        after = {}
        for i, (group, target, prefix, base) in active.items():
            below, last = base, None
            for b, size, low, high in counted.get(group, []):
                if prefix is not None and b >> (before - shift) != prefix:
                    continue
                last = (b, size, low, high, below)
                if below + size >= target:
                    break
                below += size
            if last is None:
                found[i] = 1 << 63
                continue
            b, size, low, high, below = last
            if low == high and whole and size > GROUP_SHARE * share:
                inside[i] = (low, below)
            elif low == high or size <= TOLERANCE * share or shift == 0:
                found[i] = _nearer(target, (below, low), (below + size, high + 1))
            else:
                after[i] = (group, target, b, below)
        active, before, shift = after, shift, max(0, shift - STEP)
    return found, inside


def _widest(rows: DataFrame, by: str, column: str) -> int:
    """The bits that tell the column's values apart inside the groups."""
    ranges = rows.groupBy(by).agg(F.min(column).alias("low"), F.max(column).alias("high")).collect()  # a row a group that holds a splitter
    return max((r["high"] ^ r["low"] if (r["high"] < 0) == (r["low"] < 0) else (1 << 64) - 1).bit_length() for r in ranges)


def splitters(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """The parts - 1 keys (h, k, r) at which a new part begins, in order."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / parts
    goals = {i: (None, total * i // parts) for i in range(1, parts)}
    if not total:
        return []
    found, texts = _search(rows, [], "h", goals, 64, share, True)
    keys = [(h, LEAST, LEAST) for h in found.values()]
    if texts:
        hot = rows.filter(F.col("h").isin(sorted({h for h, _ in texts.values()})))
        inner = {i: (h, goals[i][1] - below) for i, (h, below) in texts.items()}
        within, ids = _search(hot, ["h"], "k", inner, _widest(hot, "h", "k"), share, True)
        keys += [(texts[i][0], k, LEAST) for i, k in within.items()]
        if ids:  # one text and one id: rows by their numbers
            pairs = {i: f"{texts[i][0]}|{k}" for i, (k, _) in ids.items()}
            same = hot.withColumn("hk", F.concat_ws("|", F.col("h").cast("string"), F.col("k").cast("string"))).filter(F.col("hk").isin(sorted(set(pairs.values()))))
            last, _ = _search(same, ["hk"], "r", {i: (pairs[i], inner[i][1] - below) for i, (_, below) in ids.items()}, _widest(same, "hk", "r"), share, False)
            keys += [(texts[i][0], ids[i][0], r) for i, r in last.items()]
    return sorted(keys)


def _at_least(key: tuple[int, int, int]):
    h, k, r = key
    if h >= 1 << 63:
        return F.lit(0)
    above = F.col("h") > F.lit(h)
    if k < 1 << 63:
        later = F.col("k") > F.lit(k)
        if r < 1 << 63:
            later = later | ((F.col("k") == F.lit(k)) & (F.col("r") >= F.lit(r)))
        above = above | ((F.col("h") == F.lit(h)) & later)
    return above.cast("int")


def _count(keys: list[tuple[int, int, int]]):
    out = F.lit(0)
    for key in keys:
        out = out + _at_least(key)
    return out


def shard(documents: DataFrame, *, shards: int = SHARDS, carry: tuple[str, ...] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of documents (doc_id, text), and the columns
    named in carry."""
    rows = cut(keyed(documents, carry))
    each = max(1, -(-rows.count() // (shards * part_rows)))
    keys = splitters(rows, shards * each)
    placed = rows.withColumn("part", _count(keys)).withColumn("shard", F.floor(F.col("part") / each).cast("int"))
    order = Window.partitionBy("shard", "part").orderBy("h", "k", "r")
    slots = placed.withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
    if each > 1:
        # At most shards * each rows, each a constant number of bytes.
        counts = rows.withColumn("part", _count(keys)).groupBy("part").agg(F.count("*").alias("n"))
        whole = Window.partitionBy(F.floor(F.col("part") / each)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("offset"))
        slots = slots.join(F.broadcast(offsets), "part").withColumn("slot", F.col("slot") + F.col("offset"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *carry)


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
