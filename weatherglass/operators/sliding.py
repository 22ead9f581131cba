"""Medians of sliding time windows in blocks.

A row comes into the window at its time and leaves it a width later. Both are events, and what the window holds at a time is the
sum of all events up to then: of a block of events only how often each value is held when the block begins must be known, which
is a running sum over the blocks before. Within a block all medians are found at once, bit by bit of the values' order: at each
bit the events are parted as in a wavelet matrix, and running sums tell how many of the held values lie in the lower half.

Work is events times the logarithm of a block; a block is given a row for each value that it finds held, so that the sums before
blocks grow with blocks times distinct values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import importable, micros, stored
from .features import numbered

#: Events of a block; those of one time stay together.
BLOCK_ROWS = 65_536


def ranked(values: np.ndarray, signs: np.ndarray, held: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each question the k-th (from 0) of the values that are there after its first `upto` events. Values are whole numbers
    from 0; signs tell whether an event brings or takes one, held how often each is there before."""
    bits = max(int(len(held) - 1).bit_length(), 1)
    before = np.concatenate(([0], np.cumsum(held), np.full((1 << bits) - len(held), held.sum())))
    k, found, low, high = k.copy(), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), upto.copy()
    for bit in range(bits - 1, -1, -1):
        upper = (values >> bit & 1).astype(bool)
        lowers = np.concatenate(([0], np.cumsum(~upper)))
        sums = np.concatenate(([0], np.cumsum(np.where(upper, 0, signs))))
        below = before[found + (1 << bit)] - before[found] + sums[high] - sums[low]
        right = k >= below
        k -= np.where(right, below, 0)
        found += right.astype(np.int64) << bit
        low, high = (np.where(right, lowers[-1] + x - lowers[x], lowers[x]) for x in (low, high))
        values, signs = (np.concatenate((x[~upper], x[upper])) for x in (values, signs))
    return found


def block_medians(events: pa.Table, state: pa.Table, least: int) -> pa.Table:
    """(station_id, ts, value, base, held) of the rows that come in a block and find at least so many values, themselves and
    all of their time included."""
    t, sign, v = (events.column(c).to_numpy() for c in ("t", "sign", "value"))
    order = np.lexsort((sign, t))  # what leaves at a time goes first
    t, sign, v = t[order], sign[order].astype(np.int64), v[order]
    names, at = np.unique(np.concatenate((state.column("there").to_numpy(), v)), return_inverse=True)
    own, n = at[state.num_rows:], state.column("held").to_numpy()
    held = np.zeros(len(names), np.int64)
    np.add.at(held, at[: state.num_rows], n)
    upto = np.searchsorted(t, t, "right")
    size = held.sum() + np.cumsum(sign)[upto - 1]
    asked = np.flatnonzero((sign > 0) & (size >= max(least, 1)))
    upto, size = upto[asked], size[asked]
    a, b = (names[ranked(own, sign, held, upto, k)] for k in ((size - 1) // 2, size // 2))
    base = np.where(a == b, a, 0.5 * a + 0.5 * b)
    rows = events.select(["station_id", "ts", "value"]).take(pa.array(order[asked]))
    return rows.append_column("base", pa.array(base)).append_column("held", pa.array(size))


def medians(rows: DataFrame, width: int, least: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (station_id, ts, value) with base, the median of the station's values in the `width` microseconds up to each row's
    time (all rows of that time included, those exactly a width before not), and their number held, where there are at least so
    many. Rows without a time are each other's window."""
    timed = stored(importable(rows).withColumn("us", micros("ts")))
    known = timed.filter("us IS NOT NULL")
    ends = known.groupBy("station_id").agg(F.max("us").alias("end"))
    come = known.select("station_id", "ts", "value", F.col("us").alias("t"), F.lit(1).alias("sign"))
    leave = known.join(ends, "station_id").filter(F.col("us") + width <= F.col("end")).select("station_id", F.lit(None).cast(rows.schema["ts"].dataType).alias("ts"), "value", (F.col("us") + width).alias("t"), F.lit(-1).alias("sign"))
    events = stored(numbered(come.unionByName(leave), "t", block_rows, ties=True).withColumn("block", F.floor((F.col("place") - 1) / block_rows)).drop("place"))
    last = events.groupBy("station_id").agg(F.max("block").alias("last"))
    value = Window.partitionBy("station_id", "value").orderBy("block")
    net = events.groupBy("station_id", "block", "value").agg(F.sum("sign").alias("n"))
    sums = net.withColumns({"held": F.sum("n").over(value.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("block").over(value)})
    until = F.coalesce("next", "last")
    state = sums.join(last, "station_id").filter((F.col("held") > 0) & (F.col("block") < until)).select(F.col("station_id").alias("name"), F.explode(F.sequence(F.col("block") + 1, until)).alias("begun"), F.col("value").alias("there"), "held")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = events.groupBy("station_id", "block").cogroup(state.groupBy("name", "begun")).applyInArrow(lambda a, b: block_medians(a, b, least), f"station_id string, ts {kinds['ts']}, value double, base double, held long")
    loose = timed.filter("us IS NULL")
    own = loose.groupBy("station_id").agg(F.expr("percentile(value, 0.5D)").alias("base"), F.count("value").alias("held")).filter(F.col("held") >= least)
    return found.unionByName(loose.join(own, "station_id").select("station_id", "ts", "value", "base", "held"))
