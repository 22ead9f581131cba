"""The greedy throttle in blocks: a row whenever so much data time has gone by since the last pick, or time has gone back
behind it.

The rule is sequential: which rows of a block are picked depends on the last pick before it. But a block needs one number of
what lies before, the time of that pick, and answers with one number, the time of its own last pick. Blocks of a station are
therefore summarised on their own (a step function from the one to the other), one walk over a row a block finds what each
block begins with, and the blocks then pick on their own again. No task holds a station, or passes all of its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import importable, micros
from .features import dealt, numbered
from .history import whole_groups

#: Rows of a block: a summary has at most one entry for each row of the block that is less than a step after its beginning.
BLOCK_ROWS = 65_536
#: No pick.
NONE = np.iinfo(np.int64).min


def next_picks(us: np.ndarray, step: int) -> np.ndarray:
    """For each row the row that is picked next if it is one: the first later one at least step after or before it in time;
    the number of rows if there is none. Stretches of doubling length are stepped over for all rows at once, by their least
    and greatest times, so that the work is rows times log rows in whatever order times come."""
    n = len(us)
    least, most = [us], [us]
    while 2 << len(least) - 1 <= n:
        half = 1 << len(least) - 1
        a, b = least[-1], most[-1]
        least.append(np.minimum(a[:-half], a[half:]))
        most.append(np.maximum(b[:-half], b[half:]))
    at = np.arange(1, n + 1)
    for level in range(len(least) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << level) <= n)
        start = at[fits]
        still = (least[level][start] >= us[fits]) & (most[level][start] < us[fits] + step)
        at[fits[still]] += 1 << level
    return at


def last_picks(us: np.ndarray, step: int) -> np.ndarray:
    """For each row the last one that is picked if it is one: next picks, doubled until they stand still."""
    after = next_picks(us, step)
    jump = np.where(after < len(us), after, np.arange(len(us)))
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return jump


def first_pick(low: np.ndarray, high: np.ndarray, last, step: int) -> np.ndarray:
    """The first row that is picked after a pick at the time last (an array); low, high: least and greatest time up to each
    row."""
    return np.minimum(np.searchsorted(high, np.asarray(last) + step, "left"), np.searchsorted(-low, -np.asarray(last), "right"))


def summary(us: np.ndarray, before: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, exits): if the last pick before the block was at a time above ends[k - 1] and up to ends[k], the last one after it
    is at exits[k]; NONE where the block has no pick. before: the time of the row before the block, which lies less than a step
    after the last pick, and not before it."""
    low, high = np.minimum.accumulate(us), np.maximum.accumulate(us)
    ends = np.unique(np.concatenate((high[(high > before) & (high <= before + step)] - step, low[(low < before) & (low > before - step)], [before])))
    first, last = first_pick(low, high, ends, step), last_picks(us, step)
    exits = np.where(first < len(us), us[last[np.minimum(first, len(us) - 1)]], NONE)
    changes = np.append(exits[1:] != exits[:-1], True)  # neighbouring pieces of one exit become one
    return ends[changes], exits[changes]


def groups(batches):
    """The rows of each block."""
    for table, starts in whole_groups(batches):
        edges = [*np.unique(starts).tolist(), table.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield table.slice(a, b - a)


def picks(readings: DataFrame, step: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(station_id, seq, us) of the picked rows, in the order of seq; step in microseconds. A station's first row is picked.
    Rows without a time are not seen; equal times are no step."""
    rows = importable(readings).select("station_id", F.col("seq").cast("long").alias("seq"), micros("ts").alias("us")).filter("us IS NOT NULL")
    # A block begins with the row before it; exchanged once, and read from there by both passes.
    blocks = dealt(numbered(rows, block_rows=block_rows), 1, block_rows)
    def summarised(batches):
        for table in groups(batches):
            us = table.column("us").to_numpy()
            if not table.column("halo")[0].as_py():  # the station begins here, with a pick
                ends, exits = [np.iinfo(np.int64).max], us[last_picks(us, step)[:1]]
            elif len(us) > 1:
                ends, exits = summary(us[1:], int(us[0]), step)
            else:
                continue
            yield pa.RecordBatch.from_pydict({**{k: table.column(k)[:1].combine_chunks() for k in ("station_id", "block")}, "ends": pa.array([ends], pa.list_(pa.int64())), "exits": pa.array([exits], pa.list_(pa.int64()))})

    def walked(batches):
        name, last = None, NONE
        for batch in batches:
            before = []
            for own, ends, exits in zip(batch.column("station_id").to_pylist(), batch.column("ends"), batch.column("exits"), strict=True):
                if own != name:
                    name, last = own, NONE
                before.append(None if last == NONE else last)
                found = int(exits.values[int(np.searchsorted(ends.values.to_numpy(), last, "left"))].as_py())
                last = last if found == NONE else found
            yield pa.RecordBatch.from_arrays([batch.column("station_id"), batch.column("block"), pa.array(before, pa.int64())], names=["station_id", "block", "last"])

    def picked(batches):
        for table in groups(batches):
            us, halo, last = table.column("us").to_numpy(), bool(table.column("halo")[0].as_py()), table.column("last")[0].as_py()
            own = us[1:] if halo else us
            if not len(own):
                continue
            after = next_picks(own, step)
            at = 0 if last is None else int(first_pick(np.minimum.accumulate(own), np.maximum.accumulate(own), last, step))
            keep = []
            while at < len(own):
                keep.append(at)
                at = int(after[at])
            kept = table.select(["station_id", "seq", "us"]).take(pa.array(np.array(keep, np.int64) + halo))
            yield from kept.combine_chunks().to_batches()

    columns = ("station_id", "seq", "us", "block", "place", "halo")
    blocks = blocks.select(*columns)
    shape = blocks.sortWithinPartitions("station_id", "block", "place").mapInArrow(summarised, "station_id string, block long, ends array<long>, exits array<long>")
    begun = shape.repartition("station_id").sortWithinPartitions("station_id", "block").mapInArrow(walked, "station_id string, block long, last long")
    joined = blocks.join(begun, ["station_id", "block"], "left")
    return joined.select(*columns, "last").sortWithinPartitions("station_id", "block", "place").mapInArrow(picked, "station_id string, seq long, us long")
