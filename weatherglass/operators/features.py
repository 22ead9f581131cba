"""What the checks of a reading need of its history: previous values, expected values and measures of the kept history.

Rows are dealt into blocks of a station, each with as many of the rows before it (its halo) as history can reach. So every
check of a reading sees all that it needs within its block, and a station that holds a third of all rows is spread over many
tasks. One exchange and one sort by (station_id, block, place) serve every check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import finite, micros, minutes
from ..settings import CHANNELS, DEFAULT, Settings
from . import history, normality

#: Rows of a block besides its halo.
BLOCK_ROWS = 8192
LEARNED = ("frozen_minutes", "noise_std", "typical_step", "step_cap")


def station():
    """The partitioning and order of windows over a whole station."""
    return Window.partitionBy("station_id").orderBy("seq")


def clean(readings: DataFrame) -> DataFrame:
    """Values that are not finite become missing."""
    return readings.withColumns({c: finite(F.col(c)) for c in CHANNELS} | {"us": micros("ts")})


def numbered(readings: DataFrame, by: str = "seq", block_rows: int = BLOCK_ROWS, *, ties: bool = False) -> DataFrame:
    """readings with place, their rank (from 1) by a whole number in their station. Rows are counted by station and range of
    the number first, so that no task ranks a whole station. ties: equal numbers get one place, their first."""
    place = F.rank() if ties else F.row_number()
    low, high, n = readings.agg(F.min(by), F.max(by), F.count("*")).first()
    if n <= block_rows:
        return readings.withColumn("place", place.over(Window.partitionBy("station_id").orderBy(by)).cast("long"))
    span = max(1, -(-(high - low + 1) * block_rows // n))
    rows = readings.withColumn("part_", F.floor((F.col(by) - low) / span))
    earlier = Window.partitionBy("station_id").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("station_id", "part_").agg(F.count("*").alias("n_")).select("station_id", "part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("station_id", "part_").orderBy(by)
    return rows.join(counts, ["station_id", "part_"]).withColumn("place", F.col("before_") + place.over(inside)).drop("part_", "before_")


def dealt(rows: DataFrame, reach: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (with place) in blocks of their station, exchanged by block; a block begins with the `reach` rows before it, for
    which halo is true."""
    size = max(block_rows, reach)
    own, offset = F.floor((F.col("place") - 1) / size), (F.col("place") - 1) % size
    blocks = F.when(offset >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("own_", own).withColumn("block", F.explode(blocks)).withColumn("halo", F.col("block") != F.col("own_")).drop("own_")
    return spread.repartition("station_id", "block")


def in_block():
    return Window.partitionBy("station_id", "block").orderBy("place")


def lags(rows: DataFrame) -> DataFrame:
    """Previous two readings, and the minutes between (dt1 to the previous, dt2 from the one before)."""
    new = {"us1": F.lag("us").over(in_block()), "us2": F.lag("us", 2).over(in_block())}
    for c in CHANNELS:
        new |= {f"{c}_1": F.lag(c).over(in_block()), f"{c}_2": F.lag(c, 2).over(in_block()), f"e1_{c}": F.lag(f"e_{c}").over(in_block())}
    return rows.withColumns(new).withColumns({"dt1": minutes(F.col("us1"), F.col("us")), "dt2": minutes(F.col("us2"), F.col("us1"))})


def with_normal(readings: DataFrame, cells: DataFrame | None, settings: Settings = DEFAULT) -> DataFrame:
    """Expected value, spread, smooth expected value and z of each channel (null without cells)."""
    none = F.lit(None).cast("double")
    if cells is None:
        return readings.withColumns({f"{x}_{c}": none for c in CHANNELS for x in ("e", "s", "smooth", "z")})
    joined = normality.attach(readings, cells).withColumns(normality.corners())
    joined = joined.withColumns({f"cell_{c}": normality.expected_cell(c) for c in CHANNELS})
    new = {}
    for c in CHANNELS:
        spread = F.when(F.col(f"cell_{c}").isNotNull(), F.greatest(F.col(f"cell_{c}")["std"], F.lit(settings.normality.min_std[c])))
        new |= {f"e_{c}": F.col(f"cell_{c}")["mean"], f"s_{c}": spread, f"smooth_{c}": normality.smooth_expected(c)}
    out = joined.withColumns(new).withColumns({f"z_{c}": (F.col(c) - F.col(f"e_{c}")) / F.col(f"s_{c}") for c in CHANNELS})
    return out.drop(*normality.CORNERS, *[f"{x}_{c}" for c in CHANNELS for x in ("cells", "cell")])


def wide_limits(limits: DataFrame) -> DataFrame:
    """One row a station: limit_cadence and each limit by channel."""
    return limits.groupBy("station_id").agg(
        F.first("cadence_minutes").alias("limit_cadence"),
        *[F.max(F.when(F.col("channel") == c, F.col(x))).alias(f"{x}_{c}") for c in CHANNELS for x in LEARNED]).withColumn("has_limits", F.lit(True))


def kept_rows(s: Settings, *, limits: bool, clock: bool = False) -> Column:
    """Rows of history that a station keeps: those of its longest window at its cadence, and a few more. A learned frozen window
    counts as often as a run must last to be hard."""
    widest = F.lit(s.widest_window(clock))
    if limits and s.layers.limits:
        widest = F.greatest(widest, *[F.coalesce(s.frozen.hard_multiplier * F.col(f"frozen_minutes_{c}"), F.lit(0.0)) for c in CHANNELS])
    return (F.ceil(widest / F.col("cadence_minutes")) + s.spare_rows).cast("int")


def with_limits(readings: DataFrame, stations: DataFrame, limits: DataFrame | None, s: Settings = DEFAULT) -> DataFrame:
    """readings with their station's cadence (the default's where none is set), its limits and kept_rows."""
    known = stations.select("station_id", "cadence_minutes")
    if limits is not None:
        known = known.join(wide_limits(limits), "station_id", "full")
        rows = readings.join(known, "station_id", "left")
    else:
        none = {f"{x}_{c}": F.lit(None).cast("double") for c in CHANNELS for x in LEARNED}
        rows = readings.join(known, "station_id", "left").withColumns(none | {"limit_cadence": F.lit(None).cast("double"), "has_limits": F.lit(None).cast("boolean")})
    cadence = F.coalesce("cadence_minutes", F.lit(s.default_cadence))
    return rows.withColumn("cadence_minutes", cadence).withColumn("kept_rows", kept_rows(s, limits=limits is not None))


def reach_of(stations: DataFrame, limits: DataFrame | None, s: Settings = DEFAULT, clock: bool = False) -> int:
    """The most rows of history that any station keeps; the default cadence counts for those that are not known."""
    one = stations.sparkSession.range(1).select(F.lit(None).cast("string").alias("station_id"))
    rows = with_limits(stations.select("station_id").unionByName(one), stations, limits, s)
    return rows.agg(F.max(kept_rows(s, limits=limits is not None, clock=clock))).first()[0]


def features(readings: DataFrame, stations: DataFrame, cells: DataFrame | None = None, limits: DataFrame | None = None, s: Settings = DEFAULT, *, clock: DataFrame | None = None, measure: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Readings with cadence, learned limits, lags, expected values and (measure) the measures of their history. clock: results
    (station_id, seq, flagged) at some readings; clock_flag is then the latest up to each reading."""
    rows = with_limits(clean(readings), stations, limits, s)
    if clock is not None:
        rows = rows.join(clock.select("station_id", "seq", F.struct(F.coalesce("flagged", F.lit(False)).alias("flag")).alias("clock_")), ["station_id", "seq"], "left")
    placed = numbered(rows, block_rows=block_rows)
    reach = reach_of(stations, limits, s) if measure else 2
    if clock is not None:
        placed = carried(placed, max(block_rows, reach))
    # The windows of lags() need the exchange that dealt() has made, and leave each block in its order.
    out = lags(with_normal(dealt(placed, reach, block_rows), cells, s))
    if clock is not None:
        upto = in_block().rowsBetween(Window.unboundedPreceding, 0)
        flag = F.coalesce(F.last("clock_", ignorenulls=True).over(upto), F.col("carried_"))["flag"]
        out = out.withColumn("clock_flag", F.coalesce(flag, F.lit(False))).drop("clock_", "carried_")
    return history.measured(out, s) if measure else out.filter("NOT halo").drop("block", "halo")


def carried(placed: DataFrame, size: int) -> DataFrame:
    """placed with carried_, the last clock_ of its station before its block."""
    rows = placed.withColumn("block_", F.floor((F.col("place") - 1) / size))
    last = rows.groupBy("station_id", "block_").agg(F.max_by("clock_", F.when(F.col("clock_").isNotNull(), F.col("place"))).alias("last_"))
    order = Window.partitionBy("station_id").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("station_id", "block_", F.last("last_", ignorenulls=True).over(order).alias("carried_"))
    return rows.join(before, ["station_id", "block_"], "left").drop("block_")
