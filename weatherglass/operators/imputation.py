"""Estimates of missing or faulty values, with an uncertainty band, from the last trusted value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import MINUTE, micros, minutes
from ..settings import CHANNELS, DEFAULT, Settings
from . import normality
from .features import station

#: Rows of a block of with_last().
BLOCK_ROWS = 65_536


def trusted(c: str) -> Column:
    return F.col(c).isNotNull() & ~((F.col("verdict") == "FAULT") & F.array_contains("flagged_channels", c))


def estimate(c: str, ts: Column, us: Column, last: Column, s: Settings) -> Column:
    """(value, lower, upper, age_minutes, method) at ts from last (us, ts, v); null if that is too old or missing.
    Needs the station's cell maps beside it."""
    p, floor = s.impute, s.normality.min_std[c]
    age = minutes(last["us"], us)
    rho = F.pow(F.lit(0.5), age / p.halflife)
    (mean, std), (then, _) = normality.centred(c, ts), normality.centred(c, last["ts"])
    known = mean.isNotNull() & then.isNotNull()
    value = F.when(known, mean + rho * (last["v"] - then)).otherwise(last["v"])
    spread = F.when(known, F.sqrt(F.pow(F.greatest(std, F.lit(floor)), 2) * (1 - rho * rho) + (1 + rho * rho) * floor**2)).otherwise(
        F.sqrt(p.sigma[c] ** 2 * F.least(F.lit(1.0), age / p.halflife) + 2 * floor**2))
    out = F.struct(
        F.bround(value, 4).alias("value"), F.bround(value - p.band * spread, 4).alias("lower"), F.bround(value + p.band * spread, 4).alias("upper"),
        F.bround(age, 2).alias("age_minutes"), F.when(known, "normal").otherwise("last").alias("method"))
    return F.when(last.isNotNull() & (age <= p.lookback), out)


def with_last(fused: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fused (with place) with last_<channel>, the latest trusted (us, ts, v) of the rows before each: those of its block of
    the station, else what the blocks before have left, so that no window holds a station."""
    found = {f"own_{c}": F.when(trusted(c), F.struct("us", "ts", F.col(c).alias("v"))) for c in CHANNELS}
    rows = fused.withColumns(found | {"block_": F.floor((F.col("place") - 1) / block_rows)})
    left = rows.groupBy("station_id", "block_").agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("place"))).alias(x) for x in found])
    earlier = Window.partitionBy("station_id").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("station_id", "block_", *[F.last(f"own_{c}", ignorenulls=True).over(earlier).alias(f"carried_{c}") for c in CHANNELS])
    inside = Window.partitionBy("station_id", "block_").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"last_{c}": F.last(f"own_{c}", ignorenulls=True).over(inside) for c in CHANNELS}).join(carried, ["station_id", "block_"], "left")
    return rows.withColumns({f"last_{c}": F.coalesce(f"last_{c}", f"carried_{c}") for c in CHANNELS}).drop("block_", *found, *[f"carried_{c}" for c in CHANNELS])


def impute(fused: DataFrame, cells: DataFrame, s: Settings = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fused with the map channel -> estimate for each missing value, and for each flagged channel of a FAULT. fused needs
    place, verdict and flagged_channels; raw values stay as they are."""
    # The latest of the trusted rows before, among those that are older than the reading. Cells join after the window: they are
    # wide, and no exchange should carry them.
    last = [f"last_{c}" for c in CHANNELS]
    rows = normality.attach(with_last(fused, block_rows), cells)
    found, entries = {}, []
    for c in CHANNELS:
        need = F.col(c).isNull() | ((F.col("verdict") == "FAULT") & F.array_contains("flagged_channels", c))
        found[f"estimate_{c}"] = F.when(need, estimate(c, F.col("ts"), F.col("us"), F.when(F.col(f"last_{c}")["us"] < F.col("us"), F.col(f"last_{c}")), s))
        entries.append(F.when(F.col(f"estimate_{c}").isNotNull(), F.struct(F.lit(c).alias("key"), F.col(f"estimate_{c}").alias("value"))))
    rows = rows.withColumns(found).drop(*last, *[f"cells_{c}" for c in CHANNELS])
    return rows.withColumn("imputation", F.map_from_entries(F.array_compact(F.array(*entries)))).drop(*found)


def gap_times(readings: DataFrame, stations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The missing sample times inside gaps, at most `fill` a gap: (station_id, at, at_us, and the latest value of each
    channel before the gap)."""
    rows = readings.join(stations.select("station_id", "cadence_minutes"), "station_id").withColumn("us", micros("ts"))
    here = station().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"next_us": F.lead("us").over(station())} | {f"last_{c}": F.last(F.when(F.col(c).isNotNull(), F.struct("us", "ts", F.col(c).alias("v"))), ignorenulls=True).over(here) for c in CHANNELS})
    gap = minutes(F.col("us"), F.col("next_us"))
    missing = F.least(F.rint(gap / F.col("cadence_minutes")).cast("int") - 1, F.lit(s.impute.fill))
    times = rows.filter((gap > s.gap_multiplier * F.col("cadence_minutes")) & (missing >= 1)).withColumn("k", F.explode(F.sequence(F.lit(1), missing)))
    span = f"cast(k * cadence_minutes * {MINUTE} as bigint)"
    return times.select("station_id", F.expr(f"timestampadd(MICROSECOND, {span}, ts)").alias("at"), (F.col("us") + F.expr(span)).alias("at_us"), *[f"last_{c}" for c in CHANNELS])


def fill_gaps(readings: DataFrame, stations: DataFrame, cells: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, ts, channel, value, lower, upper, age_minutes, method) for the missing sample times inside gaps, from the
    readings before each (all trusted)."""
    times = normality.attach(gap_times(readings, stations, s), cells)
    found = times.select("station_id", "at", *[estimate(c, F.col("at"), F.col("at_us"), F.col(f"last_{c}"), s).alias(c) for c in CHANNELS])
    return found.unpivot(["station_id", "at"], list(CHANNELS), "channel", "e").filter("e IS NOT NULL").select("station_id", F.col("at").alias("ts"), "channel", "e.*")
