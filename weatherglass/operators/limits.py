"""Limits that each station teaches from clean history: runs of equal values, jitter, usual and largest steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import MINUTE, long_form, micros, minutes
from ..settings import CHANNELS, DEFAULT, Settings
from .features import BLOCK_ROWS, clean, dealt, in_block, numbered
from .history import jitters


def neighbours(readings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """station_id, seq, us and each channel, with those of the reading before (us1, <channel>_1). A block begins with the row
    before it, so that no window holds a station; rows keep their block, place and order."""
    rows = readings.select("station_id", "seq", micros("ts").alias("us"), *CHANNELS)
    before = {f"{c}_1": F.lag(c).over(in_block()) for c in CHANNELS} | {"us1": F.lag("us").over(in_block())}
    return dealt(numbered(rows, block_rows=block_rows), 1, block_rows).withColumns(before).filter("NOT halo").drop("halo")


def cadence(readings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(station_id, cadence_minutes): the median of the positive gaps. Equal gaps are counted first, so that the median of a
    station is that of few weighted values."""
    return _cadence(neighbours(readings, block_rows))


def _cadence(near: DataFrame) -> DataFrame:
    gaps = near.withColumn("gap", minutes(F.col("us1"), F.col("us"))).filter("gap > 0").groupBy("station_id", "gap").agg(F.count("*").alias("n"))
    return gaps.groupBy("station_id").agg(F.expr("percentile(gap, 0.5D, n)").alias("cadence_minutes"))


def _pairs(near: DataFrame, cadences: DataFrame) -> DataFrame:
    """One row a reading and channel: value, before and the minutes between (dt), with the station's cadence."""
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value"), F.col(f"{c}_1").alias("before")) for c in CHANNELS])
    rows = near.select("station_id", "block", "place", "us", minutes(F.col("us1"), F.col("us")).alias("dt"), F.explode(channels).alias("x"))
    return rows.select("*", "x.*").drop("x").join(cadences.select("station_id", "cadence_minutes"), "station_id")


def resolution(readings: DataFrame) -> DataFrame:
    """(station_id, channel, resolution): 1, 0.5 or 0.1 if over 98 % of at least 50 values are its multiples, else null."""
    rows = long_form(readings, "station_id").filter("value IS NOT NULL")
    share = {step: F.avg((F.abs(F.col("value") / step - F.rint(F.col("value") / step)) < 1e-6).cast("double")) for step in (1.0, 0.5, 0.1)}
    found = F.lit(None).cast("double")
    for step in (0.1, 0.5, 1.0):
        found = F.when(share[step] > 0.98, step).otherwise(found)
    return rows.groupBy("station_id", "channel").agg(F.when(F.count("*") >= 50, found).alias("resolution"))


def runs(readings: DataFrame, cadences: DataFrame, s: Settings = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(station_id, channel, start_us, n, minutes) of runs of at least two equal values; gaps and missing values end a run."""
    return _runs(neighbours(readings, block_rows), cadences, s)


def _runs(near: DataFrame, cadences: DataFrame, s: Settings) -> DataFrame:
    """Runs are found in each block. Those that touch an edge, two a block at most, are joined with their other parts."""
    fresh = F.col("value").isNull() | F.col("before").isNull() | (F.col("value") != F.col("before")) | (F.col("dt") > s.gap_multiplier * F.col("cadence_minutes"))
    block = Window.partitionBy("station_id", "channel", "block")
    rows = _pairs(near, cadences).withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(block.orderBy("place")))
    # Run 0 of a block goes on with the last run of the block before.
    parts = rows.groupBy("station_id", "channel", "block", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("value").alias("n"))
    parts = parts.withColumn("edge", (F.col("run") == 0) | (F.col("run") == F.max("run").over(block)))
    order = Window.partitionBy("station_id", "channel").orderBy("block", "run")
    edges = parts.filter("edge").withColumn("whole", F.sum((F.col("run") > 0).cast("int")).over(order))
    edges = edges.groupBy("station_id", "channel", "whole").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
    columns = ("station_id", "channel", "start_us", "end_us", "n")
    found = parts.filter("NOT edge").select(*columns).unionByName(edges.select(*columns))
    return found.filter("n >= 2").select("station_id", "channel", "start_us", "n", minutes(F.col("start_us"), F.col("end_us")).alias("minutes"))


def steps(readings: DataFrame, cadences: DataFrame, s: Settings = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(station_id, channel, dt, change) of neighbouring readings that no gap parts."""
    return _steps(neighbours(readings, block_rows), cadences, s)


def _steps(near: DataFrame, cadences: DataFrame, s: Settings) -> DataFrame:
    rows = _pairs(near, cadences).withColumn("change", F.abs(F.col("value") - F.col("before")))
    return rows.filter((F.col("dt") > 0) & (F.col("dt") <= s.gap_multiplier * F.col("cadence_minutes")) & F.col("change").isNotNull())


def running_cadence(readings: DataFrame, rows: int = 33, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """readings with running_cadence, the median of the positive gaps among the last `rows` arrivals; null without any. A block
    begins with the rows before it that this can reach."""
    blocks = dealt(numbered(readings.withColumn("us_", micros("ts")), block_rows=block_rows), rows, block_rows)
    gap = minutes(F.lag("us_").over(in_block()), F.col("us_"))
    timed = blocks.withColumn("gap_", F.when(gap > 0, gap)).withColumn("running_cadence", F.expr("percentile(gap_, 0.5D)").over(in_block().rowsBetween(2 - rows, 0)))
    return timed.filter("NOT halo").select(*readings.columns, "running_cadence")


def noise_estimates(readings: DataFrame, cadences: DataFrame, s: Settings = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(station_id, channel, seq, jitter) where a full window lies behind a reading, in the order of time. A window meets two
    of the station's time ranges of its width at most, so their counts bound the rows that a block needs before it."""
    base = clean(readings).join(cadences.select("station_id", "cadence_minutes"), "station_id")
    base = base.withColumn("noise_window", F.greatest(F.lit(s.noise.window), (s.noise.min_samples - 1) * F.col("cadence_minutes")))
    most = base.groupBy("station_id", F.floor(F.col("us") / (F.col("noise_window") * MINUTE))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    found = jitters(dealt(numbered(base, "us", block_rows), 2 * most, block_rows).sortWithinPartitions("station_id", "block", "place"), s)
    return found.unpivot(["station_id", "seq"], list(CHANNELS), "channel", "jitter").filter("jitter IS NOT NULL")


def _quantile(column: str, q: float, margin: float, least: int):
    return F.when(F.count(column) >= least, F.expr(f"percentile({column}, {q}D)") * margin)


def fit(readings: DataFrame, cadences: DataFrame | None = None, s: Settings = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a station and channel; a limit that too few samples back is null. Cadence, runs and steps share an exchange."""
    rows = neighbours(readings, block_rows)
    cadences = _cadence(rows) if cadences is None else cadences
    p = s.limits
    keys = ["station_id", "channel"]
    moved = _steps(rows, cadences, s)
    near = F.when(F.col("dt") <= 1.5 * F.col("cadence_minutes"), F.col("change"))
    found = moved.withColumn("near", near).groupBy(keys).agg(_quantile("near", p.usual_percentile, 1.0, p.min_usual).alias("typical_step"), _quantile("change", p.step_quantile, p.step_margin, p.min_steps).alias("step_cap"))
    run = _runs(rows, cadences, s).groupBy(keys).agg(F.count("*").alias("n_runs"), _quantile("minutes", p.frozen_quantile, p.frozen_margin, p.min_runs).alias("frozen_minutes"))
    noise = noise_estimates(readings, cadences, s, block_rows).groupBy(keys).agg(_quantile("jitter", p.noise_quantile, p.noise_margin, p.min_noise).alias("noise_std"))
    out = resolution(readings).join(run, keys, "left").join(noise, keys, "left").join(found, keys, "left")
    return out.join(cadences.select("station_id", "cadence_minutes"), "station_id").select(
        "station_id", "cadence_minutes", "channel", "resolution", "frozen_minutes", "noise_std", "typical_step", "step_cap", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


VALUES = ("resolution", "frozen_minutes", "noise_std", "typical_step", "step_cap")


def complete(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Limits of base with what it lacks from fresh; the cadence becomes fresh's where a noise limit was unlearned."""
    keys = ["station_id", "channel"]
    other = fresh.select(*keys, *[F.col(v).alias(f"new_{v}") for v in VALUES], F.col("cadence_minutes").alias("new_cadence"))
    unlearned = F.max(F.col("noise_std").isNull()).over(Window.partitionBy("station_id"))
    joined = base.withColumn("unlearned", unlearned).join(other, keys, "left")
    return joined.select(
        "station_id", F.when(F.col("unlearned"), F.coalesce("new_cadence", "cadence_minutes")).otherwise(F.col("cadence_minutes")).alias("cadence_minutes"),
        "channel", *[F.coalesce(v, f"new_{v}").alias(v) for v in VALUES], "n_runs")


def learn(readings: DataFrame, known: DataFrame, fraction: float = 0.7, min_rows: int = 300, min_days: float = 14.0, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(training rows, rows to judge) of stations that are not known (station_id): the first fraction teaches, if it has
    enough rows and days; the rows to judge keep two days before the cut as lead-in (lead true)."""
    new = readings.join(known.select("station_id").distinct(), "station_id", "left_anti").withColumn("us", micros("ts"))
    counted = numbered(new, block_rows=block_rows).join(new.groupBy("station_id").agg(F.count("*").alias("total")), "station_id")
    split = counted.withColumn("teaches", F.col("place") <= F.floor(F.col("total") * fraction))
    facts = split.filter("teaches").groupBy("station_id").agg(F.count("*").alias("rows"), F.min("us").alias("first"), F.max("us").alias("last"))
    enough = facts.filter((F.col("rows") >= min_rows) & (minutes(F.col("first"), F.col("last")) >= min_days * 1440)).select("station_id", F.col("last").alias("cut"))
    kept = split.join(enough, "station_id")
    lead = kept["teaches"] & (kept["us"] >= kept["cut"] - 2 * 1440 * MINUTE)
    drop = ["place", "total", "teaches", "cut", "us"]
    return kept.filter("teaches").drop(*drop), kept.filter(lead | ~kept["teaches"]).withColumn("lead", F.col("teaches")).drop(*drop)
