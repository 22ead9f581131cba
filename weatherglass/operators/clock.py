"""Logger clocks: does the daily cycle fit the station's normal pattern better with the timestamps moved by whole hours?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import MINUTE, micros
from ..settings import DEFAULT, Settings
from . import throttle
from .features import kept_rows, numbered, with_limits

HOUR = 60 * MINUTE


def instants(readings: DataFrame, s: Settings = DEFAULT, every_hours: float | None = None) -> DataFrame:
    """(station_id, seq, us): the greedy throttle, a reading whenever `every_hours` of data time have gone by since the last
    pick, or time has gone back behind it."""
    return throttle.picks(readings, int((s.timing.every_hours if every_hours is None else every_hours) * HOUR))


def shift_scores(readings: DataFrame, stations: DataFrame, cells: DataFrame, at: DataFrame, limits: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, seq, shift, score, terms) for each instant of at: mean squared departure of the hourly means of the last
    day of the kept history from the pattern, for each shift. Readings meet instants by station and range of places, as long as the
    kept history: an instant meets two of them, however many readings a day has."""
    p = s.timing
    placed = numbered(with_limits(readings.withColumn("us", micros("ts")), stations, limits, s).withColumn("kept_rows", kept_rows(s, limits=limits is not None, clock=True)))
    placed = placed.withColumn("range", F.floor((F.col("place") - 1) / F.col("kept_rows")))
    values = placed.unpivot(["station_id", "range", "us", "place"], list(p.channels), "channel", "value").filter("value IS NOT NULL")
    window = int(p.window * MINUTE)
    asked = at.select("station_id", "seq").join(placed.select("station_id", "seq", "kept_rows", F.col("range").alias("at_range"), F.col("us").alias("at_us"), F.col("place").alias("at_place")), ["station_id", "seq"])
    near = asked.withColumn("range", F.explode(F.array(F.col("at_range") - 1, F.col("at_range")))).join(values, ["station_id", "range"])
    near = near.filter((F.col("us") >= F.col("at_us") - window) & (F.col("place") <= F.col("at_place")) & (F.col("place") > F.col("at_place") - F.col("kept_rows")))
    hourly = near.groupBy("station_id", "seq", F.floor(F.col("us") / HOUR).alias("hour"), "channel").agg(F.avg("value").alias("mean"))
    moved = hourly.withColumn("shift", F.explode(F.sequence(F.lit(-p.max_shift), F.lit(p.max_shift))))
    time = F.timestamp_seconds((F.col("hour") + F.col("shift")) * 3600)
    pattern = cells.select("station_id", "channel", F.col("month").alias("m"), F.col("hour").alias("h"), F.col("mean").alias("normal"), F.col("std").alias("spread"))
    found = moved.withColumns({"m": F.month(time), "h": F.hour(time)}).join(pattern, ["station_id", "channel", "m", "h"])
    floor = F.lit(None).cast("double")
    for c in p.channels:
        floor = F.when(F.col("channel") == c, s.normality.min_std[c]).otherwise(floor)
    z = (F.col("mean") - F.col("normal")) / F.greatest(F.col("spread"), floor)
    scored = found.groupBy("station_id", "seq", "shift").agg(F.avg(z * z).alias("score"), F.count("*").alias("terms")).filter(F.col("terms") >= p.min_bins)
    bins = hourly.groupBy("station_id", "seq").agg(F.count_distinct("hour").alias("bins")).filter(F.col("bins") >= p.min_bins)
    return scored.join(bins, ["station_id", "seq"], "left_semi")


def check(scores: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, seq, best_shift, best_score, score_0, flagged) of instants that can be judged."""
    p = s.timing
    best = scores.groupBy("station_id", "seq").agg(
        F.min_by("shift", F.struct("score", F.abs("shift"), "shift")).alias("best_shift"), F.min("score").alias("best_score"),
        F.max(F.when(F.col("shift") == 0, F.col("score"))).alias("score_0"), F.count("*").alias("shifts"))
    flagged = (F.abs("best_shift") >= p.min_shift) & (F.col("best_score") < F.col("score_0") * (1 - p.improvement))
    return best.filter("score_0 IS NOT NULL AND shifts >= 2").select("station_id", "seq", "best_shift", "best_score", "score_0", flagged.alias("flagged"))


def results(readings: DataFrame, stations: DataFrame, cells: DataFrame, limits: DataFrame | None = None, s: Settings = DEFAULT, start: DataFrame | None = None) -> DataFrame:
    """(station_id, seq, us, flagged) at each instant; each holds until the next one of its station. start: the same of the
    last instant before, for stations that have been seen, at the last reading that was."""
    rows = readings.select("station_id", F.col("seq").cast("long").alias("seq"), "ts")
    if start is not None:
        seen = start.select("station_id", F.col("seq").alias("seen"))
        epoch = "timestampadd(MICROSECOND, us, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
        rows = rows.join(seen, "station_id", "left").filter("seen IS NULL OR seq > seen").drop("seen").unionByName(start.select("station_id", "seq", F.expr(epoch).alias("ts")))
    at = instants(rows, s)
    if start is not None:
        at = at.join(start.select("station_id", "seq"), ["station_id", "seq"], "left_anti")
    found = check(shift_scores(readings, stations, cells, at, limits, s), s)
    out = at.join(found.select("station_id", "seq", "flagged"), ["station_id", "seq"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    return out if start is None else out.unionByName(start.select(*out.columns))
