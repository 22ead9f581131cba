"""A station against its neighbours: hourly anomalies, their difference, and a learned limit of its weekly mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import MINUTE, long_form, micros
from ..settings import CHANNELS, DEFAULT, Settings
from .coldstart import distances

HOUR = 60 * MINUTE


def within(stations: DataFrame, s: Settings = DEFAULT, digits: int | None = None) -> DataFrame:
    """(station_id, other, km) within the radius; digits: of km, all if not given."""
    return distances(stations, s.peers.radius_km, digits)


def neighbours(stations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, other, km, place) within the radius, nearest first."""
    order = Window.partitionBy("station_id").orderBy("km", "other")
    return within(stations, s).withColumn("place", F.row_number().over(order))


def anomalies(readings: DataFrame) -> DataFrame:
    """(station_id, channel, hour, anomaly) on every hour between a station's first and last; missing hours are null. readings
    need the smooth_ and e_ columns; of several readings in an hour the first counts."""
    rows = readings.withColumns({"us": micros("ts"), "hour": F.floor(micros("ts") / HOUR)})
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("station_id", "hour").orderBy("us", "seq"))).filter("k = 1")
    departed = first.select("station_id", "hour", *[(F.col(c) - F.coalesce(f"smooth_{c}", f"e_{c}")).alias(c) for c in CHANNELS])
    calendar = departed.groupBy("station_id").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("station_id", F.explode(F.sequence("a", "b")).alias("hour"))
    return long_form(calendar.join(departed, ["station_id", "hour"], "left"), "station_id", "hour").withColumnRenamed("value", "anomaly")


def differences(found: DataFrame, near: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, channel, hour, difference): own anomaly minus the median of the peers', where enough have one."""
    peers = near.select("station_id", "other").join(found.withColumnRenamed("station_id", "other").filter("anomaly IS NOT NULL"), "other")
    middle = peers.groupBy("station_id", "channel", "hour").agg(F.median("anomaly").alias("middle"), F.count("*").alias("n")).filter(F.col("n") >= s.peers.min_peers)
    joined = found.join(middle, ["station_id", "channel", "hour"], "left")
    return joined.select("station_id", "channel", "hour", (F.col("anomaly") - F.col("middle")).alias("difference"))


def rolling(diffs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """diffs with the mean of the last `window` hours, where enough of them have a value."""
    back = Window.partitionBy("station_id", "channel").orderBy("hour").rowsBetween(1 - s.peers.window, 0)
    least = max(2, int(s.peers.window * s.peers.fraction))
    return diffs.withColumn("rolling", F.when(F.count("difference").over(back) >= least, F.avg("difference").over(back)))


def limits(rolled: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    p = s.peers
    out = rolled.filter("rolling IS NOT NULL").withColumn("size", F.abs("rolling")).groupBy("station_id", "channel")
    return out.agg((F.expr(f"percentile(size, {p.quantile}D)") * p.margin).alias("threshold"), F.count("*").alias("n_windows")).filter(F.col("n_windows") >= p.min_windows)


def alarms(rolled: DataFrame, limit: DataFrame) -> DataFrame:
    return rolled.join(limit, ["station_id", "channel"]).withColumn("alarm", F.coalesce(F.abs("rolling") > F.col("threshold"), F.lit(False)))
