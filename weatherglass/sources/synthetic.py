"""Made series: a daily cycle, wandering pressure and a smooth passing front; fleets and one-second samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2026-01-01 00:00:00"


def noise(*keys) -> F.Column:
    """A draw close to normal, a function of its keys: the same on every run and partitioning."""
    parts = [F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(1 << 20)) / float(1 << 20) for k in range(12)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total - 6.0


def fleet(spark: SparkSession, stations: int, days: float, cadence_minutes: float = 60.0, seed: int = 1, front_day: float | None = None) -> DataFrame:
    """Readings of so many stations. Means differ by station; pressure is a mean of hash draws over a day, so that neighbours
    move together; a front lowers pressure and temperature and raises humidity for a day."""
    steps = int(days * 1440 / cadence_minutes)
    rows = spark.range(stations * steps).select((F.col("id") % stations).alias("i"), F.floor(F.col("id") / stations).alias("seq"))
    minute = F.col("seq") * cadence_minutes
    angle = 2 * math.pi * (minute % 1440 - 540) / 1440
    key = [F.lit(seed), F.col("i")]
    weight = minute % 720 / 720
    slow = (1 - weight) * noise(*key, F.floor(minute / 720)) + weight * noise(*key, F.floor(minute / 720) + 1)
    bump = F.lit(0.0)
    if front_day is not None:
        off = F.abs(minute - front_day * 1440) / 720
        bump = F.when(off < 1, 0.5 * (1 + F.cos(math.pi * off))).otherwise(0.0)
    t = 12 + (7 * F.col("i")) % 23 + 6 * F.sin(angle) + 0.2 * noise(*key, F.col("seq"), F.lit("t")) - 6 * bump
    p = 1000 + (5 * F.col("i")) % 20 + 3 * slow + 0.1 * noise(*key, F.col("seq"), F.lit("p")) - 12 * bump
    h = F.least(F.lit(100.0), F.greatest(F.lit(5.0), 45 + (3 * F.col("i")) % 30 - 12 * F.sin(angle) + 1.0 * noise(*key, F.col("seq"), F.lit("h")) + 20 * bump))
    ts = F.expr(f"timestampadd(SECOND, cast(seq * {cadence_minutes * 60}D as int), TIMESTAMP_NTZ'{START}')")
    return rows.select(F.concat(F.lit("S"), F.col("i").cast("string")).alias("station_id"), "seq", ts.alias("ts"), F.bround(t, 2).alias("temperature_c"), F.bround(p, 2).alias("pressure_hpa"), F.bround(h, 2).alias("humidity_pct"), F.lit(0).alias("qc_flag"))


def stations(spark: SparkSession, n: int, cadence_minutes: float = 60.0) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id"), F.lit(cadence_minutes).alias("cadence_minutes"))


def device_samples(spark: SparkSession, minutes: int, frozen_from: int | None = None) -> DataFrame:
    """One-second samples of one device; from a minute on the temperature stands still."""
    rows = spark.range(minutes * 60).withColumn("minute", F.floor(F.col("id") / 60))
    t = 20 + 0.01 * F.col("minute") + 0.05 * noise(F.col("id"), F.lit("t"))
    if frozen_from is not None:
        t = F.when(F.col("minute") >= frozen_from, 21.0).otherwise(t)
    return rows.select(
        F.lit("D1").alias("station_id"), F.expr(f"timestampadd(SECOND, id, TIMESTAMP_NTZ'{START}')").alias("ts"), t.alias("temperature_c"),
        (1000 + 0.05 * noise(F.col("id"), F.lit("p"))).alias("pressure_hpa"), (50 + 0.2 * noise(F.col("id"), F.lit("h"))).alias("humidity_pct"))
