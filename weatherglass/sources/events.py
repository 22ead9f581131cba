"""Readings and stations made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATIONS, CADENCE = 10, 30.0


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stations' readings with irregular gaps, dropouts, runs and values out of range."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("S"), (F.col("user_id") % STATIONS).cast("string")).alias("station_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when((kind == "error") & (k < 10), None).otherwise(F.rint(F.col("value") / 8 - 5)).alias("temperature_c"),
        F.rint(990 + k / 4).alias("pressure_hpa"),
        F.when((kind == "signup") & (k < 5), None).otherwise((50 + k % 60).cast("double")).alias("humidity_pct"),
        F.when((kind == "error") & (k >= 95), 2).when((kind == "error") & (k >= 90), 1).otherwise(0).alias("qc_flag"),
    )


def stations(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(STATIONS).select(
        F.concat(F.lit("S"), i.cast("string")).alias("station_id"),
        (10 + 1.5 * i).alias("lat"), (70 + (i * 7) % 10 * 0.8).alias("lon"),
        F.concat(F.lit("Z"), (i % 3).cast("string")).alias("climate_zone"),
        F.lit(CADENCE).alias("cadence_minutes"))
