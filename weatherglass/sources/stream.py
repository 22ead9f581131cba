"""Streams of JSON readings from a landing folder, with at most so many files a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import finite
from ..settings import CHANNELS

SCHEMA = "station_id string, timestamp string, temperature_c double, pressure_hpa double, humidity_pct double, device_flags array<string>, seq long"


def normalised(raw: DataFrame) -> DataFrame:
    """Times with a zone become UTC without one, values that are not finite become missing; ids of 1 to 64 characters."""
    ts = F.to_timestamp("timestamp").cast("timestamp_ntz")
    rows = raw.select("station_id", "seq", ts.alias("ts"), *[finite(F.col(c)).alias(c) for c in CHANNELS], "device_flags")
    return rows.filter(F.length("station_id").between(1, 64) & F.col("ts").isNotNull())


def read(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return normalised(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("allowNonNumericNumbers", True).json(folder))
