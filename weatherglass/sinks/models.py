"""What stations have learned, as one Parquet table a kind, partitioned by station."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.engine import Models
from .files import exists

KINDS = tuple(f.name for f in fields(Models))


def save(models: Models, folder: str) -> None:
    """Write the tables that there are. Only the stations in them are replaced."""
    for kind in KINDS:
        table = getattr(models, kind)
        if table is not None:
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("station_id").parquet(f"{folder}/{kind}")


def load(spark: SparkSession, folder: str, stations: list[str] | None = None) -> Models:
    """The models in folder, of some stations if they are named; a kind that was never saved is missing."""
    def table(kind: str) -> DataFrame | None:
        if not exists(spark, f"{folder}/{kind}"):
            return None
        rows = spark.read.parquet(f"{folder}/{kind}").withColumn("station_id", F.col("station_id").cast("string"))
        return rows if stations is None else rows.filter(F.col("station_id").isin(stations))

    return Models(**{k: table(k) for k in KINDS})


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(station_id, kind, fingerprint): twelve hex digits that change with the content of a station's model."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    parts = files.select(
        F.regexp_extract("path", r"station_id=([^/]+)/", 1).alias("station_id"), F.regexp_extract("path", r"/([a-z]+)/station_id=", 1).alias("kind"), F.sha2("content", 256).alias("digest"))
    joined = F.array_join(F.array_sort(F.collect_list("digest")), "")
    return parts.groupBy("station_id", "kind").agg(F.substring(F.sha2(joined, 256), 1, 12).alias("fingerprint"))
