"""CSV readings: strict header, tolerant values, file order kept."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import CHANNELS
from ..sinks.files import exists

#: Texts that stand for a missing value, in any case (fixed values).
MISSING = ("", "nan", "null", "none")


class SealedPath(ValueError):
    pass


def check_path(path: str, root: str | None = None, sealed: tuple[str, ...] = ("holdout",), allow_sealed: bool = False) -> str:
    """path, if it lies under root (when given) and in no sealed folder."""
    parts = PurePosixPath(path).parts
    if ".." in parts or root is not None and not PurePosixPath(path).is_relative_to(root):
        raise SealedPath(f"{path} is not below {root}")
    if not allow_sealed and any(p in sealed for p in parts):
        raise SealedPath(f"{path} lies in a sealed folder")
    return path


def parsed(raw: DataFrame, station_id: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Typed readings from text columns, with bad true where a value is neither missing nor a number or time."""
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    if lacking := [c for c in ("timestamp", *CHANNELS) if c not in names]:
        raise ValueError(f"missing columns: {lacking}")
    if station_id is None and "station_id" not in names:
        raise ValueError("a station_id is needed, as a column or an argument")

    def text(name: str):
        return F.trim(F.col(f"`{names[name]}`"))

    ts = F.expr(f"coalesce(try_to_timestamp(trim(`{names['timestamp']}`)))").cast("timestamp_ntz")
    bad, values = ts.isNull(), []
    for c in CHANNELS:
        missing = text(c).isNull() | F.lower(text(c)).isin(*MISSING)
        number = text(c).try_cast("double")
        bad = bad | (~missing & number.isNull())
        values.append(F.when(~missing & ~F.isnan(number) & (F.abs(number) != float("inf")), number).alias(c))
    flag = F.coalesce(text("noaa_flag").try_cast("int"), F.lit(0)) if "noaa_flag" in names else F.lit(0)
    station = F.lit(station_id) if station_id is not None else text("station_id")
    return raw.select(station.alias("station_id"), "seq", ts.alias("ts"), *values, flag.alias("qc_flag"), bad.alias("bad"), *carry)


def read(spark: SparkSession, path: str, station_id: str | None = None) -> DataFrame:
    """Readings of a CSV file or folder, files by name and each in its own order; seq numbers them per station from 0. A row
    that can't be read is an error that tells its file and its number in it. Spark splits files at byte positions and keeps the
    order inside a split, so rows are counted by split first and numbered from these counts."""
    lines = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = lines.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("seq"))
    rows = parsed(raw, station_id, ("file_", "block_"))
    before = Window.partitionBy("file_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file_", "block_").agg(F.count("*").alias("n_"), F.min("seq").alias("first_")).withColumn("earlier_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    placed = rows.join(counts, ["file_", "block_"]).withColumn("row_", F.col("earlier_") + F.col("seq") - F.col("first_") + 1)
    told = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("row "), F.col("row_").cast("string"), F.lit(" of "), F.col("file_"), F.lit(" can't be read"))).cast("string"))
    order = Window.partitionBy("station_id").orderBy("file_", "row_")
    out = placed.withColumn("station_id", F.coalesce(told, "station_id")).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    return out.drop("bad", "file_", "block_", "n_", "first_", "earlier_", "row_")


def assembled(spark: SparkSession, paths: list[str], station_id: str | None = None) -> DataFrame:
    """One series from the parts that exist, in the order of time; of equal times that of the first part stays."""
    parts = [read(spark, p, station_id).withColumn("part", F.lit(k)) for k, p in enumerate(paths) if exists(spark, p)]
    if not parts:
        raise FileNotFoundError(f"none of {paths}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("station_id", "ts").orderBy("part", "seq"))).filter("k = 1").drop("k", "part", "seq")
    return first.withColumn("seq", F.row_number().over(Window.partitionBy("station_id").orderBy("ts")) - 1)


def prepared(rows: DataFrame, complete: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sorted rows in [start, end), the first of each time; complete: only rows with all channels."""
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    if complete:
        rows = rows.dropna(subset=list(CHANNELS))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("station_id", "ts").orderBy("seq"))).filter("k = 1").drop("k", "seq")
    return first.withColumn("seq", F.row_number().over(Window.partitionBy("station_id").orderBy("ts")) - 1)
