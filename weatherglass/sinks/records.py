"""The table of records: raw values and verdict written together, partitioned by day.

A purge that ends halfway is carried on or undone by whatever reads, adds or purges next: the rows of the cutoff's day that stay
are first written beside the table; then one small file, the manifest, says which old files go and which new ones come instead.
Before it is there nothing has happened; once it is there all of it will.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, listed, moved, read_text, remove, write_text


def append(records: DataFrame, folder: str) -> None:
    """Add records (with day). Rows are written once, so that raw values never change."""
    settle(records.sparkSession, folder)
    records.write.mode("append").partitionBy("day").parquet(folder)


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """All records. Files of an older schema get the columns that they lack, as nulls; wanted: a frame whose columns must be
    there as well."""
    settle(spark, folder)
    rows = spark.read.option("mergeSchema", True).parquet(folder)
    for field in wanted.schema.fields if wanted is not None else ():
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rows


def settle(spark: SparkSession, folder: str) -> None:
    """Carry on a purge whose manifest is written, undo one without. Each step can be repeated."""
    beside = f"{folder}.purge"
    if not exists(spark, beside):
        return
    if exists(spark, f"{beside}/manifest.json"):
        told = json.loads(read_text(spark, f"{beside}/manifest.json"))
        for path in told["old"]:
            remove(spark, path)
        for path in listed(spark, f"{beside}/rows"):
            moved(spark, path, f"{folder}/day={told['day']}")
    remove(spark, beside)


def purge(spark: SparkSession, folder: str, cutoff: dt.datetime) -> int:
    """Delete the records before cutoff and return their number. Whole days go without being read beyond their counts; of the
    cutoff's own day the files that are there now are replaced (see above), and files that come meanwhile stay."""
    if not exists(spark, folder):
        return 0
    settle(spark, folder)
    day = cutoff.date()
    own = listed(spark, f"{folder}/day={day}")
    rows = spark.read.option("mergeSchema", True).parquet(folder)
    old = F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")
    counted = rows.filter((F.col("day") <= day) & old).groupBy("day").agg(F.count("*").alias("n")).collect()  # a row a day
    if any(r["day"] == day for r in counted):
        beside = f"{folder}.purge"
        left = spark.read.option("mergeSchema", True).parquet(*own).filter(~old)
        left.write.mode("overwrite").parquet(f"{beside}/rows")
        write_text(spark, f"{beside}/manifest.json", json.dumps({"day": str(day), "old": own}))
        settle(spark, folder)
    for r in counted:
        if r["day"] < day:
            remove(spark, f"{folder}/day={r['day']}")
    return sum(r["n"] for r in counted)
