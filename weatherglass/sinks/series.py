"""Series and logs for other programs: CSV by station and split, fault logs and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import CHANNELS, DEFAULT, Settings
from ..operators.injection import magnitude


def write_csv(rows: DataFrame, folder: str, cut: str | None = None) -> None:
    """One folder a station and split: dev before the time cut, future from then on (all: without cut), in the order of time."""
    split = F.lit("all") if cut is None else F.when(F.col("ts") < F.lit(cut).cast("timestamp_ntz"), "dev").otherwise("future")
    out = rows.select("station_id", split.alias("split"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), *CHANNELS, F.col("qc_flag").alias("noaa_flag"))
    out.repartition("station_id", "split").sortWithinPartitions("station_id", "split", "timestamp").write.mode("overwrite").partitionBy("station_id", "split").option("header", True).csv(folder)


def fault_log(faulted: DataFrame, plan: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row a fault of the plan with its times and parameters. faulted: injection.inject's rows."""
    times = faulted.filter("event IS NOT NULL").groupBy("station_id", "event").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    kind = F.col("fault_type")
    size = magnitude(kind, F.col("channel"), s)
    entries = F.array(
        F.when(size.isNotNull(), F.struct(F.lit("magnitude").alias("key"), size.alias("value"))),
        F.when(kind.isin("spike", "step", "drift"), F.struct(F.lit("sign").alias("key"), F.col("sign").alias("value"))),
        F.when(kind == "clock_shift", F.struct(F.lit("shift_hours").alias("key"), F.lit(s.injector.shift_hours).alias("value"))))
    return plan.join(times, ["station_id", "event"]).select("station_id", "event", "fault_type", "channel", "start", "end", "start_index", "end_index", F.map_from_entries(F.array_compact(entries)).alias("params"))


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)
