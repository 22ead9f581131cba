"""Queries over stored records (station_id, seq, ts, values, verdict, confidence, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import computed_once
from ..settings import CHANNELS


def latest(records: DataFrame, limit: int = 100, station: str | None = None) -> DataFrame:
    rows = records if station is None else records.filter(F.col("station_id") == station)
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def alerts(records: DataFrame, limit: int | None = 100, station: str | None = None) -> DataFrame:
    rows = computed_once(records).filter("verdict IS NOT NULL AND verdict <> 'VALID'")
    return latest(rows, limit, station) if limit else rows


def stations(records: DataFrame) -> DataFrame:
    return records.select("station_id").distinct().orderBy("station_id")


def recent(records: DataFrame, station: str, limit: int = 2000) -> DataFrame:
    """The newest readings of a station, oldest first."""
    return records.filter(F.col("station_id") == station).orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def by_id(records: DataFrame, seq: int) -> DataFrame:
    return records.filter(F.col("seq") == seq)


def counts(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by, F.coalesce("verdict", F.lit("PENDING")).alias("verdict")).agg(F.count("*").alias("n"))


def fleet(records: DataFrame, reports: DataFrame, known: DataFrame, cap: int = 200) -> DataFrame:
    """One row for each known or seen station, most urgent first: newest verdict, report, ticket, alerts held at cap."""
    newest = records.groupBy("station_id").agg(F.max_by(F.struct("verdict", "ts"), "seq").alias("x"), F.count_if(F.col("verdict").isNotNull() & (F.col("verdict") != "VALID")).alias("alerts"))
    names = known.select("station_id").union(records.select("station_id")).distinct()
    out = names.join(newest, "station_id", "left").join(reports.select("station_id", "score", "service_date", "ticket"), "station_id", "left")
    urgency = F.when(F.col("verdict") == "FAULT", 0).when(F.col("verdict") == "SUSPECT", 1).when(F.col("verdict") == "WEATHER", 2).when(F.col("verdict") == "VALID", 3).otherwise(4)
    rows = out.select("station_id", F.col("x.verdict").alias("verdict"), F.col("x.ts").alias("ts"), F.least(F.coalesce("alerts", F.lit(0)), F.lit(cap)).alias("alerts"), "score", "service_date", "ticket")
    return rows.withColumn("urgency", urgency).orderBy("urgency", F.coalesce("score", F.lit(101.0)), "station_id")


def chart(records: DataFrame) -> DataFrame:
    """(station_id, ts, channel, value, shown, missing): where a value is missing, the last one is shown."""
    w = Window.partitionBy("station_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    shown = records.withColumns({f"shown_{c}": F.last(c, ignorenulls=True).over(w) for c in CHANNELS})
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value"), F.col(f"shown_{c}").alias("shown")) for c in CHANNELS])
    return shown.select("station_id", "seq", "ts", F.explode(parts).alias("x")).select("station_id", "seq", "ts", "x.*", F.col("x.value").isNull().alias("missing"))


def check_rows(judged: DataFrame, flagged_only: bool = True) -> DataFrame:
    # The outer form: for a plain explode Spark infers a filter on the array, and computes all checks once more for it.
    found = F.filter("checks", lambda x: x["flagged"]) if flagged_only else F.col("checks")
    rows = judged.select("station_id", "seq", F.explode_outer(found).alias("x")).filter("x IS NOT NULL")
    return rows.select("station_id", "seq", "x.*")


def retained(records: DataFrame, cutoff) -> DataFrame:
    """Records from the cutoff on (partitioned by day, older files are not read)."""
    return records.filter(F.col("ts") >= cutoff)
