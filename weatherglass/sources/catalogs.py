"""Catalogues beside the readings: stations (YAML) and weather windows (JSON)."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STATIONS


def stations(spark: SparkSession, path: str) -> DataFrame:
    """The stations of a YAML file (stations: by id, with lat, lon, climate_zone, cadence_minutes)."""
    text = spark.read.text(path, wholetext=True).first()[0]
    known = yaml.safe_load(text) or {}
    rows = [(name, *(None if s.get(k) is None else float(s[k]) for k in ("lat", "lon")), s.get("climate_zone"), None if s.get("cadence_minutes") is None else float(s["cadence_minutes"])) for name, s in ((str(k), v or {}) for k, v in (known.get("stations") or known).items())]
    return spark.createDataFrame(rows, STATIONS)


def weather_windows(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, kind, center, start, end, score) of a JSON file {"events": {station: [{kind, center, start, end, score}]}}."""
    event = "array<struct<kind: string, center: string, start: string, end: string, score: double>>"
    rows = spark.read.schema(f"events map<string, {event}>").option("multiLine", True).json(path)
    found = rows.select(F.explode("events").alias("station_id", "list")).select("station_id", F.explode("list").alias("x"))
    return found.select("station_id", "x.kind", *[F.to_timestamp_ntz(f"x.{c}").alias(c) for c in ("center", "start", "end")], "x.score")
