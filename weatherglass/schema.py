"""Schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T

READINGS = "station_id string, seq bigint, ts timestamp_ntz, temperature_c double, pressure_hpa double, humidity_pct double, device_flags array<string>"
CHECK = "struct<check: string, kind: string, channel: string, flagged: boolean, severity: string, value: double>"
VERDICTS = ("VALID", "WEATHER", "SUSPECT", "FAULT")
STATIONS = "station_id string, lat double, lon double, climate_zone string, cadence_minutes double"
CELLS = "station_id string, month int, hour int, channel string, mean double, std double, n bigint"
LIMITS = "station_id string, cadence_minutes double, channel string, resolution double, frozen_minutes double, noise_std double, typical_step double, step_cap double, n_runs bigint"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
