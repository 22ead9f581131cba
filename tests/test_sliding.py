"""Medians of sliding windows in blocks, and picks apart from each other, against plain loops."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from weatherglass.functions.core import MINUTE, micros
from weatherglass.operators import evaluation, sliding

START = dt.datetime(2024, 1, 1)
SCHEMA = "station_id string, ts timestamp_ntz, value double"


def expected(rows, minutes, least):
    out = []
    for name, ts, value in rows:
        held = sorted(v for n, t, v in rows if n == name and (t == ts or t is not None and ts is not None and ts - dt.timedelta(minutes=minutes) < t <= ts))
        if len(held) >= least:
            out.append((name, ts, value, float(np.median(held)), len(held)))
    return sorted(out, key=str)


def test_sliding_medians_in_blocks(spark):
    r = np.random.default_rng(4)
    rows = [("A", START + dt.timedelta(minutes=int(m)), float(v)) for m, v in zip(r.integers(0, 300, 400), r.integers(0, 40, 400))]
    rows += [("B", START + dt.timedelta(minutes=int(m)), float(v)) for m, v in zip(r.integers(0, 900, 150), r.normal(0, 1, 150))]
    rows += [("B", None, 1.0), ("B", None, 2.0), ("C", START, 5.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for minutes, least, block_rows in ((60, 3, 25), (60, 1, 10_000), (100_000, 2, 40), (1, 1, 7)):
        got = [tuple(x) for x in sliding.medians(frame, minutes * MINUTE, least, block_rows).collect()]
        assert sorted(got, key=str) == expected(rows, minutes, least)


def test_low_pressure_without_a_window_over_a_station(spark):
    rows = spark.range(40_000).select(F.lit("A").alias("station_id"), F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"), F.when(F.col("id") % 1000 == 999, 980.0).otherwise(1000 + F.col("id") % 7 / 10).alias("pressure_hpa"))
    found = evaluation.low_pressure(rows, block_rows=5_000)
    assert "percentile(pressure_hpa" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == 40 and {round(x.score, 6) for x in got} == {20.3}


def test_separated_in_rounds(spark):
    r = np.random.default_rng(5)
    rows = [(f"S{k % 3}", START + dt.timedelta(hours=int(h)), float(s)) for k, (h, s) in enumerate(zip(r.integers(0, 600, 300), r.integers(0, 12, 300)))]
    frame = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, score double")
    for days, most in ((3.0, 4), (0.5, 6)):
        found = evaluation.separated(frame, days, most)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        wanted = []
        for name in ("S0", "S1", "S2"):
            kept = []
            for row in sorted({x for x in rows if x[0] == name}, key=lambda x: (-x[2], x[1])):
                if len(kept) < most and all(abs(row[1] - k[1]) > dt.timedelta(days=days) for k in kept):
                    kept.append(row)
            wanted += kept
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert evaluation.separated(frame.limit(0), 3.0, 4).count() == 0 and frame.select(micros("ts").alias("us")).count() == 300
