"""What grew with the square of how dense readings are, or took a station into one window, against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from weatherglass.operators import clock, forest, history, imputation, normality
from weatherglass.sources import synthetic


def test_sums_of_ranges():
    r = np.random.default_rng(7)
    x = r.integers(0, 9, 500).astype(float) ** 2
    low = r.integers(0, 500, 300)
    high = np.minimum(low + r.integers(0, 400, 300), 500)
    assert history.range_sums(x, low, high).tolist() == [x[a:b].sum() for a, b in zip(low, high)]
    assert history.range_sums(x[:0], low[:0], high[:0]).tolist() == []


def test_clock_meets_readings_by_place(spark):
    rows, stations = synthetic.fleet(spark, 1, 4), synthetic.stations(spark, 1)
    at = clock.instants(rows)
    plan = clock.shift_scores(rows, stations, normality.fit(rows), at)._jdf.queryExecution().optimizedPlan().toString()
    assert "range#" in plan and "day#" not in plan


def test_low_quantile_is_exact(spark):
    r = np.random.default_rng(8)
    scores = {"A": r.normal(0, 1, 6000), "B": r.integers(0, 3, 400).astype(float), "C": np.array([5.0])}
    frame = spark.createDataFrame([(n, float(v)) for n, x in scores.items() for v in x], "station_id string, iforest_score double")
    got = {x.station_id: x.threshold for x in forest.low_quantile(frame, 0.005).collect()}
    assert got == {n: np.sort(x)[max(1, int(np.ceil(len(x) * 0.005))) - 1] for n, x in scores.items()}


def test_last_trusted_in_blocks(spark):
    rows = spark.range(1, 200).select(
        F.lit("A").alias("station_id"), F.col("id").alias("place"), F.col("id").alias("seq"), F.col("id").alias("us"), F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"),
        F.when(F.col("id") % 50 == 0, F.col("id") * 1.0).alias("temperature_c"), F.when(F.col("id") % 7 != 3, F.col("id") * 1.0).alias("pressure_hpa"), F.lit(None).cast("double").alias("humidity_pct"),
        F.when(F.col("id") % 100 == 0, "FAULT").otherwise("VALID").alias("verdict"), F.array(F.lit("temperature_c")).alias("flagged_channels"))
    got = {x.place: x for x in imputation.with_last(rows, 16).collect()}
    for p in range(1, 200):
        x = got[p]
        assert x.last_humidity_pct is None
        assert (x.last_temperature_c and x.last_temperature_c.v) == max((float(k) for k in range(50, p, 50) if k % 100), default=None)
        assert (x.last_pressure_hpa and x.last_pressure_hpa.v) == max((float(k) for k in range(1, p) if k % 7 != 3), default=None)


def test_threshold_of_many_scores_in_parts(spark):
    """As many as make an approximate quantile miss the rank, on which two runs then differ."""
    frame = spark.range(0, 240_000, 1, 24).select(F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("station_id"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("iforest_score"))
    got = {x.station_id: x.threshold for x in forest.low_quantile(frame, 0.005).collect()}
    about = {x.station_id: x.t for x in frame.groupBy("station_id").agg(F.percentile_approx("iforest_score", 0.005, 100_000).alias("t")).collect()}
    scores = frame.toPandas().groupby("station_id").iforest_score
    assert got == {n: np.sort(x)[400 - 1] for n, x in scores} and about != got
