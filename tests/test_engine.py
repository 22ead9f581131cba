"""Engine operators on hand-made histories, and invariants."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherglass.functions import physics
from weatherglass.operators import checks as C
from weatherglass.operators import coldstart, edge, engine, evaluation, features, forest, health, injection, limits, mahalanobis, normality, studies
from weatherglass.settings import CHANNELS, DEFAULT, Settings, merged
from weatherglass.sources import csv_readings, isd, synthetic

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "station_id string, seq long, ts timestamp_ntz, temperature_c double, pressure_hpa double, humidity_pct double, qc_flag int"


def history(spark, rows, cadence=60.0, station="S1"):
    """rows: (minutes, t, p, h)."""
    data = [(station, k, T0 + dt.timedelta(minutes=m), t, p, h, 0) for k, (m, t, p, h) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame([(station, cadence)], "station_id string, cadence_minutes double")


def flagged(spark, rows, cadence=60.0, s=DEFAULT, cells=None, models=None):
    readings, stations = history(spark, rows, cadence)
    out = engine.judge(readings, stations, models or engine.Models(cells), s)
    last = out.orderBy(F.desc("seq")).first()
    return {c.check: c.severity for c in last.checks if c.flagged}, last


def ramp(n, cadence=60):
    return [(k * cadence, 20 + 0.01 * k, 1000 + 0.01 * k, 50 + 0.01 * k) for k in range(n)]


def test_formulas(spark):
    row = spark.range(1).select(
        physics.dew_point(F.lit(20.0), F.lit(50.0)).alias("td"), physics.dew_point(F.lit(20.0), F.lit(0.0)).alias("none"), physics.wet_bulb(F.lit(20.0), F.lit(50.0)).alias("tw"),
        physics.humidity_from_dew_point(F.lit(20.0), F.lit(20.0)).alias("rh"), physics.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km")).first()
    assert abs(row.td - 9.26) < 0.02 and row.none is None and abs(row.tw - 13.7) < 0.05 and row.rh == 100 and abs(row.km - 111.19) < 0.01


@pytest.mark.parametrize("last, want", [
    ((600, 61.0, 1000.1, 50.1), {"range:temperature_c", "step:temperature_c"}),
    ((600, None, 1000.1, 50.1), {"dropout"}),
    ((540, 20.1, 1000.1, 50.1), {"timestamp"}),
    ((600, 20.1, 1011.0, 50.1), {"step:pressure_hpa"}),
    ((600, 35.0, 1015.0, 50.1), {"step:temperature_c", "step:pressure_hpa", "cojump"}),
    ((1000, 20.1, 1000.1, 50.1), {"gap"}),
    ((600, 20.1, 1000.1, 50.1), set()),
])
def test_checks(spark, last, want):
    found, _ = flagged(spark, [*ramp(10), last])
    assert want <= set(found) and (want or not found)


def test_frozen_and_spike(spark):
    rows = [(k * 60, 20.0, 1000 + 0.1 * k, 50 + 0.1 * k) for k in range(10)]
    found, last = flagged(spark, rows)
    assert found == {"frozen:temperature_c": "hard"} and last.verdict == "FAULT" and last.confidence == 0.95
    wet = [(m, 20.0, p, 100.0) for m, _, p, _ in rows]
    assert flagged(spark, wet)[0] == {"frozen:temperature_c": "soft", "frozen:humidity_pct": "soft"}
    out = ramp(10)
    out[8] = (480, 60.0, *out[8][2:])
    assert "spike:temperature_c" in flagged(spark, out)[0]


def test_noise_is_cancelled_by_trend(spark):
    smooth = [(k * 60, 20 + 2.0 * k, 1000 - 1.5 * k, 50 + 3.0 * k) for k in range(10)]
    assert not [c for c in flagged(spark, smooth)[0] if c.startswith("noise")]
    rough = [(k * 60, 20 + 3.0 * (k % 2), 1000.0 + 0.1 * k, 50 + 0.1 * k) for k in range(10)]
    assert "noise:temperature_c" in flagged(spark, rough)[0]


def test_verdicts(spark):
    calm = ramp(10)
    assert flagged(spark, calm)[1].verdict == "VALID"
    alone = [*calm, (600, 35.0, 1000.1, 50.1)]
    found, last = flagged(spark, alone)
    assert last.verdict == "FAULT" and last.rule == 2 and last.confidence == 0.8
    both = [*calm, (600, 35.0, 1015.0, 50.1)]
    assert flagged(spark, both)[1].verdict == "SUSPECT"
    off = merged(DEFAULT, {"layers": {"physics": False, "health": False, "timing": False, "normality": False}})
    assert flagged(spark, [*calm, (600, None, None, None)], s=off)[1].verdict == "VALID"


def test_limits_only_relax(spark):
    readings, stations = history(spark, [(k * 60, 20.0 + k // 3 % 2, 1000.0 + k % 7, 50.0 + k % 11) for k in range(240)])
    plain = engine.judge(readings, stations, engine.Models(normality.fit(readings)))
    learned = limits.fit(readings, stations)
    both = engine.judge(readings, stations, engine.Models(normality.fit(readings), learned))
    kinds = ("frozen", "noise", "step")
    hard = lambda d: {(r.seq, c.check) for r in d.collect() for c in r.checks if c.flagged and c.kind in kinds and c.severity == "hard"}
    assert hard(both) <= hard(plain)


def test_raw_values_stay(spark):
    rows = synthetic.fleet(spark, 2, 4)
    out = engine.judge(rows, synthetic.stations(spark, 2), engine.Models(normality.fit(rows)))
    pairs = out.alias("a").join(rows.alias("b"), ["station_id", "seq"])
    assert pairs.filter(" or ".join(f"not (a.{c} <=> b.{c})" for c in CHANNELS)).count() == 0 and pairs.count() == rows.count()


def test_clean_series_raise_few_alarms(spark):
    rows = synthetic.fleet(spark, 2, 40)
    stations = synthetic.stations(spark, 2)
    models = engine.train(rows, stations)
    judged = engine.judge(rows, stations, models)
    share = judged.agg(F.avg(F.col("verdict").isin("FAULT", "SUSPECT").cast("double"))).first()[0]
    assert share < 0.1
    plain = features.features(rows, stations, models.cells, models.limits, measure=False)
    checked = C.apply(plain, [c for c in C.all_checks() if c.kind in ("step", "spike", "gap", "timestamp", "cojump")])
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(station_id#\d+, block#\d+L", plan)) == 1  # one serves all windows


def test_forest_separates():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (2000, 8))
    f = forest.Forest.unpacked(forest.Forest.fit(x, 100, 256, 42).packed())
    far = np.full((5, 8), 6.0)
    assert f.score(far).max() < np.quantile(f.score(x), 0.005)
    assert (f.score(x) == forest.Forest.fit(x, 100, 256, 42).score(x)).all()


def test_distance_equals_numpy(spark):
    rows = synthetic.fleet(spark, 1, 20)
    feats = features.features(rows, synthetic.stations(spark, 1), normality.fit(rows), measure=False)
    dep = mahalanobis.departures(feats).filter("usable").select("station_id", "seq", "usable", *mahalanobis.FEATURES).cache()
    x = dep.orderBy("seq").toPandas()[list(mahalanobis.FEATURES)].to_numpy()
    inv = np.linalg.inv(np.cov(x, rowvar=False) + 1e-6 * np.eye(6))
    want = np.einsum("ij,jk,ik->i", x - x.mean(axis=0), inv, x - x.mean(axis=0))
    got = mahalanobis.distances(dep, mahalanobis.fit(dep)).orderBy("seq").toPandas()
    assert np.allclose(got["d2"], want, rtol=1e-6) and abs(got["threshold"][0] - np.quantile(want, 0.995)) < 1e-6 * want.max()


def test_drift_is_found(spark):
    days = [("S1", c, dt.date(2026, 1, 1) + dt.timedelta(days=k), (0.05 * k if c == CHANNELS[0] else 0.0) + 0.1 * math.sin(k * k)) for k in range(60) for c in CHANNELS]
    table = spark.createDataFrame(days, "station_id string, channel string, day date, mean double")
    at = table.select("station_id", "channel", "day")
    found = health.persistent(health.isolated(health.drift(table, at)).filter("drift_z IS NOT NULL")).filter("at = '2026-03-01'")
    by = {r.channel: r for r in found.collect()}
    assert by[CHANNELS[0]].drift_significant and abs(by[CHANNELS[0]].drift_per_day - 0.05) < 0.01 and by[CHANNELS[0]].service_date is not None
    assert not by[CHANNELS[1]].drift_significant
    slopes = [(b - a) / (j - i) for i, (_, _, _, a) in enumerate(days[::3]) for j, (_, _, _, b) in enumerate(days[::3]) if j > i]
    assert abs(by[CHANNELS[0]].drift_per_day - float(np.median(slopes))) < 1e-9


def test_blend(spark):
    cells = lambda rows: spark.createDataFrame(rows, "month int, hour int, channel string, mean double, std double, n long")
    got = coldstart.blend(cells([(1, 0, "t", 10.0, 1.0, 99), (1, 1, "t", 5.0, 1.0, 9)]), cells([(1, 0, "t", 20.0, 2.0, 15), (2, 0, "t", 1.0, 1.0, 12)]))
    by = {(r.month, r.hour): r for r in got.collect()}
    assert by[1, 0].mean == 15 and abs(by[1, 0].std - math.sqrt(0.5 * 4 + 0.5 + 0.25 * 100)) < 1e-12 and by[1, 1].mean == 5 and by[2, 0].n == 12


def test_injection_and_detection(spark):
    rows = synthetic.fleet(spark, 2, 30)
    stations = synthetic.stations(spark, 2)
    lengths = spark.createDataFrame([("S0", 720), ("S1", 720), ("S2", 40), ("S3", 1)], "station_id string, n long")
    plan = injection.make_plan(lengths, 60.0)
    by = {}
    for r in plan.orderBy("start_index").collect():
        by.setdefault(r.station_id, []).append(r)
    assert {r.fault_type: sum(x.fault_type == r.fault_type for x in by["S0"]) for r in by["S0"]} == dict.fromkeys(injection.TYPES, 3) and "S3" not in by and 0 < len(by["S2"]) < 18
    for n, rows_ in ((720, by["S0"]), (720, by["S1"]), (40, by["S2"])):
        assert all(a.end_index + 2 < b.start_index for a, b in zip(rows_, rows_[1:])) and rows_[0].start_index >= 1 and rows_[-1].end_index < n
    assert [tuple(r) for r in by["S0"]] != [("S0", *tuple(r)[1:]) for r in by["S1"]] and plan.collect() == injection.make_plan(lengths, 60.0).collect()
    shifts = injection.make_plan(lengths.filter("n = 720"), 60.0, types=("clock_shift",)).collect()
    assert shifts and all(r.channel == "all" and r.start_index >= 3 for r in shifts)
    plan = plan.filter("station_id IN ('S0', 'S1')")
    faulted = injection.inject(rows, plan, 60.0)
    assert faulted.filter("fault_type IS NULL AND NOT (temperature_c <=> raw_temperature_c)").count() == 0
    assert faulted.filter("fault_type = 'dropout' AND temperature_c IS NOT NULL AND pressure_hpa IS NOT NULL AND humidity_pct IS NOT NULL").count() == 0
    models = engine.Models(normality.fit(rows))
    judge = lambda d: engine.judge(d, stations, models).withColumn("idx", F.row_number().over(features.station()) - 1)
    found = evaluation.detection(plan, judge(faulted.select(*rows.columns)), judge(rows), 60.0)
    shares = {r.fault_type: r.s for r in found.groupBy("fault_type").agg(F.avg(F.col("detected").cast("double")).alias("s")).collect()}
    assert shares["dropout"] == 1 and shares["spike"] == 1 and shares["step"] > 0.5


def test_edge(spark):
    out = edge.minutes(synthetic.device_samples(spark, 70, 20)).orderBy("minute").collect()
    assert len(out) == 70 and "frozen:temperature_c" in out[-1].flags and not out[10].flags and out[48].flags == [] and out[49].flags == ["frozen:temperature_c"]
    few = edge.minutes(synthetic.device_samples(spark, 1).limit(20)).first()
    assert few.temperature_c is None and "few_valid:temperature_c" in few.flags


CSV = "﻿station_id,timestamp,temperature_c,pressure_hpa,humidity_pct,noaa_flag\nA,2026-01-01T00:00:00,1.5,1000,50,0\nA,2026-01-01 01:00:00,NaN,none,,2\nA,2026-01-01 01:00:00,3,1,2,0\n"


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(CSV)
    rows = csv_readings.read(spark, str(path)).orderBy("seq").collect()
    assert [(r.station_id, r.temperature_c, r.pressure_hpa, r.qc_flag) for r in rows] == [("A", 1.5, 1000.0, 0), ("A", None, None, 2), ("A", 3.0, 1.0, 0)]
    assert csv_readings.prepared(csv_readings.read(spark, str(path))).count() == 2
    path.write_text(CSV + "A,2026-01-01 02:00:00,abc,1,2,0\n")
    with pytest.raises(Exception, match="row 4 of .*a.csv"):
        csv_readings.read(spark, str(path)).collect()
    parts = tmp_path / "parts"
    parts.mkdir()
    for k in (2, 1):
        (parts / f"{k}.csv").write_text(CSV.replace("1.5", f"{k}.5"))
    assert [(r.seq, r.temperature_c) for r in csv_readings.read(spark, str(parts)).orderBy("seq").collect()] == [(0, 1.5), (1, None), (2, 3.0), (3, 2.5), (4, None), (5, 3.0)]
    whole = csv_readings.assembled(spark, [f"{parts}/{k}.csv" for k in (2, 1, 7)]).orderBy("seq").collect()
    assert [(r.seq, r.temperature_c) for r in whole] == [(0, 2.5), (1, None)]
    path.write_text("timestamp,temperature_c\n")
    with pytest.raises(ValueError, match="missing"):
        csv_readings.read(spark, str(path), "A")
    with pytest.raises(csv_readings.SealedPath):
        csv_readings.check_path("/data/holdout/a.csv")


RAW = """STATION,DATE,REPORT_TYPE,TMP,DEW,SLP,MA1
1,2020-01-01T00:00:00,FM-15,"+0300,1","+0200,1","99999,9","10100,1,99999,9"
1,2020-01-01T00:30:00,FM-15,"+0310,1","+0200,1","99999,9","10101,1,99999,9"
1,2020-01-01T01:00:00,FM-12,"+0290,1","+0190,1","10110,1","99999,9,99999,9"
1,2020-01-01T02:00:00,FM-15,"+9999,9","+0200,1","99999,9","10102,1,99999,9"
1,2020-01-01T03:00:00,FM-15,"-0010,3","-0020,2","99999,9","10103,1,99999,9"
1,2020-01-01T03:00:00,FM-15,"-0015,1","-0020,1","99999,9","10103,1,99999,9"
"""


def test_surface_reports(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(RAW)
    found = isd.reports(spark, str(path))
    metar = isd.series(found, "metar").orderBy("ts").collect()
    assert [(r.temperature_c, r.pressure_hpa, r.qc_flag) for r in metar] == [(30.0, 1010.0, 0), (-1.0, 1010.3, 2)]
    assert isd.series(found, "synop").first().pressure_hpa == 1011.0
    year = tmp_path / "2020"
    year.mkdir()
    (year / "1.csv").write_text(RAW)
    assert isd.years(spark, str(tmp_path), "1", [2019, 2020], "metar").count() == 2 and isd.years(spark, str(tmp_path), "1", [2019], "metar").count() == 0
    often = spark.createDataFrame([("1", T0 + dt.timedelta(minutes=m), m) for m in (0, 1, 4, 5, 6, 11, 40, 44, 45)], "station_id string, ts timestamp_ntz, place int")
    assert sorted(r.place for r in isd.apart(often).collect()) == [0, 5, 11, 40, 45]
    assert isd.series(found, "metar", 30).count() == 3 and isd.series(found, "metar", any_minute=True).count() == 3


def test_settings():
    s = merged(Settings(), {"step": {"cap": {"temperature_c": 12.0}}, "layers": {"impute": False}})
    assert s.step.cap["temperature_c"] == 12 and s.step.cap["pressure_hpa"] == 10 and not s.layers.impute
    with pytest.raises(ValueError):
        merged(Settings(), {"nothing": 1})
    assert DEFAULT.history_rows(60.0) == 15 and DEFAULT.history_rows(60.0, clock=True) == 33


def test_learned_resolution(spark):
    values = [("S", float(k % 60 - 20), 1000 + k % 9 / 10, math.sqrt(k + 2)) for k in range(180)]
    rows = spark.createDataFrame(values, "station_id string, temperature_c double, pressure_hpa double, humidity_pct double")
    got = {r.channel: r.resolution for r in limits.resolution(rows).collect()}
    assert got == {"temperature_c": 1.0, "pressure_hpa": 0.1, "humidity_pct": None}


def test_checks_are_named_in_order():
    kinds = [c.kind + (f":{c.channel}" if c.channel else "") for c in C.all_checks(with_clock=True, models=[forest.check(), mahalanobis.check()])]
    each = [f"{k}:{c}" for c in CHANNELS for k in ("frozen", "step", "spike", "noise", "drift")]
    assert kinds == [*(f"range:{c}" for c in CHANNELS), "dew_point", "wet_bulb", "timestamp", "dropout", "gap", "limits", *each, "clock", "cojump", *(f"normality:{c}" for c in CHANNELS), "isolation_forest", "mahalanobis"]


LIMITS = "station_id string, cadence_minutes double, channel string, resolution double, frozen_minutes double, noise_std double, typical_step double, step_cap double, n_runs long"


def test_long_learned_windows_reach_far_back(spark):
    rows = [(k * 30, 20.0, 1000 + 0.1 * k, 50 + 0.1 * (k % 7)) for k in range(400)]
    readings, stations = history(spark, rows, 30.0)
    learned = spark.createDataFrame([("S1", 30.0, c, None, 1170.0, 9.0, None, None, 40) for c in CHANNELS], LIMITS)
    out = engine.judge(readings, stations, engine.Models(None, learned)).select("seq", F.explode(F.filter("checks", lambda x: x["flagged"])).alias("x")).filter("x.kind = 'frozen'").orderBy("seq").collect()
    soft, hard = ([r.seq for r in out if r.x.severity == s] for s in ("soft", "hard"))
    assert soft == list(range(39, 78)) and hard == list(range(78, 400)) and {r.x.channel for r in out} == {"temperature_c"}


def test_blocks_change_nothing(spark):
    rows, stations = synthetic.fleet(spark, 2, 30, 30.0), synthetic.stations(spark, 2, 30.0)
    cells = normality.fit(rows)
    checked = [features.features(rows, stations, cells, block_rows=n).drop("place").orderBy("station_id", "seq").collect() for n in (100_000, 300)]
    assert checked[0] == checked[1] and len(checked[0]) == 2880
    noise = [limits.noise_estimates(rows, stations, block_rows=n).orderBy("station_id", "channel", "seq").collect() for n in (100_000, 300)]
    assert noise[0] == noise[1] and noise[0]


def test_dense_stations_have_noise_limits(spark):
    rows = [(k / 4, 20 + 0.1 * (k % 2), 1000.0 + 0.1 * (k % 3), 50 + 0.5 * (k % 5)) for k in range(900)]
    readings, _ = history(spark, rows)
    stations = spark.createDataFrame([("S1", 0.25)], "station_id string, cadence_minutes double")
    got = {(r.channel, r.seq): r.jitter for r in limits.noise_estimates(readings, stations).collect()}
    t = np.array([r[1] for r in rows])
    for k in (6, 119, 120, 500, 899):
        part = t[max(0, k - 120) : k + 1]
        assert abs(got["temperature_c", k] - np.sqrt(np.mean(np.diff(part, 2) ** 2) / 6)) < 1e-9


def test_wrong_clock_is_flagged(spark):
    rows, stations = synthetic.fleet(spark, 1, 40), synthetic.stations(spark, 1)
    models = engine.Models(normality.fit(rows))
    late = rows.withColumn("ts", F.when(F.col("seq") >= 600, F.col("ts") + F.expr("INTERVAL 4 HOUR")).otherwise(F.col("ts")))
    flags = {r.seq for r in engine.judge(late, stations, models).filter(F.exists("checks", lambda x: x["flagged"] & (x["kind"] == "clock"))).select("seq").collect()}
    assert not [k for k in flags if k < 600] and len([k for k in flags if k >= 640]) > 100


def test_all_layers(spark):
    rows, stations = synthetic.fleet(spark, 2, 40), synthetic.stations(spark, 2)
    models = engine.train(rows, stations)
    odd = rows.withColumn("humidity_pct", F.when(F.col("seq").isin(900, 930), F.lit(2.0)).otherwise(F.col("humidity_pct")))
    odd = odd.withColumns({c: F.when(F.col("seq") == 930, F.col(c) + x).otherwise(F.col(c)) for c, x in (("temperature_c", 30.0), ("pressure_hpa", -60.0))})
    out = engine.judge(odd, stations, models)
    found = {q: {c.kind for r in out.filter(f"seq = {q}").collect() for c in r.checks if c.flagged} for q in (900, 930)}
    assert "mahalanobis" in found[900] and {"mahalanobis", "isolation_forest"} <= found[930] and out.count() == rows.count()
    told = mahalanobis.explain_latest(mahalanobis.departures(features.features(odd.filter("seq <= 900"), stations, models.cells, measure=False)), models.distance, "S1", 900, models.forest).first()
    assert told.available and told.far and told.rare is not None and "humidity" in told.contributions[0].feature
    assert abs(sum(x.value for x in told.contributions) - told.distance2) < 0.01
    small, forest.BROADCAST_BYTES = forest.BROADCAST_BYTES, 0
    try:
        rated = mahalanobis.rates(features.features(rows, stations, models.cells, measure=False))
        met = {(r.station_id, r.seq): r.iforest_score for r in forest.score(rated, models.forest).collect()}
    finally:
        forest.BROADCAST_BYTES = small
    assert met == {(r.station_id, r.seq): r.iforest_score for r in forest.score(rated, models.forest).collect()} and len(met) == 2 * 959


def test_nearest_over_any_distance(spark):
    r = np.random.default_rng(3)
    where = [(f"s{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(r.uniform(-89, 89, 60), r.uniform(-180, 180, 60)))]
    got = {(x.station_id, x.rank): x.other for x in coldstart.nearest(spark.createDataFrame(where, "station_id string, lat double, lon double"), 2, 300.0).collect()}

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))

    assert got == {(a[0], k + 1): n for a in where for k, (_, n) in enumerate(sorted((km(a, b), b[0]) for b in where if b is not a)[:2])}


def test_decision_rules(spark):
    names = "system string, clean_n long, clean_alarm long, event_n long, event_fault long, event_suspect long, windows_with_fault long, windows long"
    systems = spark.createDataFrame([("full", 1000, 20, 100, 5, 1, 3, 9), ("better", 1000, 20, 100, 4, 1, 2, 9), ("noisy", 1000, 30, 100, 4, 1, 2, 9), ("blind", 1000, 10, 100, 0, 1, 0, 9), ("more", 1000, 20, 100, 6, 1, 4, 9), ("none", 0, 0, 0, 0, 0, 0, 0)], names)
    types = spark.createDataFrame([(s, t, 50, 50 - 5 * (s == "blind")) for s in ("full", "better", "noisy", "blind", "more", "none") for t in ("spike", "step")], "system string, fault_type string, injected long, detected_new long")
    got = {r.system: r for r in studies.decisions(systems, types).collect()}
    assert {k: r.adopt for k, r in got.items()} == {"better": True, "noisy": False, "blind": False, "more": False, "none": False}
    assert got["blind"].worst_change == -10 and got["blind"].worst_type == "spike" and abs(got["noisy"].clean_rise - 1) < 1e-9
    assert not {r.system: r for r in studies.decisions(systems, types, "offset").collect()}["better"].adopt
    weak = {r.system: r for r in studies.tradeoff(systems, types).collect()}
    assert weak["blind"].weakest_percent == 90 and weak["full"].clean_alarm_percent == 2
    assert studies.detection_table(types, ("spike", "step")).filter("system = 'blind'").first().step == 90


def test_drift_power(spark):
    rows = [("S1", 0, T0 + dt.timedelta(hours=h), *(v + 0.2 * math.sin(h * h + i) for i, v in enumerate((20.0, 1000.0, 50.0))), *(20.0, 1000.0, 50.0), 1.0, 1.0, 1.0) for h in range(24 * 60)]
    frame = spark.createDataFrame(rows, "station_id string, chunk int, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in (*CHANNELS, *(f"smooth_{c}" for c in CHANNELS), *(f"s_{c}" for c in CHANNELS))))
    got = {(r.channel, r.severity): r for r in studies.drift_power(frame, spark.createDataFrame([("S1", 60.0)], "station_id string, cadence_minutes double"), start_day=21, ramp_days=20, least_days=50, severities=(4.0,)).collect()}
    assert len(got) == 6 and all(r.trials == 1 for r in got.values())
    assert got["temperature_c", 4.0].detected == 1 and got["temperature_c", 0.0].detected == 0 and 0 < got["temperature_c", 4.0].median_days < 39


def test_cold_start_table(spark):
    rows = spark.createDataFrame([(0, m, s, v, e) for m, s, v, e in [("starter", "A", "VALID", None), ("starter", "A", "SUSPECT", None), ("starter", "B", "WEATHER", 1), ("own_only", "A", "FAULT", None)]], "days int, mode string, station_id string, verdict string, event int")
    found = spark.createDataFrame([(0, "starter", True), (0, "starter", False)], "days int, mode string, detected_new boolean")
    got = {r["mode"]: r for r in studies.cold_start(rows, found).collect()}
    assert (got["starter"].clean_alarm_pct, got["starter"].event_weather_pct, got["starter"].detect_pct, got["starter"].stations) == (50.0, 100.0, 50.0, 2)
    assert got["own_only"].clean_fault_pct == 100 and got["own_only"].event_fault_pct is None


def test_peer_trials(spark):
    hours = 24 * 60
    own = [("A", "pressure_hpa", h, math.sin(h / 50)) for h in range(hours)]
    diffs = [("A", "pressure_hpa", h, 0.1 * math.sin(h * h)) for h in range(hours)]
    anomalies, differences = (spark.createDataFrame(x, f"station_id string, channel string, hour long, {n} double") for x, n in ((own, "anomaly"), (diffs, "difference")))
    limits_ = spark.createDataFrame([("A", "pressure_hpa", "own", 1.5), ("A", "pressure_hpa", "peer", 0.2)], "station_id string, channel string, mode string, threshold double")
    plan = spark.createDataFrame([(k, "A", "pressure_hpa", m, kind, 1.0, 400, 720) for k, (m, kind) in enumerate([("own", "offset"), ("peer", "offset"), ("peer", "drift")])], "trial int, station_id string, channel string, mode string, kind string, size double, first_hour long, hours long")
    got = {(r["mode"], r.kind): r for r in studies.peer_trials(anomalies, differences, limits_, plan).collect()}
    assert got["peer", "offset"].detected and got["peer", "drift"].detected and got["peer", "drift"].days > got["peer", "offset"].days and not got["own", "offset"].detected
    assert studies.peer_summary(studies.peer_trials(anomalies, differences, limits_, plan)).filter("mode = 'peer'").count() == 2


def test_runs_are_compared_by_path(spark):
    kind = "id int, x struct<a: double, b: array<struct<c: string, d: double>>, m: map<string, int>, t: string>, when_ string, n long"
    one = [(1, (1.0, [("p", 1.0), ("q", None)], {"k": 1}, None), "now", 5), (2, None, "now", 6), (3, (float("nan"), [], {}, "x"), "now", 7), (5, (0.0, None, None, ""), "now", 8)]
    two = [(1, (1.0 + 1e-12, [("p", 1.5)], {"k": 1, "l": 2}, None), "later", 5), (2, None, "later", 9), (3, (float("nan"), [], {}, "x"), "later", 7), (4, (1.0, [], {}, "y"), "later", 1)]
    a, b = spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)
    got = {(r.id, r.path): (r.a, r.b, r.what) for r in evaluation.run_differences(a, b, ["id"], ignore=("when_",)).collect()}
    missing = {(5, p) for p in ("/x/a", "/x/b", "/x/m", "/x/t", "/n")}
    assert {k for k, v in got.items() if v[2] == "missing"} == missing | {(1, "/x/b[1]/c"), (1, "/x/b[1]/d")}
    assert {k: v for k, v in got.items() if v[2] == "changed"} == {(1, "/x/b"): ("2.0", "1.0", "changed"), (1, "/x/b[0]/d"): ("1.0", "1.5", "changed"), (2, "/n"): ("6.0", "9.0", "changed")}
    more = {(r.id, r.path) for r in evaluation.run_differences(a, b, ["id"], ignore=("when_",), added=True).collect() if r.what == "added"}
    assert (1, "/x/m{l}") in more and (4, "/x/t") in more and evaluation.run_differences(a, a, ["id"]).count() == 0


def greedy(times, step):
    kept, last = [], None
    for at, us in enumerate(times):
        if us is not None and (last is None or us >= last + step or us < last):
            kept.append(at)
            last = us
    return kept


def test_throttle_kernels_against_the_rule():
    from weatherglass.operators import throttle

    draw = np.random.default_rng(5)
    for trial in range(300):
        n, step = int(draw.integers(2, 60)), int(draw.integers(1, 40))
        us = draw.integers(-30, 60, n) if trial % 3 else np.cumsum(draw.integers(-3, 9, n))
        want = [next((j for j in range(i + 1, n) if us[j] >= us[i] + step or us[j] < us[i]), n) for i in range(n)]
        assert throttle.next_picks(us, step).tolist() == want
        cut = int(draw.integers(1, n))
        before = greedy(us[:cut].tolist(), step)
        ends, exits = throttle.summary(us[cut:], int(us[cut - 1]), step)
        found = exits[np.searchsorted(ends, us[before[-1]])]
        assert (us[before[-1]] if found == throttle.NONE else found) == us[greedy(us.tolist(), step)[-1]]
        assert len(ends) <= 2 * (n - cut) + 1


@pytest.mark.parametrize("block_rows", [1, 7, 50, 100_000])
def test_throttle_is_the_same_in_any_blocks(spark, block_rows):
    import pandas as pd

    from weatherglass.operators import throttle

    draw = np.random.default_rng(block_rows)
    series = {
        "even": np.arange(400) * 30, "hot": np.cumsum(draw.integers(0, 40, 900)), "back": np.cumsum(draw.integers(-60, 90, 300)), "random": draw.integers(0, 5_000, 200),
        "down": np.arange(50) * -20, "still": np.zeros(40, int), "one": np.array([5])}
    rows = [(name, k, int(m) if k % 17 != 3 else None) for name, minutes in series.items() for k, m in enumerate(minutes)]
    frame = pd.DataFrame(rows, columns=["station_id", "seq", "m"]).sample(frac=1, random_state=1)
    readings = spark.createDataFrame(frame.astype({"m": "Int64"}).astype(object).where(frame.m.notna(), None), "station_id string, seq long, m long").selectExpr(
        "station_id", "seq", "timestampadd(MINUTE, m, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts", "1 AS block", "2 AS place", "3 AS last")
    got = sorted((r.station_id, r.seq) for r in throttle.picks(readings, 180 * 60_000_000, block_rows).collect())
    want = sorted((name, k) for name in series for k in greedy([m for n, _, m in rows if n == name], 180))
    assert got == want
    assert throttle.picks(readings.limit(0), 1, block_rows).count() == 0


def test_learned_limits_are_the_same_in_any_blocks(spark):
    import pandas as pd

    draw = np.random.default_rng(3)
    rows, want = [], {}
    for name, n in (("S1", 700), ("S2", 90), ("S3", 2)):
        at = np.cumsum(draw.choice([60, 60, 60, 60, 400, -120], n))
        level = np.repeat(draw.integers(0, 4, n), draw.integers(1, 25, n))[:n].astype(float)
        level = np.where(draw.random(n) < 0.03, np.nan, level)
        runs, begun = [], None
        for k in range(n):
            joined = begun is not None and not np.isnan(level[k]) and level[k] == level[k - 1] and at[k] - at[k - 1] <= DEFAULT.gap_multiplier * 60
            if not joined:
                begun = len(runs)
                runs.append([])
            runs[begun].append(k)
        want[name] = sorted((int(at[r].min()), len(r), float(at[r].max() - at[r].min())) for r in map(np.array, runs) if len(r) > 1 and not np.isnan(level[r[0]]))
        rows += [(name, k, T0 + dt.timedelta(minutes=int(at[k])), None if np.isnan(level[k]) else float(level[k]), 1000.0, float(k % 5), 0) for k in range(n)]
    readings = spark.createDataFrame(rows, SCHEMA)
    stations = spark.createDataFrame([(x, 60.0) for x in want], "station_id string, cadence_minutes double")
    start = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    whole = {}
    for block_rows in (1, 9, 100_000):
        for name in want:
            got = limits.runs(readings, stations, block_rows=block_rows).filter((F.col("station_id") == name) & (F.col("channel") == CHANNELS[0])).collect()
            assert sorted(((r.start_us - start) // 60_000_000, r.n, r.minutes) for r in got) == want[name]
        found = {
            "steps": limits.steps(readings, stations, block_rows=block_rows).select("station_id", "channel", "dt", "change"), "cadence": limits.cadence(readings, block_rows),
            "running": limits.running_cadence(readings, block_rows=block_rows).select("station_id", "seq", "running_cadence"), "learn": limits.learn(readings, stations.limit(0), min_days=1.0, block_rows=block_rows)[1].select("station_id", "seq", "lead")}
        for name, frame in found.items():
            table = frame.toPandas()
            table = table.sort_values(list(table.columns)).reset_index(drop=True)
            pd.testing.assert_frame_equal(table, whole.setdefault(name, table))
    assert len(whole["learn"]) and set(whole["cadence"].cadence_minutes) == {60.0}


def test_what_a_new_station_borrows(spark):
    from weatherglass.operators import starting

    draw = np.random.default_rng(8)
    names = [f"S{k}" for k in range(5)]
    cells = [(n, 1, h, c, float(1000 + draw.normal()), float(draw.random()), int(draw.integers(10, 99))) for n in names for h in range(3) for c in CHANNELS if draw.random() < 0.7]
    known = [(n, c, draw.choice([None, 0.1, 1.0]), float(draw.choice([0.0, 60.0, 90.0])), None if n == "S2" else float(draw.random()), float(draw.random())) for n in names for c in CHANNELS]
    table = spark.createDataFrame(cells, "station_id string, month int, hour int, channel string, mean double, std double, n long")
    limits_ = spark.createDataFrame([(a, b, None if r is None else float(r), *rest) for a, b, r, *rest in known], "station_id string, channel string, resolution double, frozen_minutes double, noise_std double, typical_step double")
    stations = spark.createDataFrame([(n, 60.0) for n in names], "station_id string, cadence_minutes double")
    pairs = {None: [(a, b) for a in names for b in names if a != b], "near": [("S0", "S3"), ("S1", "S0"), ("S1", "S4")]}
    for borrow in (None, "near"):
        frame = borrow and spark.createDataFrame(pairs[borrow], "station_id string, other string")
        got = {(r.station_id, r.hour, r.channel): (r["mean"], r["std"], r.n) for r in starting.borrowed_cells(table, stations, frame).collect()}
        want = {}
        for a in names:
            for h in range(3):
                for c in CHANNELS:
                    part = [x for x in cells if (a, x[0]) in pairs[borrow] and x[2:4] == (h, c)]
                    if part:
                        m = np.mean([x[4] for x in part])
                        want[a, h, c] = (m, np.sqrt(np.mean([x[5] ** 2 + (x[4] - m) ** 2 for x in part])), sum(x[6] for x in part))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
        got = {(r.station_id, r.channel): (r.resolution, r.frozen_minutes, r.noise_std, r.typical_step) for r in starting.borrowed_limits(limits_, stations, frame).collect()}
        for (a, c), values in got.items():
            for i, value in enumerate(values):
                part = [x[2 + i] for x in known if (a, x[0]) in pairs[borrow] and x[1] == c and x[2 + i]]
                expected = (max(part) if i == 0 else np.mean(part)) if part else None
                assert value == (None if expected is None else pytest.approx(float(expected)))
        assert len(got) == len({a for a, _ in pairs[borrow]}) * 3


def test_scenarios_learn_from_their_days_only(spark):
    from weatherglass.operators import starting

    draw = np.random.default_rng(2)
    rows = [(n, k, T0 + dt.timedelta(hours=k), float(10 + j + 5 * np.sin(k / 24 * 6.28) + draw.normal(0, 0.3)), float(1000 + draw.normal()), float(50 + 3 * draw.normal()), 0) for j, n in enumerate(("A", "B", "C")) for k in range(24 * 100)]
    readings = spark.createDataFrame(rows, SCHEMA)
    stations = spark.createDataFrame([(n, 60.0) for n in "ABC"], "station_id string, cadence_minutes double")
    days = (0, 20, 95)
    known = starting.models(readings, stations, normality.fit(readings), limits.fit(readings, stations), days)
    assert {r[0] for r in known.cells.select("station_id").distinct().collect()} == {f"{n}|{d}|{m}" for n in "ABC" for d in days for m in starting.MODES} - {f"{n}|0|own_only" for n in "ABC"}
    own = {(r.channel, r.month, r.hour): r["mean"] for r in known.cells.filter("station_id = 'A|20|own_only'").collect()}
    direct = {(r.channel, r.month, r.hour): r["mean"] for r in normality.fit(readings.filter("station_id = 'A' AND seq < 480")).collect()}
    assert own == pytest.approx(direct)
    # The forest and the distance learn only from long histories.
    assert {r[0].split("|")[1] for r in known.distance.select("station_id").collect()} == {r[0].split("|")[1] for r in known.forest.select("station_id").collect()} == {"95"}
    found = starting.judged(readings.filter("seq >= 2350"), stations, known, days)
    counts = {(r.days, r["mode"]): r["count"] for r in found.groupBy("days", "mode").count().collect()}
    assert counts == {(d, m): 150 for d in days for m in starting.MODES} and set(found.columns) >= {"station_id", "scenario", "verdict"}
