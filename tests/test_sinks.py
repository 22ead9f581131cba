"""Records, models, series and logs are read back as they were written."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weatherglass.operators import engine, injection
from weatherglass.sinks import files, models, records, series
from weatherglass.sources import catalogs, csv_readings, synthetic


@pytest.fixture(scope="module")
def trained(spark):
    rows, stations = synthetic.fleet(spark, 2, 30), synthetic.stations(spark, 2)
    return rows, stations, engine.train(rows, stations)


def test_records(spark, trained, tmp_path):
    rows, stations, known = trained
    folder = str(tmp_path / "records")
    judged = engine.records(engine.judge(rows.filter("seq < 100"), stations, known))
    for k in range(2):
        records.append(judged.filter(F.col("seq") % 2 == k), folder)
    assert records.read(spark, folder).select(*judged.columns).exceptAll(judged).count() == 0 and records.read(spark, folder).count() == 200
    judged.limit(1).withColumn("note", F.lit("x")).withColumn("day", F.lit(dt.date(2030, 1, 1))).write.mode("append").partitionBy("day").parquet(folder)
    assert "note" in records.read(spark, folder).columns
    wanted = spark.createDataFrame([], "later double")
    assert records.read(spark, folder, wanted).filter("later IS NOT NULL").count() == 0
    assert records.purge(spark, folder, dt.datetime(2026, 1, 3, 12)) == 120
    left = records.read(spark, folder)
    assert left.count() == 81 and left.filter("day < '2030-01-01'").agg(F.min("ts")).first()[0] == dt.datetime(2026, 1, 3, 12)
    assert records.purge(spark, str(tmp_path / "nothing"), dt.datetime(2026, 1, 1)) == 0


@pytest.mark.parametrize("step", ["write_text", "remove", "moved"])
def test_a_purge_that_ends_halfway_loses_nothing(spark, tmp_path, monkeypatch, step):
    folder, cutoff = str(tmp_path / "records"), dt.datetime(2026, 1, 2, 6)
    rows = synthetic.fleet(spark, 1, 3).select("station_id", "seq", "ts", F.to_date("ts").alias("day")).repartition(3)
    records.append(rows, folder)
    want = sorted(r.seq for r in rows.filter(F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz")).collect())
    calls = []

    def broken(*args):
        calls.append(args)
        if len(calls) > (step == "remove"):  # the second file that goes
            raise KeyboardInterrupt
        return getattr(files, step)(*args)

    monkeypatch.setattr(records, step, broken)
    with pytest.raises(KeyboardInterrupt):
        records.purge(spark, folder, cutoff)
    monkeypatch.undo()
    spark.catalog.clearCache()
    left = sorted(r.seq for r in records.read(spark, folder).filter(F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz")).collect())
    assert left == want
    records.purge(spark, folder, cutoff)
    assert sorted(r.seq for r in records.read(spark, folder).collect()) == want and not files.exists(spark, f"{folder}.purge")


def test_models(spark, trained, tmp_path):
    rows, stations, known = trained
    folder = str(tmp_path / "models")
    models.save(known, folder)
    back = models.load(spark, folder)
    for kind in models.KINDS:
        a, b = getattr(known, kind), getattr(back, kind)
        assert b.select(*a.columns).exceptAll(a).count() == 0 and b.count() == a.count()
    assert models.load(spark, folder, ["S1"]).limits.select("station_id").distinct().collect()[0][0] == "S1"
    assert models.load(spark, str(tmp_path / "none")).cells is None
    prints = {(r.station_id, r.kind): r.fingerprint for r in models.fingerprints(spark, folder).collect()}
    assert len(prints) == 8 and all(len(x) == 12 for x in prints.values())
    models.save(engine.Models(limits=known.limits.filter("station_id = 'S1'").withColumn("noise_std", F.lit(5.0))), folder)
    again = {(r.station_id, r.kind): r.fingerprint for r in models.fingerprints(spark, folder).collect()}
    assert {k for k in prints if prints[k] != again[k]} == {("S1", "limits")}


def test_series_and_logs(spark, trained, tmp_path):
    rows, _, _ = trained
    series.write_csv(rows, str(tmp_path / "csv"), "2026-01-11 00:00:00")
    back = csv_readings.read(spark, str(tmp_path / "csv/station_id=S1/split=future"), "S1")
    assert back.count() == 480 and back.agg(F.min("ts")).first()[0] == dt.datetime(2026, 1, 11)
    plan = injection.make_plan(rows.groupBy("station_id").agg(F.count("*").alias("n")), 60.0)
    log = series.fault_log(injection.inject(rows, plan, 60.0), plan)
    series.write_json(log, str(tmp_path / "log"))
    told = [json.loads(x) for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    assert len(told) == plan.count() and all(("sign" in x["params"]) == (x["fault_type"] in ("spike", "step", "drift")) for x in told)


def test_names_and_catalogues(spark, tmp_path):
    names = ["a b.csv", "..\\x/../etc/pass wd", "", "C:\\data\\é.CSV", ".hidden"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(files.safe_name(F.col("n"))).collect()]
    assert got == ["a_b.csv", "pass_wd.csv", "upload.csv", "_.CSV", "hidden.csv"]
    (tmp_path / "s.yaml").write_text("stations:\n  A: {lat: 1.5, lon: 2, climate_zone: dry, cadence_minutes: 60}\n  B: {}\n")
    assert [tuple(r) for r in catalogs.stations(spark, str(tmp_path / "s.yaml")).orderBy("station_id").collect()] == [("A", 1.5, 2.0, "dry", 60.0), ("B", None, None, None, None)]
    (tmp_path / "e.json").write_text(json.dumps({"events": {"A": [{"kind": "low", "center": "2020-01-02T00:00:00", "start": "2020-01-01T00:00:00", "end": "2020-01-03T00:00:00", "score": 12.5}]}}, indent=1))
    row = catalogs.weather_windows(spark, str(tmp_path / "e.json")).first()
    assert (row.station_id, row.kind, row.start, row.score) == ("A", "low", dt.datetime(2020, 1, 1), 12.5)
