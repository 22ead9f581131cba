"""Streaming gives the verdicts of batch, with late rows judged and restarts that lose nothing."""

import json

from weatherglass.operators import engine, normality
from weatherglass.sources import stream, synthetic
from weatherglass.streaming.processor import Processor


def test_stream_equals_batch(spark, tmp_path):
    rows = synthetic.fleet(spark, 2, 3)
    stations = synthetic.stations(spark, 2)
    models = engine.Models(spark.createDataFrame(normality.fit(synthetic.fleet(spark, 2, 30)).collect(), "station_id string, month int, hour int, channel string, mean double, std double, n long"))
    data = [r.asDict() for r in rows.orderBy("seq", "station_id").collect()]
    data[100], data[104] = data[104], data[100]  # late by two hours
    for k, r in enumerate(data):
        r["seq"] = k
    landing = tmp_path / "in"
    landing.mkdir()

    def land(name, part):
        (landing / name).write_text("\n".join(json.dumps({"station_id": r["station_id"], "seq": r["seq"], "timestamp": r["ts"].isoformat() + "Z", **{c: r[c] for c in ("temperature_c", "pressure_hpa", "humidity_pct")}}) for r in part))

    def go():
        p = Processor(stations, models, str(tmp_path / "out"))
        p.start(stream.read(spark, str(landing)), str(tmp_path / "checkpoint")).awaitTermination()

    land("a.json", data[:90])
    go()
    land("b.json", data[90:])  # after a restart
    go()
    got = {(r.station_id, r.seq): (r.verdict, r.confidence) for r in spark.read.parquet(str(tmp_path / "out/records")).collect()}
    order = spark.createDataFrame([(r["station_id"], r["seq"], r["ts"], r["temperature_c"], r["pressure_hpa"], r["humidity_pct"]) for r in data], "station_id string, seq long, ts timestamp_ntz, temperature_c double, pressure_hpa double, humidity_pct double")
    want = {(r.station_id, r.seq): (r.verdict, r.confidence) for r in engine.judge(order, stations, models).collect()}
    assert got == want and any(v[0] == "SUSPECT" for v in want.values())


def test_faults_last_their_samples_over_batches(spark):
    from weatherglass.streaming.processor import FAULTS, altered

    rows = synthetic.fleet(spark, 2, 1)
    faults = spark.createDataFrame([
        (1, "S0", "frozen", "temperature_c", 5, 0.0), (2, "S0", "dropout", "pressure_hpa", 2, 0.0), (3, "S0", "step", "humidity_pct", 4, 30.0), (4, "S0", "drift", "humidity_pct", 2, 4.0), (5, "S0", "spike", "pressure_hpa", 1, 9.0)], FAULTS)
    progress, out = None, {}
    for first in range(0, 24, 3):  # eight batches
        both = altered(rows.filter(f"seq BETWEEN {first + 2} AND {first + 4}"), faults, progress).collect()
        progress = spark.createDataFrame([(r.station_id, r.fault_id, r.channel, r.applied, r.held) for r in both if r.part == "progress"], "station_id string, fault_id long, channel string, applied long, held double")
        out |= {(r.station_id, r.seq): r for r in both if r.part == "reading"}
    mine = {k: r for (s, k), r in out.items() if s == "S0"}
    assert len({mine[k].temperature_c for k in range(2, 7)}) == 1 and mine[2].temperature_c == mine[2].raw_temperature_c and mine[6].temperature_c != mine[6].raw_temperature_c and mine[7].temperature_c == mine[7].raw_temperature_c
    assert [k for k in mine if mine[k].pressure_hpa is None] == [2, 3] and abs(mine[4].pressure_hpa - mine[4].raw_pressure_hpa - 9) < 1e-9 and mine[5].pressure_hpa == mine[5].raw_pressure_hpa
    assert [round(mine[k].humidity_pct - mine[k].raw_humidity_pct, 6) for k in range(2, 8)] == [32.0, 34.0, 30.0, 30.0, 0.0, 0.0]
    assert all(r.temperature_c == r.raw_temperature_c for (s, _), r in out.items() if s == "S1")


def test_stream_with_faults(spark, tmp_path):
    from weatherglass.streaming.processor import FAULTS

    rows = synthetic.fleet(spark, 1, 2).orderBy("seq").collect()
    landing = tmp_path / "in"
    landing.mkdir()
    faults = spark.createDataFrame([(1, "S0", "dropout", "pressure_hpa", 3, 0.0)], FAULTS)
    for part in range(2):
        (landing / f"{part}.json").write_text("\n".join(json.dumps({"station_id": r.station_id, "seq": r.seq, "timestamp": r.ts.isoformat(), "temperature_c": r.temperature_c, "pressure_hpa": r.pressure_hpa, "humidity_pct": r.humidity_pct}) for r in rows[part * 4 : part * 4 + 4]))
        Processor(synthetic.stations(spark, 1), engine.Models(), str(tmp_path / "out"), faults=faults).start(stream.read(spark, str(landing)), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/records")).orderBy("seq").collect()
    assert [r.seq for r in got if r.pressure_hpa is None] == [0, 1, 2] and [r.seq for r in got if r.verdict == "FAULT"] == [0, 1, 2] and len(got) == 8 and spark.read.parquet(str(tmp_path / 'out/altered')).count() == 3


def test_state_is_that_of_the_batch_s_stations(spark, tmp_path):
    """Long streams in small batches: clock checks, late rows, and stations that are silent for a while."""
    from pyspark.sql import functions as F

    rows = synthetic.fleet(spark, 3, 3)
    stations = synthetic.stations(spark, 3)
    models = engine.Models(spark.createDataFrame(normality.fit(synthetic.fleet(spark, 3, 30)).collect(), "station_id string, month int, hour int, channel string, mean double, std double, n long"))
    late = rows.withColumn("ts", F.when((F.col("station_id") == "S1") & (F.col("seq") > 60), F.col("ts") + F.expr("INTERVAL 5 HOUR")).otherwise(F.col("ts")))
    data = [r.asDict() for r in late.orderBy("seq", "station_id").collect()]
    landing = tmp_path / "in"
    landing.mkdir()
    size = -(-len(data) // 4)
    parts = [data[k : k + size] for k in range(0, len(data), size)]
    for k, part in enumerate(parts):
        own = [r for r in part if r["station_id"] != "S2" or k % 3]  # S2 sends nothing in every third batch
        (landing / f"{k}.json").write_text("\n".join(json.dumps({"station_id": r["station_id"], "seq": r["seq"], "timestamp": r["ts"].isoformat() + "Z", **{c: r[c] for c in ("temperature_c", "pressure_hpa", "humidity_pct")}}) for r in own))
        query = Processor(stations, models, str(tmp_path / "out")).start(stream.read(spark, str(landing)), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["customMetrics"]["rocksdbPutCount"] > 0
    kept = [r for k, part in enumerate(parts) for r in part if r["station_id"] != "S2" or k % 3]
    order = spark.createDataFrame([(r["station_id"], r["seq"], r["ts"], r["temperature_c"], r["pressure_hpa"], r["humidity_pct"]) for r in kept], "station_id string, seq long, ts timestamp_ntz, temperature_c double, pressure_hpa double, humidity_pct double")
    told = "array_join(transform(filter(checks, x -> x.flagged), x -> x.check), ' ') AS checks"
    want = {(r.station_id, r.seq): (r.verdict, r.confidence, r.checks) for r in engine.judge(order, stations, models).selectExpr("station_id", "seq", "verdict", "confidence", told).collect()}
    got = {(r.station_id, r.seq): (r.verdict, r.confidence, r.checks) for r in spark.read.parquet(str(tmp_path / "out/records")).selectExpr("station_id", "seq", "verdict", "confidence", told).collect()}
    assert got == want and any("clock" in v[2] for v in want.values())
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"records"}


class Held:
    """The state of one key in memory."""

    def __init__(self):
        self.rows, self.timers = {}, []

    def getListState(self, name, _):  # noqa: N802
        held = self

        class Rows:
            exists = lambda self: bool(held.rows.get(name))
            get = lambda self: iter(held.rows.get(name, []))
            put = lambda self, rows: held.rows.__setitem__(name, rows)
            clear = lambda self: held.rows.pop(name, None)

        return Rows()

    listTimers = lambda self: iter(list(self.timers))  # noqa: E731, N815
    deleteTimer = lambda self, at: self.timers.remove(at)  # noqa: E731, N815
    registerTimer = lambda self, at: self.timers.append(at)  # noqa: E731, N815


def test_kept_rows_and_timers():
    import pandas as pd

    from weatherglass.streaming.processor import History

    hour, state = 3_600_000_000, Held()
    now = type("Now", (), {"getCurrentProcessingTimeInMs": lambda self: 1000})()
    h = History(4, 3 * hour, {}, 500)
    h.init(state)
    for batch in range(6):
        frame = pd.DataFrame({"seq": [2 * batch, 2 * batch + 1], "us": [2 * batch * hour, (2 * batch + 1) * hour], "temperature_c": [1.0, None], "pressure_hpa": [2.0, 2.0], "humidity_pct": [3.0, 3.0]})
        out = pd.concat(h.handleInputRows(("S0",), iter([frame]), now))
        assert out["fresh"].tolist()[-2:] == [True, True] and out["seq"].tolist() == sorted(out["seq"]) and state.timers == [1500]
    picked = [r[0] for r in state.rows["rows"] if r[-1]]
    assert picked[-1] == 9 and state.rows["rows"][0][0] == 5 and state.rows["rows"][-1][0] == 11  # four rows before the last check stay
    assert list(h.handleExpiredTimer(("S0",), now, None)) == [] and not state.rows
