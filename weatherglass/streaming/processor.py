"""Live readings: keyed state per station, faults armed on coming readings, verdicts of each batch by the batch operators.

What a station's next readings need to be judged is its state: its last rows, those before its last clock check included, and
how far each armed fault has come. It lives in the state store (RocksDB) under the station's key, so that a batch reads and
writes the state of its own stations only. The stateful operator puts a station's kept rows before its new ones; each
micro-batch of both is judged by the same operators as history, and the records of the new ones are written. So streaming and
batch give the same verdicts on the same arrival order, and a late reading is judged, not dropped. A batch that is repeated
after a failure finds the state of the batch before it. Stations that send nothing for a set time are forgotten by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.core import importable, micros, stored
from ..operators import clock, engine, features
from ..settings import CHANNELS, DEFAULT, Settings

READING = ("station_id", "seq", "ts", *CHANNELS)
FAULTS = "fault_id long, station_id string, fault_type string, channel string, samples long, magnitude double"
#: A fault's progress; without a fault_id, the last unaltered value of a channel.
PROGRESS = "station_id string, fault_id long, channel string, applied long, held double"
#: Most faults that can be armed at once: their definitions go to all tasks.
MOST_FAULTS = 100_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Armed:
    """The faults of one station and what they have come to."""

    def __init__(self, faults: list[tuple], held: dict[str, float], seed: int = 42):
        """faults: (fault_id, kind, channel, samples, magnitude, applied, held value), in the order of fault_id."""
        self.faults, self.last, self.seed = [list(f) for f in sorted(faults)], dict(held), seed

    def apply(self, seq: int, values: dict[str, float]) -> dict[str, float]:
        """A reading's values (nan where missing) as the failing sensors would have sent them. Each fault acts on the next
        `samples` readings that it can alter: frozen holds the last unaltered value before it, spike and step add, drift grows,
        noise adds draws, dropout removes; what is missing stays missing."""
        out = dict(values)
        for f in self.faults:
            number, kind, channel, samples, size, applied, held = f
            now = out[channel]
            if applied >= samples or np.isnan(now) and kind != "dropout":
                continue
            if kind == "frozen" and np.isnan(held):
                f[6] = held = self.last.get(channel, now)
            draw = np.random.default_rng([self.seed, number, int(seq) & 0xFFFFFFFF]).normal(0.0, abs(size)) if kind == "noise" else 0.0
            out[channel] = {"frozen": held, "spike": now + size, "step": now + size, "drift": now + size * (applied + 1) / samples, "noise": now + draw, "dropout": np.nan}[kind]
            f[5] = applied + 1
        self.last |= {c: x for c, x in values.items() if not np.isnan(x)}
        return out


def altered(readings: DataFrame, faults: DataFrame, progress: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """readings as failing sensors would have sent them (see Armed), and the faults' progress: rows with part "reading" (raw
    values kept as raw_<channel>) and rows with part "progress" (columns of PROGRESS). A station's rows are one group."""
    raw = [f"raw_{c}" for c in CHANNELS]
    kinds = "part string, station_id string, seq long, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in (*CHANNELS, *raw)) + ", fault_id long, channel string, applied long, held double"
    names = [x.split()[0] for x in kinds.split(", ")]

    def one(key, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        own = known[known["fault_id"].notna()]
        armed = Armed([(int(r.fault_id), r.fault_type, r.channel, int(r.samples), r.magnitude, int(r.applied), r.held) for r in own.itertuples()], {r.channel: r.held for r in known[known["fault_id"].isna()].itertuples()}, seed)
        out = rows.assign(part="reading", **{f"raw_{c}": rows[c] for c in CHANNELS})
        told = [armed.apply(q, dict(zip(CHANNELS, v, strict=True))) for q, v in zip(rows["seq"], rows[list(CHANNELS)].to_numpy(np.float64, na_value=np.nan).tolist(), strict=True)]
        state = [(key[0], f[0], f[2], f[5], f[6]) for f in armed.faults] + [(key[0], None, c, None, x) for c, x in armed.last.items()]
        more = pd.DataFrame(state, columns=["station_id", "fault_id", "channel", "applied", "held"]).astype({"fault_id": "Int64", "applied": "Int64"}).assign(part="progress")
        return pd.concat([out.assign(**{c: [t[c] for t in told] for c in CHANNELS}), more], ignore_index=True).reindex(columns=names)

    if progress is None:
        progress = readings.sparkSession.createDataFrame([], PROGRESS)
    known = faults.join(progress.filter("fault_id IS NOT NULL").select("station_id", "fault_id", "applied", "held"), ["station_id", "fault_id"], "left")
    known = known.withColumn("applied", F.coalesce("applied", F.lit(0))).unionByName(progress.filter("fault_id IS NULL"), allowMissingColumns=True)
    return importable(readings).select(*READING).groupBy("station_id").cogroup(known.groupBy("station_id")).applyInPandas(one, kinds)


ROWS = "seq long, us long, " + ", ".join(f"{c} double" for c in CHANNELS) + ", picked boolean"
#: What the stateful operator puts out: kept and new rows, which of them ask for a clock check, and the values as they came.
EMITTED = "station_id string, seq long, us long, " + ", ".join(f"{c} double" for c in CHANNELS) + ", picked boolean, fresh boolean, " + ", ".join(f"raw_{c} double" for c in CHANNELS)


class History(StatefulProcessor):
    """Keeps each station's last rows, and puts them before its new ones. rows: how many a reading needs at most; a clock check
    needs as many before it, so that those are kept from the last one on. every: microseconds between clock checks."""

    def __init__(self, rows: int, every: int, faults: dict[str, list[tuple]], expire_ms: int | None):
        self.rows, self.every, self.armed, self.expire_ms = rows, every, faults, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("rows", ROWS)
        self.progress = handle.getListState("faults", "fault_id long, channel string, applied long, held double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name = key[0]
        old = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        armed = self.of(name)
        pick = next((r[1] for r in reversed(old) if r[-1]), None)
        values = new[list(CHANNELS)].to_numpy(np.float64, na_value=np.nan)
        fresh, raw = [], []
        for seq, us, own in zip(new["seq"].tolist(), new["us"].tolist(), values.tolist(), strict=True):
            told = armed.apply(seq, dict(zip(CHANNELS, own, strict=True))) if armed else dict(zip(CHANNELS, own, strict=True))
            picked = pick is None or us >= pick + self.every or us < pick
            pick = us if picked else pick
            fresh.append((seq, us, *(None if np.isnan(told[c]) else told[c] for c in CHANNELS), picked))
            raw.append([None if np.isnan(x) else x for x in own])
        every = old + fresh
        last = max(k for k, r in enumerate(every) if r[-1])
        self.kept.put(every[max(0, min(len(every) - self.rows, last - self.rows)) :])
        if armed:
            self.progress.put([(f[0], f[2], f[5], None if np.isnan(f[6]) else f[6]) for f in armed.faults] + [(None, c, None, x) for c, x in armed.last.items()])
        if self.expire_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        names = [x.split()[0] for x in EMITTED.split(", ")]
        out = [(name, *r, False, *(None,) * len(CHANNELS)) for r in old] + [(name, *r, True, *x) for r, x in zip(fresh, raw, strict=True)]
        yield pd.DataFrame(out, columns=names).astype({c: "float64" for c in (*CHANNELS, *(f"raw_{c}" for c in CHANNELS))})

    def of(self, name: str) -> Armed | None:
        if name not in self.armed:
            return None
        known = [tuple(r) for r in self.progress.get()] if self.progress.exists() else []
        done = {r[0]: (r[2], np.nan if r[3] is None else r[3]) for r in known if r[0] is not None}
        return Armed([(*f, *done.get(f[0], (0, np.nan))) for f in self.armed[name]], {r[1]: r[3] for r in known if r[0] is None})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        self.progress.clear()
        yield from ()

    def close(self) -> None:
        pass


class Processor:
    """Judges a stream of readings; `start` begins the query. faults: definitions (FAULTS), at most MOST_FAULTS. expire_hours:
    after so long without a reading a station is forgotten."""

    def __init__(self, stations: DataFrame, models: engine.Models, folder: str, s: Settings = DEFAULT, faults: DataFrame | None = None, expire_hours: float | None = None):
        self.stations, self.models, self.folder, self.s, self.expire_hours = stations, models, folder, s, expire_hours
        self.rows = features.reach_of(stations, models.limits, s, clock=True) + 2
        self.faults: dict[str, list[tuple]] | None = None
        if faults is not None:
            found = faults.limit(MOST_FAULTS + 1).collect()
            if len(found) > MOST_FAULTS:
                raise ValueError(f"more than {MOST_FAULTS} faults are armed")
            self.faults = {}
            for r in found:
                self.faults.setdefault(r["station_id"], []).append((r["fault_id"], r["fault_type"], r["channel"], r["samples"], r["magnitude"]))

    def run(self, batch: DataFrame, number: int) -> None:
        """Writes the records of a batch's new rows; batch as the stateful operator puts it out."""
        every = stored(batch.withColumn("ts", F.expr("timestampadd(MICROSECOND, us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")))
        results = None
        if self.s.layers.timing and self.models.cells is not None:
            at = every.filter("picked").select("station_id", "seq", "us")
            found = clock.check(clock.shift_scores(every.select(*READING), self.stations, self.models.cells, at, self.models.limits, self.s), self.s)
            results = stored(at.join(found.select("station_id", "seq", "flagged"), ["station_id", "seq"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False))))
        judged = engine.judge(every.select(*READING, "fresh"), self.stations, self.models, self.s, clock_results=results)
        engine.records(judged.filter("fresh")).write.mode("overwrite").parquet(f"{self.folder}/records/batch={number}")
        if self.faults is not None:
            changed = F.lit(False)
            for c in CHANNELS:
                changed = changed | ~F.col(c).eqNullSafe(F.col(f"raw_{c}"))
            every.filter("fresh").filter(changed).select(*READING, *[f"raw_{c}" for c in CHANNELS]).write.mode("overwrite").parquet(f"{self.folder}/altered/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """The running query: over what there is now, or again after each interval (every). Timers need the latter: Spark never
        ends a query over what there is now while timers may fire."""
        if self.expire_hours is not None and every is None:
            raise ValueError("expire_hours needs an interval")
        spark: SparkSession = stream.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        step = int(self.s.timing.every_hours * clock.HOUR)
        expire = None if self.expire_hours is None else int(self.expire_hours * 3_600_000)
        rows = importable(stream).select("station_id", F.col("seq").cast("long").alias("seq"), micros("ts").alias("us"), *CHANNELS)
        live = rows.groupBy("station_id").transformWithStateInPandas(History(self.rows, step, self.faults or {}, expire), EMITTED, "Append", "None" if expire is None else "ProcessingTime")
        return live.writeStream.foreachBatch(self.run).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if every is None else {"processingTime": every})).start()
