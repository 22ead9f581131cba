"""The engine's queries by name, over readings made from the events table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import MINUTE, file_state, long_form, micros, stored
from ..operators import checks as C
from ..operators import clock, coldstart, edge, engine, evaluation, features, forest, fusion, health, imputation, injection, mahalanobis, normality, peers, reasons, serving, starting, studies
from ..operators import limits as learned
from ..settings import CHANNELS, DEFAULT
from ..sources import events
from . import oracles

CADENCE = events.CADENCE


class Tables:
    """The frames that queries are made of, each defined once. What stations have learned and the verdicts are written to the
    shared folder when a query first needs them; later queries of the session on the same folder read them there."""

    #: By application and folder: the state of the folder's files that the tables come from, and the tables.
    known: ClassVar[dict[tuple[str, str], tuple[tuple, Tables]]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # Wide projections run faster as functions than as one method that the JVM does not compile.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        """The tables of a folder; made anew if its files have changed since."""
        key, state = (spark.sparkContext.applicationId, sf_dir), file_state(spark, [f"{sf_dir}/{x}.parquet" for x in ("events", "supplier")])
        if key not in cls.known or cls.known[key][0] != state:
            cls.known[key] = (state, cls(spark, sf_dir))
        return cls.known[key][1]

    @cached_property
    def readings(self) -> DataFrame:
        return events.readings(self.spark, self.sf_dir)

    @cached_property
    def stations(self) -> DataFrame:
        return events.stations(self.spark)

    @cached_property
    def sites(self) -> DataFrame:
        """A station for each supplier, with the nation as its climate zone."""
        k = F.col("s_suppkey")
        return self.spark.read.parquet(f"{self.sf_dir}/supplier.parquet").select(
            F.concat(F.lit("P"), k.cast("string")).alias("station_id"), (40 + k * 37 % 200 / 10.0).alias("lat"), (k * 91 % 300 / 10.0 - 15).alias("lon"), F.concat(F.lit("Z"), F.col("s_nationkey").cast("string")).alias("climate_zone"))

    @cached_property
    def cells(self) -> DataFrame:
        return stored(normality.fit(self.readings))

    @cached_property
    def limits(self) -> DataFrame:
        return stored(learned.fit(self.readings, self.stations))

    @cached_property
    def features(self) -> DataFrame:
        return features.features(self.readings, self.stations, self.cells, self.limits)

    @cached_property
    def plain(self) -> DataFrame:
        """Features without learned limits and history."""
        return features.features(self.readings, self.stations, self.cells, measure=False)

    @cached_property
    def models(self) -> engine.Models:
        return engine.Models(self.cells, self.limits, stored(mahalanobis.fit(self.departures)), stored(forest.fit(mahalanobis.rates(self.plain))))

    @cached_property
    def judged(self) -> DataFrame:
        """All verdicts, written once for all that a query makes of them."""
        return stored(engine.records(engine.judge(self.readings, self.stations, self.models), "qc_flag"))

    @cached_property
    def departures(self) -> DataFrame:
        return mahalanobis.departures(self.plain)

    @cached_property
    def reports(self) -> DataFrame:
        return health.reports(health.scores(self.judged, self.last_drift))

    @cached_property
    def last_drift(self) -> DataFrame:
        """Drift at each station's newest day, if it has held on the days before."""
        found = health.persistent(health.isolated(self.drift(True)).filter("drift_z IS NOT NULL"))
        return found.join(self.readings.groupBy("station_id").agg(F.to_date(F.max("ts")).alias("at")), ["station_id", "at"], "left_semi")

    @cached_property
    def days(self) -> DataFrame:
        return stored(health.usable_days(health.daily_residuals(self.judged), self.stations))

    def drift(self, every_day: bool) -> DataFrame:
        span = self.readings.groupBy("station_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
        at = span.select("station_id", F.explode(F.sequence("a", "b")).alias("day")) if every_day else span.select("station_id", F.col("b").alias("day"))
        return health.drift(self.days, at.crossJoin(F.broadcast(self.channels)))

    @cached_property
    def channels(self) -> DataFrame:
        """The three channels: a constant table."""
        return self.spark.range(1).select(F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"))

    @cached_property
    def peer_differences(self) -> DataFrame:
        found = peers.anomalies(self.plain)
        return peers.differences(found, peers.neighbours(self.stations, _sparse_peers()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the SQL (after the common tables) that checks it."""
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables.of(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracles.TABLES + sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def dated(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, which every engine prints alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


# Checks of one reading.


def flagged(rows: DataFrame, found: list[C.Check]) -> DataFrame:
    out = serving.check_rows(C.apply(rows.select("*"), found)).select("station_id", "seq", "kind", "channel", "severity", "value")
    return rounded(out, "value", digits=4)


def _listed(*kinds: str) -> str:
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"SELECT station_id, seq, kind, channel, severity, round(value, 4) AS value FROM listed WHERE kind IN ({names})"


def _plain_listed(flag: str, kind: str, value: str, severity: str = "hard") -> str:
    return f"SELECT station_id, seq, '{kind}' AS kind, channel, '{severity}' AS severity, round({value}, 4) AS value FROM marked WHERE {flag}"


def _register_checks() -> None:
    per_channel = lambda f: [f(c) for c in CHANNELS]
    for name, kinds, frame, found in (
        ("range_check", ("range",), "plain", lambda: C.physics()[:3]),
        ("dew_point_check", ("dew_point",), "plain", lambda: [C.physics()[3]]),
        ("wet_bulb_check", ("wet_bulb",), "plain", lambda: [C.physics()[4]]),
        ("physics_bundle", ("range", "dew_point", "wet_bulb"), "plain", C.physics),
        ("timestamp_check", ("timestamp",), "plain", lambda: [C.timestamp()]),
        ("dropout_check", ("dropout",), "plain", lambda: [C.dropout()]),
        ("gap_notice", ("gap",), "plain", lambda: [C.gap()]),
        ("limits_notice", ("limits",), "features", lambda: [C.limits_fit()]),
        ("frozen_check", ("frozen",), "features", lambda: per_channel(C.frozen)),
        ("step_check", ("step",), "features", lambda: per_channel(C.step)),
        ("spike_check", ("spike",), "plain", lambda: per_channel(C.spike)),
        ("noise_check", ("noise",), "features", lambda: per_channel(C.noise)),
        ("cusum_drift", ("drift",), "features", lambda: per_channel(C.drift)),
        ("cojump", ("cojump",), "plain", lambda: [C.cojump()]),
        ("normality_check", ("normality",), "plain", lambda: per_channel(C.normal)),
        ("health_bundle", ("timestamp", "dropout", "gap", "limits", "frozen", "step", "spike", "noise", "drift"), "features", C.health),
        ("all_checks", ("range", "dew_point", "wet_bulb", "timestamp", "dropout", "gap", "limits", "frozen", "step", "spike", "noise", "drift", "cojump", "normality"), "features", C.all_checks),
    ):
        QUERIES[name] = lambda spark, sf_dir, frame=frame, found=found: flagged(getattr(Tables.of(spark, sf_dir), frame), found())
        ORACLES[name] = oracles.TABLES + _listed(*kinds)


_register_checks()


@query(_plain_listed("plain_step", "step", "value - v1"))
def step_plain(t: Tables) -> DataFrame:
    return flagged(t.plain, [C.step(c, plain=True) for c in CHANNELS])


@query("SELECT station_id, seq, channel, round(peak, 4) AS peak FROM measured WHERE peak IS NOT NULL")
def cusum_peak(t: Tables) -> DataFrame:
    rows = t.features.select("station_id", "seq", *[F.round(f"peak_{c}", 4).alias(c) for c in CHANNELS])
    return rows.unpivot(["station_id", "seq"], list(CHANNELS), "channel", "peak").filter("peak IS NOT NULL")


@query("""
SELECT station_id, seq, channel, round(own, 6) AS departure FROM (
  SELECT station_id, seq, channel, list_median(list_transform(rows_, lambda x: (x.v - x.e) / x.s)) AS own, rows_ FROM (
    SELECT *, list_filter(wide, lambda x: x.us >= us - 720 * 6e7) AS rows_ FROM (
      SELECT *, list({'us': us, 'v': value, 'e': e, 's': s}) OVER (PARTITION BY station_id, channel ORDER BY seq ROWS BETWEEN 32 PRECEDING AND CURRENT ROW) AS wide FROM feat))
  WHERE len(rows_) >= 4 AND len(list_filter(rows_, lambda x: x.v IS NULL OR x.e IS NULL)) = 0
    AND len(list_filter(range(1, len(rows_)), lambda i: rows_[i + 1].us - rows_[i].us > 90 * 6e7)) = 0)
""")
def offset_departure(t: Tables) -> DataFrame:
    s = replace(DEFAULT, offset=replace(DEFAULT.offset, enabled=True))
    out = features.features(t.readings, t.stations, t.cells, None, s).select("station_id", "seq", *[F.round(f"departure_{c}", 6).alias(c) for c in CHANNELS])
    return out.unpivot(["station_id", "seq"], list(CHANNELS), "channel", "departure").filter("departure IS NOT NULL")


# Normal patterns.


@query("SELECT station_id, month, hour, channel, round(mean, 6) AS mean, round(std, 6) AS std, n FROM cells")
def normality_fit(t: Tables) -> DataFrame:
    return rounded(t.cells, "mean", "std")


@query("SELECT station_id, seq, channel, round(smooth, 6) AS smooth FROM smooth WHERE smooth IS NOT NULL")
def smooth_expected(t: Tables) -> DataFrame:
    rows = t.plain.select("station_id", "seq", *[F.round(f"smooth_{c}", 6).alias(c) for c in CHANNELS])
    return rows.unpivot(["station_id", "seq"], list(CHANNELS), "channel", "smooth").filter("smooth IS NOT NULL")


@query("SELECT station_id, seq, channel, round(e, 6) AS expected, round(s, 6) AS sigma, round(z, 6) AS z FROM feat WHERE e IS NOT NULL")
def expected_and_z(t: Tables) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.round(f"e_{c}", 6).alias("expected"), F.round(f"s_{c}", 6).alias("sigma"), F.round(f"z_{c}", 6).alias("z")) for c in CHANNELS])
    return t.plain.select("station_id", "seq", F.explode(parts).alias("x")).select("station_id", "seq", "x.*").filter("expected IS NOT NULL")


# Learned limits.


@query("SELECT station_id, channel, start_us, n, round(minutes, 6) AS minutes FROM runs")
def frozen_runs(t: Tables) -> DataFrame:
    return rounded(learned.runs(t.readings, t.stations), "minutes")


@query("SELECT station_id, cadence_minutes, channel, resolution, round(frozen_minutes, 6) AS frozen_minutes, round(noise_std, 6) AS noise_std, round(typical_step, 6) AS typical_step, round(step_cap, 6) AS step_cap, n_runs FROM limits")
def limits_fit(t: Tables) -> DataFrame:
    return rounded(t.limits, "frozen_minutes", "noise_std", "typical_step", "step_cap")


@query("SELECT station_id, channel, round(quantile_cont(minutes, 0.999), 6) AS frozen_minutes FROM runs GROUP BY ALL HAVING count(*) >= 30")
def frozen_limit(t: Tables) -> DataFrame:
    p = DEFAULT.limits
    found = learned.runs(t.readings, t.stations).groupBy("station_id", "channel").agg(F.expr(f"percentile(minutes, {p.frozen_quantile}D)").alias("frozen_minutes"), F.count("*").alias("n"))
    return rounded(found.filter(F.col("n") >= p.min_runs).drop("n"), "frozen_minutes")


@query("SELECT station_id, channel, seq, round(jitter, 6) AS jitter FROM jitter")
def noise_estimates(t: Tables) -> DataFrame:
    return rounded(learned.noise_estimates(t.readings, t.stations), "jitter").select("station_id", "channel", "seq", "jitter")


@query("SELECT station_id, channel, round(quantile_cont(change, 0.75) FILTER (dt <= 45), 6) AS typical_step, round(quantile_cont(change, 0.999) * 1.1, 6) AS step_cap, count(*) AS n FROM steps GROUP BY ALL")
def step_limits(t: Tables) -> DataFrame:
    near = F.when(F.col("dt") <= 1.5 * CADENCE, F.col("change"))
    found = learned.steps(t.readings, t.stations).withColumn("near", near).groupBy("station_id", "channel")
    return rounded(found.agg(F.expr("percentile(near, 0.75D)").alias("typical_step"), (F.expr("percentile(change, 0.999D)") * 1.1).alias("step_cap"), F.count("*").alias("n")), "typical_step", "step_cap")


@query("SELECT station_id, channel, resolution FROM resolution")
def resolution_detect(t: Tables) -> DataFrame:
    return learned.resolution(t.readings)


@query("SELECT station_id, round(median(gap), 6) AS cadence_minutes FROM (SELECT station_id, (us - lag(us) OVER (PARTITION BY station_id ORDER BY seq)) / 6e7 AS gap FROM readings) WHERE gap > 0 GROUP BY ALL")
def cadence_median(t: Tables) -> DataFrame:
    return rounded(learned.cadence(t.readings), "cadence_minutes")


@query("SELECT station_id, seq, round(quantile_cont(gap, 0.5) OVER (PARTITION BY station_id ORDER BY seq ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 3) AS running_cadence FROM (SELECT *, CASE WHEN us > lag(us) OVER w THEN (us - lag(us) OVER w) / 6e7 END AS gap FROM readings WINDOW w AS (PARTITION BY station_id ORDER BY seq))")
def cadence_running(t: Tables) -> DataFrame:
    return rounded(learned.running_cadence(t.readings).select("station_id", "seq", "running_cadence"), "running_cadence", digits=3)


@query("""
SELECT station_id, 30.0::DOUBLE AS cadence_minutes, channel, round(coalesce(noise_std, CASE WHEN channel = 'humidity_pct' THEN 7.0 END), 6) AS noise_std FROM limits
""")
def limits_complete(t: Tables) -> DataFrame:
    fresh = t.limits.withColumn("noise_std", F.when(F.col("channel") == "humidity_pct", F.lit(7.0)))
    return rounded(learned.complete(t.limits, fresh), "noise_std").select("station_id", "cadence_minutes", "channel", "noise_std")


@query("""
WITH placed AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY station_id) AS total FROM readings WHERE station_id NOT IN ('S0', 'S1') WINDOW w AS (PARTITION BY station_id ORDER BY seq)),
facts AS (SELECT station_id, count(*) AS rows_, min(us) AS a, max(us) AS b FROM placed WHERE place <= floor(total * 0.7::DOUBLE) GROUP BY ALL)
SELECT p.station_id, count(*) FILTER (place <= floor(total * 0.7::DOUBLE)) AS training, count(*) FILTER (place > floor(total * 0.7::DOUBLE)) AS judged,
  count(*) FILTER (place <= floor(total * 0.7::DOUBLE) AND us >= b - 2880 * 6e7) AS lead FROM placed p JOIN facts f USING (station_id) WHERE rows_ >= 300 AND (b - a) / 6e7 >= 14 * 1440 GROUP BY ALL
""".replace("\nWITH placed", "\n, placed", 1))
def learn_stations(t: Tables) -> DataFrame:
    known = t.stations.filter("station_id IN ('S0', 'S1')")
    training, judged = learned.learn(t.readings, known)
    a = training.groupBy("station_id").agg(F.count("*").alias("training"))
    b = judged.groupBy("station_id").agg(F.count_if(~F.col("lead")).alias("judged"), F.count_if("lead").alias("lead"))
    return a.join(b, "station_id")


# Timing.


@query("SELECT station_id, seq, us FROM instants")
def clock_instants(t: Tables) -> DataFrame:
    return clock.instants(t.readings)


@query("SELECT station_id, seq, CAST(shift AS INTEGER) AS shift, round(score, 6) AS score, terms FROM clock_scores")
def clock_shift_scores(t: Tables) -> DataFrame:
    return rounded(clock.shift_scores(t.readings, t.stations, t.cells, clock.instants(t.readings), t.limits), "score")


@query("SELECT station_id, seq, flag AS clock_flag FROM clock_")
def clock_check(t: Tables) -> DataFrame:
    found = stored(clock.results(t.readings, t.stations, t.cells, t.limits))
    return features.features(t.readings, t.stations, t.cells, t.limits, clock=found, measure=False).select("station_id", "seq", "clock_flag")


# Models.


@query("""
, wide AS (SELECT station_id, seq, max(dt1) AS dt1, """ + ", ".join(f"max(CASE WHEN channel = '{c}' THEN value END) AS {c}, max(CASE WHEN channel = '{c}' THEN v1 END) AS {c}_1" for c in CHANNELS) + """ FROM feat GROUP BY station_id, seq)
SELECT station_id, seq, """ + ", ".join(f"round(({c} - {c}_1) / dt1, 6) AS r_{c}" for c in CHANNELS) + " FROM wide WHERE dt1 > 0 AND " + " AND ".join(f"{c} IS NOT NULL AND {c}_1 IS NOT NULL" for c in CHANNELS))
def features_rates(t: Tables) -> DataFrame:
    rows = mahalanobis.rates(t.plain).filter("usable")
    return rounded(rows.select("station_id", "seq", *[f"r_{c}" for c in CHANNELS]), *[f"r_{c}" for c in CHANNELS])


_PLACES = [(i, j) if i >= j else (j, i) for i in range(6) for j in range(i, 6)]


@query("SELECT u.station_id, n, " + ", ".join(f"round(a{i}{j}{' - 1e-6' * (i == j)}, 6) AS c{k}" for k, (i, j) in enumerate(_PLACES)) + " FROM spread_ JOIN (SELECT station_id, count(*) AS n FROM used GROUP BY ALL) u USING (station_id)")
def mahalanobis_covariance(t: Tables) -> DataFrame:
    found = mahalanobis.covariance(t.departures)
    return found.select("station_id", "n", *[F.round(F.col("cov")[k], 6).alias(f"c{k}") for k in range(len(_PLACES))])


_NAMES = ", ".join(f"'{x}'" for x in mahalanobis.FEATURES)


@query(f"SELECT station_id, seq, round(d2, 5) AS d2, [{_NAMES}][list_position(parts, list_max(parts))] AS top_feature, far AS flagged FROM far_")
def mahalanobis_check(t: Tables) -> DataFrame:
    found = mahalanobis.distances(t.departures, stored(mahalanobis.fit(t.departures)))
    return rounded(found.filter("d2 IS NOT NULL").select("station_id", "seq", "d2", "top_feature", (F.col("d2") > F.col("threshold")).alias("flagged")), "d2", digits=5)


@query("SELECT station_id, seq, round(score, 6) AS iforest_score, round(threshold, 6) AS iforest_threshold, rare AS flagged FROM rare_")
def iforest_check(t: Tables) -> DataFrame:
    found = forest.score(mahalanobis.rates(t.plain), t.models.forest).withColumn("flagged", forest.rare())
    return rounded(found, "iforest_score", "iforest_threshold")


# Fusion.


@query("SELECT station_id, seq, verdict, confidence, rule, signature, coherent FROM verdicts")
def fuse_verdict(t: Tables) -> DataFrame:
    return t.judged.select("station_id", "seq", "verdict", "confidence", "rule", "signature", F.col("coherent").cast("long").alias("coherent"))


def _clause() -> str:
    """A row of listed as a clause (see operators.reasons)."""
    own = "CASE l.channel WHEN 'temperature_c' THEN r.temperature_c WHEN 'pressure_hpa' THEN r.pressure_hpa WHEN 'humidity_pct' THEN r.humidity_pct END"
    told = []
    for kind, (before, after, digits, of_channel) in reasons.SAID.items():
        number = "" if digits is None else f" || coalesce(CAST(TRY_CAST(round({own if of_channel else 'l.value'}, {digits}) AS DECIMAL(28, {digits})) AS VARCHAR), 'some amount')"
        told.append(f"WHEN '{kind}' THEN '{before}'{number} || '{after}'")
    return f"coalesce(l.channel || ' ', '') || CASE l.kind {' '.join(told)} END"


@query(f"""
, said AS (SELECT l.station_id, l.seq, l.place, l.kind, l.severity, {_clause()} AS clause FROM listed l JOIN readings r ON r.station_id = l.station_id AND r.seq = l.seq WHERE l.kind NOT IN ('gap', 'limits'))
SELECT v.station_id, v.seq, CASE rule WHEN 1 THEN 'The sensor is at fault: ' WHEN 2 THEN 'The sensor of one channel is at fault, the others are calm: ' WHEN 3 THEN 'Weather, ' || coalesce(signature, coherent || ' channels far from normal') || ': ' WHEN 4 THEN 'Worth a look: ' ELSE 'Nothing stands out.' END
  || coalesce((SELECT string_agg(clause, '; ' ORDER BY place) FROM said s WHERE s.station_id = v.station_id AND s.seq = v.seq AND (rule > 2 OR (severity = 'hard' AND ((rule = 1 AND kind IN ('range', 'dew_point', 'frozen', 'dropout')) OR (rule = 2 AND kind IN ('step', 'spike')))))), '') AS reason
FROM verdicts v
""")
def verdict_reasons(t: Tables) -> DataFrame:
    return t.judged.select("station_id", "seq", "reason")


@query("SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict")
def verdict_counts(t: Tables) -> DataFrame:
    return serving.counts(t.judged)


@query("SELECT station_id, verdict, count(*) AS n, round(avg(confidence), 6) AS confidence FROM verdicts GROUP BY ALL")
def confidence_by_station(t: Tables) -> DataFrame:
    return rounded(t.judged.groupBy("station_id", "verdict").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")), "confidence")


@query("SELECT station_id, seq, move_t, move_p, move_h FROM per_reading")
def movement(t: Tables) -> DataFrame:
    return t.features.select("station_id", "seq", *[fusion.moves(c).alias(f"move_{c[0]}") for c in CHANNELS])


@query("SELECT station_id, seq, channel FROM marked WHERE quiet")
def quiet_channels(t: Tables) -> DataFrame:
    rows = t.features.select("station_id", "seq", *[fusion.quiet(c).alias(c) for c in CHANNELS])
    return rows.unpivot(["station_id", "seq"], list(CHANNELS), "channel", "quiet").filter("quiet").drop("quiet")


@query("SELECT station_id, seq, CASE WHEN far >= 2 THEN far ELSE 0 END AS coherent FROM per_reading")
def coherent_departure(t: Tables) -> DataFrame:
    return t.plain.select("station_id", "seq", fusion.coherent().cast("long").alias("coherent"))


@query("SELECT station_id, seq, channel FROM pointed")
def flagged_channels(t: Tables) -> DataFrame:
    return t.judged.select("station_id", "seq", F.explode_outer("flagged_channels").alias("channel")).filter("channel IS NOT NULL")


@query("""
SELECT v.station_id, v.seq, verdict, confidence, rule, coalesce(checks, '') AS checks FROM verdicts v
LEFT JOIN (SELECT station_id, seq, string_agg(kind || coalesce(':' || channel, ''), ' ' ORDER BY place) AS checks FROM listed GROUP BY ALL) USING (station_id, seq)
""")
def fuse_full(t: Tables) -> DataFrame:
    """Each verdict with the names of all flagged checks, in the order in which the layers run."""
    names = F.transform(F.filter("checks", lambda x: x["flagged"]), lambda x: x["check"])
    return t.judged.select("station_id", "seq", "verdict", "confidence", "rule", F.array_join(names, " ").alias("checks"))


_CONFIGS = "SELECT * FROM (VALUES ('full', []::VARCHAR[]), " + ", ".join(f"('no_{k}', [{', '.join(repr(x) for x in v)}])" for k, v in studies.LAYERS.items()) + ") x(config, off)"


@query(oracles.configured(_CONFIGS) + """
SELECT c.config, c.station_id, c.verdict, count(*) AS n, count(*) FILTER (c.verdict <> v.verdict) AS changed FROM verdicts_c c JOIN verdicts v ON v.station_id = c.station_id AND v.seq = c.seq GROUP BY ALL
""")
def ablation(t: Tables) -> DataFrame:
    return studies.ablation(engine.judge(t.readings, t.stations, t.models))


@query("SELECT v.station_id, v.seq, round(d2, 3) AS distance2, round(threshold, 3) AS threshold, far AS flagged, [" + _NAMES + "][list_position(list_transform(parts, lambda x: abs(x)), list_max(list_transform(parts, lambda x: abs(x))))] AS first_feature, round(list_sum(parts), 3) AS total FROM (SELECT station_id, max(seq) AS seq FROM readings WHERE station_id = 'S3' GROUP BY ALL) v JOIN far_ USING (station_id, seq)")
def explain_latest(t: Tables) -> DataFrame:
    found = mahalanobis.explain_latest(t.departures, t.models.distance, "S3").filter("available")
    total = F.round(F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["value"]), 3)
    return found.select("station_id", "seq", F.round("distance2", 3).alias("distance2"), F.round("distance_threshold", 3).alias("threshold"), F.col("far").alias("flagged"), F.col("contributions")[0]["feature"].alias("first_feature"), total.alias("total"))


# Imputation.

_TRUSTED = """
, trusted AS (SELECT station_id, seq, channel, ts, us, value, verdict, pointed_at, value IS NULL OR (verdict = 'FAULT' AND pointed_at) AS needed,
  last_value(CASE WHEN value IS NOT NULL AND NOT (verdict = 'FAULT' AND pointed_at) THEN {'us': us, 'ts': ts, 'v': value} END IGNORE NULLS) OVER (PARTITION BY station_id, channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ FROM judged),
aged AS (SELECT *, (us - last_.us) / 6e7 AS age, last_.ts AS then_ FROM trusted WHERE needed AND last_ IS NOT NULL AND last_.us < us AND us - last_.us <= 180 * 6e7)
"""
_FILLED = """
, spans_ AS (SELECT l.station_id, l.seq, l.channel, l.ts, l.us, last_value(CASE WHEN value IS NOT NULL THEN {'us': l.us, 'ts': l.ts, 'v': value} END IGNORE NULLS) OVER (PARTITION BY l.station_id, l.channel ORDER BY l.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_,
  lead(l.us) OVER (PARTITION BY l.station_id, l.channel ORDER BY l.seq) - l.us AS gap FROM long_ l),
missing_ AS (SELECT *, unnest(range(1, least(10, CAST(round_even(gap / 6e7 / 30, 0) AS INTEGER) - 1) + 1)) AS k FROM spans_ WHERE gap > 90 * 6e7),
aged AS (SELECT station_id, seq, channel, ts + k * INTERVAL 30 MINUTE AS ts, us + k * 1800000000 AS us, last_, (us + k * 1800000000 - last_.us) / 6e7 AS age, last_.ts AS then_ FROM missing_ WHERE last_ IS NOT NULL AND us + k * 1800000000 - last_.us <= 180 * 6e7)
"""
_ESTIMATES = """
, centres AS (SELECT *, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS c1, date_trunc('hour', then_) + INTERVAL 30 MINUTE AS c2 FROM aged),
around AS (SELECT *, ts + CASE WHEN ts >= c1 THEN INTERVAL 1 HOUR ELSE INTERVAL (-1) HOUR END AS o1, then_ + CASE WHEN then_ >= c2 THEN INTERVAL 1 HOUR ELSE INTERVAL (-1) HOUR END AS o2, abs(epoch_us(ts) - epoch_us(c1)) / 3.6e9 AS w1, abs(epoch_us(then_) - epoch_us(c2)) / 3.6e9 AS w2 FROM centres),
cells4 AS (SELECT x.*, CASE WHEN b.mean IS NULL THEN a.mean ELSE (1 - w1) * a.mean + w1 * b.mean END AS mean1, CASE WHEN b.mean IS NULL THEN a.std ELSE (1 - w1) * a.std + w1 * b.std END AS std1, CASE WHEN d.mean IS NULL THEN c.mean ELSE (1 - w2) * c.mean + w2 * d.mean END AS mean2 FROM around x
  LEFT JOIN cells a ON a.station_id = x.station_id AND a.channel = x.channel AND a.month = month(ts) AND a.hour = hour(ts) LEFT JOIN cells b ON b.station_id = x.station_id AND b.channel = x.channel AND b.month = month(o1) AND b.hour = hour(o1)
  LEFT JOIN cells c ON c.station_id = x.station_id AND c.channel = x.channel AND c.month = month(then_) AND c.hour = hour(then_) LEFT JOIN cells d ON d.station_id = x.station_id AND d.channel = x.channel AND d.month = month(o2) AND d.hour = hour(o2)),
estimated AS (SELECT *, pow(0.5::DOUBLE, age / 120) AS rho, mean1 IS NOT NULL AND mean2 IS NOT NULL AS known, """ + oracles.MIN_STD + """ AS fl, """ + oracles._by("1.0::DOUBLE", "1.0::DOUBLE", "5.0::DOUBLE") + """ AS fb FROM cells4),
imputed AS (SELECT *, CASE WHEN known THEN mean1 + rho * (last_.v - mean2) ELSE last_.v END AS estimate, CASE WHEN known THEN sqrt(pow(greatest(std1, fl), 2) * (1 - rho * rho) + (1 + rho * rho) * fl * fl) ELSE sqrt(fb * fb * least(1.0, age / 120) + 2 * fl * fl) END AS spread FROM estimated)
"""


@query(_TRUSTED + _ESTIMATES + "SELECT station_id, seq, channel, round_even(estimate, 4) AS value, round_even(estimate - 1.96::DOUBLE * spread, 4) AS lower, round_even(estimate + 1.96::DOUBLE * spread, 4) AS upper, CASE WHEN known THEN 'normal' ELSE 'last' END AS method FROM imputed")
def impute_band(t: Tables) -> DataFrame:
    rows = imputation.impute(t.judged, t.cells).select("station_id", "seq", F.explode("imputation").alias("channel", "x"))
    return rows.select("station_id", "seq", "channel", "x.value", "x.lower", "x.upper", "x.method")


@query("""
SELECT station_id, seq, channel, value, last_value(value IGNORE NULLS) OVER (PARTITION BY station_id, channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown, value IS NULL AS missing FROM long_
""")
def chart_rows(t: Tables) -> DataFrame:
    return serving.chart(t.readings).drop("ts")


@query("""
, gaps AS (SELECT station_id, us, unnest(range(1, least(10, CAST(round_even((next_us - us) / 6e7 / 30, 0) AS INTEGER) - 1) + 1)) AS k FROM (SELECT *, lead(us) OVER (PARTITION BY station_id ORDER BY seq) AS next_us FROM readings) WHERE next_us - us > 90 * 6e7)
SELECT station_id, count(*) AS n, CAST(sum(us + k * 1800000000) AS BIGINT) AS times FROM gaps GROUP BY station_id
""")
def gap_fill_times(t: Tables) -> DataFrame:
    return imputation.gap_times(t.readings, t.stations).groupBy("station_id").agg(F.count("*").alias("n"), F.sum("at_us").alias("times"))


@query(_FILLED + _ESTIMATES + "SELECT station_id, ts, channel, round_even(estimate, 4) AS value, round_even(estimate - 1.96::DOUBLE * spread, 4) AS lower, round_even(estimate + 1.96::DOUBLE * spread, 4) AS upper, round_even(age, 2) AS age_minutes, CASE WHEN known THEN 'normal' ELSE 'last' END AS method FROM imputed")
def gap_fill(t: Tables) -> DataFrame:
    return imputation.fill_gaps(t.readings, t.stations, t.cells)


# Health.


@query("SELECT station_id, channel, CAST(day AS VARCHAR) AS day, round(sum, 4) AS sum, n FROM residuals")
def daily_residual(t: Tables) -> DataFrame:
    return dated(rounded(health.daily_residuals(t.judged), "sum", digits=4), "day")


@query("SELECT station_id, channel, CAST(day AS VARCHAR) AS day, round(mean, 6) AS mean FROM days")
def usable_days(t: Tables) -> DataFrame:
    return dated(rounded(t.days, "mean"), "day")


@query("SELECT station_id, channel, CAST(eval_day AS VARCHAR) AS day, n, round(slope, 6) AS drift_per_day, round(z, 4) AS drift_z, round(4 * se, 6) AS drift_floor_per_day, round(offset_now, 4) AS offset_now FROM tested JOIN last_day USING (station_id, eval_day)")
def drift_test(t: Tables) -> DataFrame:
    out = t.drift(False).filter("drift_per_day IS NOT NULL").select("station_id", "channel", F.col("at").cast("string").alias("day"), F.col("n").cast("long").alias("n"), "drift_per_day", "drift_z", "drift_floor_per_day", "offset_now")
    return rounded(rounded(out, "drift_per_day", "drift_floor_per_day"), "drift_z", "offset_now", digits=4)


@query("SELECT station_id, channel, CAST(eval_day AS VARCHAR) AS day, significant AS drift_significant, round(z, 4) AS drift_z FROM isolated")
def drift_isolated(t: Tables) -> DataFrame:
    out = health.isolated(t.drift(True)).filter("drift_z IS NOT NULL").select("station_id", "channel", F.col("at").cast("string").alias("day"), "drift_significant", "drift_z")
    return rounded(out, "drift_z", digits=4)


@query("SELECT station_id, channel, CAST(eval_day AS VARCHAR) AS day, drifts AS drift_significant FROM persistent")
def drift_persistent(t: Tables) -> DataFrame:
    found = health.persistent(health.isolated(t.drift(True)).filter("drift_z IS NOT NULL"))
    return found.select("station_id", "channel", F.col("at").cast("string").alias("day"), "drift_significant")


@query("""
, daily AS (SELECT station_id, eval_day, count(*) AS n, count(*) FILTER (drifts) AS claims FROM persistent GROUP BY ALL)
SELECT station_id, CAST(sum(n) AS BIGINT) AS channel_days, CAST(sum(claims) AS BIGINT) AS significant, count(*) AS days, count(*) FILTER (claims > 0) AS days_with_significant FROM daily GROUP BY station_id
""")
def drift_claims(t: Tables) -> DataFrame:
    return studies.false_claims(health.persistent(health.isolated(t.drift(True)).filter("drift_z IS NOT NULL")))


@query()
def drift_power(t: Tables) -> DataFrame:
    """A month of readings: the ramp begins on the eighth day."""
    return rounded(studies.drift_power(t.plain.withColumn("chunk", F.lit(0)), t.stations, start_day=8, ramp_days=8, least_days=20), "mean_offset_ratio")


@query("SELECT station_id, channel, records, round(fault_fraction, 6) AS fault_fraction, round(suspect_fraction, 6) AS suspect_fraction, coalesce(drifts, FALSE) AS drift_significant, CAST(service_date AS VARCHAR) AS service_date, score FROM scored")
def health_score(t: Tables) -> DataFrame:
    found = health.scores(t.judged, t.last_drift).withColumn("drift_significant", F.coalesce("drift_significant", F.lit(False)))
    return dated(rounded(found.select("station_id", "channel", "records", "fault_fraction", "suspect_fraction", "drift_significant", "service_date", "score"), "fault_fraction", "suspect_fraction"), "service_date")


@query("SELECT station_id, now, records, score, CAST(service_date AS VARCHAR) AS service_date, ticket, channels FROM reports")
def ticket(t: Tables) -> DataFrame:
    return dated(t.reports, "service_date")


@query("""
, hourly_ AS (SELECT station_id, min(seq) AS seq, arg_min(us, seq) AS us FROM readings GROUP BY station_id
  UNION ALL SELECT i.station_id, min(r.seq), arg_min(r.us, r.seq) FROM hourly_ i JOIN readings r ON r.station_id = i.station_id AND r.seq > i.seq AND (r.us >= i.us + 3600000000 OR r.us < i.us) GROUP BY i.station_id)
SELECT station_id, count(*) AS n FROM hourly_ GROUP BY station_id
""")
def health_instants(t: Tables) -> DataFrame:
    return clock.instants(t.readings, every_hours=DEFAULT.health.every / 60).groupBy("station_id").agg(F.count("*").alias("n"))


# Serving.


@query("SELECT station_id, seq, ts, verdict, confidence FROM verdicts ORDER BY ts DESC, seq DESC LIMIT 100")
def latest(t: Tables) -> DataFrame:
    return serving.latest(t.judged.select("station_id", "seq", "ts", "verdict", "confidence"))


@query("SELECT station_id, seq, ts, verdict, confidence FROM verdicts WHERE verdict <> 'VALID' ORDER BY ts DESC, seq DESC LIMIT 100")
def alerts(t: Tables) -> DataFrame:
    return serving.alerts(t.judged.select("station_id", "seq", "ts", "verdict", "confidence"))


@query("SELECT DISTINCT station_id FROM readings")
def stations_seen(t: Tables) -> DataFrame:
    return serving.stations(t.readings)


@query("SELECT station_id, seq, ts, temperature_c, pressure_hpa, humidity_pct FROM readings WHERE station_id = 'S3' ORDER BY seq DESC LIMIT 60")
def recent_readings(t: Tables) -> DataFrame:
    return serving.recent(t.readings.drop("qc_flag"), "S3", 60)


@query("SELECT station_id, seq, ts, temperature_c, pressure_hpa, humidity_pct FROM readings WHERE seq = 500")
def record_by_id(t: Tables) -> DataFrame:
    return serving.by_id(t.readings.drop("qc_flag"), 500)


@query("SELECT count(*) AS n, min(ts) AS oldest FROM readings WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def retention(t: Tables) -> DataFrame:
    return serving.retained(t.readings, F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("""
SELECT v.station_id, v.verdict, v.ts, a.alerts, r.score, CAST(r.service_date AS VARCHAR) AS service_date, r.ticket, CASE v.verdict WHEN 'FAULT' THEN 0 WHEN 'SUSPECT' THEN 1 WHEN 'WEATHER' THEN 2 ELSE 3 END AS urgency
FROM (SELECT station_id, arg_max(verdict, seq) AS verdict, arg_max(ts, seq) AS ts FROM verdicts GROUP BY station_id) v JOIN (SELECT station_id, least(200, count(*) FILTER (verdict <> 'VALID')) AS alerts FROM verdicts GROUP BY station_id) a USING (station_id) LEFT JOIN reports r USING (station_id)
""")
def fleet(t: Tables) -> DataFrame:
    return dated(serving.fleet(t.judged, t.reports, t.stations), "service_date")


# Cold start and peers.


@query("SELECT month, hour, channel, round(avg(mean), 6) AS mean, round(sqrt(greatest(0, avg(std * std + mean * mean) - avg(mean) * avg(mean))), 6) AS std, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL")
def coldstart_pool(t: Tables) -> DataFrame:
    return rounded(coldstart.pool(t.cells), "mean", "std")


_BLEND = """
, s AS (SELECT month, hour, channel, avg(mean) AS mean, sqrt(greatest(0, avg(std * std + mean * mean) - avg(mean) * avg(mean))) AS std, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE station_id <> 'S0' GROUP BY ALL), o AS (SELECT * FROM cells WHERE station_id = 'S0'),
b AS (SELECT coalesce(s.month, o.month) AS month, coalesce(s.hour, o.hour) AS hour, coalesce(s.channel, o.channel) AS channel, least(1.0, o.n / 30.0) AS w, s.mean AS sm, s.std AS ss, s.n AS sn, o.mean AS om, o.std AS os, o.n AS onn FROM s FULL JOIN o ON s.month = o.month AND s.hour = o.hour AND s.channel = o.channel)
SELECT month, hour, channel, round(CASE WHEN om IS NULL THEN sm WHEN sm IS NULL THEN om ELSE w * om + (1 - w) * sm END, 6) AS mean, round(CASE WHEN om IS NULL THEN ss WHEN sm IS NULL THEN os ELSE sqrt(w * os * os + (1 - w) * ss * ss + w * (1 - w) * (om - sm) * (om - sm)) END, 6) AS std, coalesce(onn, sn) AS n FROM b
"""


@query(_BLEND)
def coldstart_blend(t: Tables) -> DataFrame:
    own = t.cells.filter("station_id = 'S0'").drop("station_id")
    return rounded(coldstart.blend(coldstart.pool(t.cells.filter("station_id <> 'S0'")), own), "mean", "std")


@query("""
, base AS (SELECT channel, avg(nullif(frozen_minutes, 0)) AS f, avg(nullif(noise_std, 0)) AS n, avg(nullif(typical_step, 0)) AS t FROM limits WHERE station_id <> 'S1' GROUP BY ALL), d AS (SELECT least(1.0, 90 / 365.0)::DOUBLE AS w)
SELECT l.station_id, l.channel, round(CASE WHEN frozen_minutes IS NULL THEN f WHEN f IS NULL THEN frozen_minutes ELSE w * frozen_minutes + (1 - w) * f END, 5) AS frozen_minutes, round(CASE WHEN noise_std IS NULL THEN n WHEN n IS NULL THEN noise_std ELSE w * noise_std + (1 - w) * n END, 5) AS noise_std,
  round(CASE WHEN typical_step IS NULL THEN t WHEN t IS NULL THEN typical_step ELSE w * typical_step + (1 - w) * t END, 5) AS typical_step FROM limits l JOIN base USING (channel), d WHERE l.station_id = 'S1'
""")
def coldstart_limits(t: Tables) -> DataFrame:
    days = t.stations.select("station_id", F.lit(90.0).alias("own_days"))
    out = coldstart.blend_limits(t.limits.filter("station_id <> 'S1'"), t.limits.filter("station_id = 'S1'"), days)
    return rounded(out.select("station_id", "channel", "frozen_minutes", "noise_std", "typical_step"), "frozen_minutes", "noise_std", "typical_step", digits=5)


#: Days of own history in the cold-start run, and the day from which all readings are judged.
_DAYS, _JUDGED_FROM = (0, 3, 10), 15
_STARTS = ", ".join(f"({d}, '{m}')" for d in _DAYS for m in starting.MODES)
_LEARNED = "frozen_minutes noise_std typical_step".split()
_STARTED = f"""
, first_ AS (SELECT station_id, min(us) AS us0 FROM readings GROUP BY ALL),
every_ AS (SELECT station_id || '|' || days || '|' || mode AS station_id, station_id AS base, station_id || '|' || days AS own, days, mode FROM stations, (VALUES {_STARTS}) x(days, mode))
""" + oracles.judging("SELECT r.* REPLACE (r.station_id || '|' || d.days AS station_id) FROM readings r JOIN first_ f ON f.station_id = r.station_id JOIN (SELECT DISTINCT days FROM every_) d ON r.us < f.us0 + d.days * 86400000000", "_o", oracles.LEARNING) + f"""
, facts_ AS (SELECT station_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS own_days FROM readings_o GROUP BY ALL),
own_cells AS (SELECT c.* FROM cells_o c JOIN facts_ f ON f.station_id = c.station_id WHERE f.n > 50), own_limits AS (SELECT l.* FROM limits_o l JOIN facts_ f ON f.station_id = l.station_id WHERE f.n > 200),
start_ AS (SELECT s.station_id AS base, c.month, c.hour, c.channel, avg(c.mean) AS mean, stddev_pop(c.mean) AS between_, avg(c.std * c.std) AS within_, sum(c.n) AS n FROM stations s JOIN cells c ON c.station_id <> s.station_id GROUP BY ALL),
mixed_ AS (SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.month, b.month) AS month, coalesce(a.hour, b.hour) AS hour, coalesce(a.channel, b.channel) AS channel, least(1.0, b.n / 30.0) AS w, a.mean AS am, a.std AS asd, a.n AS an, b.mean AS bm, b.std AS bs, b.n AS bn
  FROM (SELECT e.station_id, x.month, x.hour, x.channel, x.mean, sqrt(x.within_ + x.between_ * x.between_) AS std, x.n FROM every_ e JOIN start_ x ON x.base = e.base WHERE mode = 'starter') a
  FULL JOIN (SELECT e.station_id, c.month, c.hour, c.channel, c.mean, c.std, c.n FROM every_ e JOIN own_cells c ON c.station_id = e.own WHERE mode = 'starter') b ON a.station_id = b.station_id AND a.month = b.month AND a.hour = b.hour AND a.channel = b.channel),
patterns_ AS (SELECT station_id, month, hour, channel, CASE WHEN bm IS NULL THEN am WHEN am IS NULL THEN bm ELSE w * bm + (1 - w) * am END AS mean, CASE WHEN bm IS NULL THEN asd WHEN am IS NULL THEN bs ELSE sqrt(w * bs * bs + (1 - w) * asd * asd + w * (1 - w) * (bm - am) * (bm - am)) END AS std, coalesce(bn, an) AS n FROM mixed_
  UNION ALL SELECT e.station_id, c.month, c.hour, c.channel, c.mean, c.std, c.n FROM every_ e JOIN own_cells c ON c.station_id = e.own WHERE mode = 'own_only'),
others_ AS (SELECT s.station_id AS base, l.channel, {", ".join(f"avg(nullif(l.{x}, 0)) AS {x}" for x in _LEARNED)} FROM stations s JOIN limits l ON l.station_id <> s.station_id GROUP BY ALL),
blended_ AS (SELECT e.station_id, 30.0::DOUBLE AS cadence_minutes, o.channel, {", ".join(f"coalesce(w * l.{x} + (1 - w) * o.{x}, l.{x}, o.{x}) AS {x}" for x in _LEARNED)} FROM (SELECT e.*, least(1.0::DOUBLE, coalesce(f.own_days, 0) / 365.0::DOUBLE) AS w FROM every_ e LEFT JOIN facts_ f ON f.station_id = e.own) e JOIN others_ o ON o.base = e.base
    LEFT JOIN own_limits l ON l.station_id = e.own AND l.channel = o.channel WHERE mode = 'starter'
  UNION ALL SELECT e.station_id, 30.0, l.channel, {", ".join(f"l.{x}" for x in _LEARNED)} FROM every_ e JOIN own_limits l ON l.station_id = e.own WHERE mode = 'own_only')
"""
_STARTED_JUDGED = _STARTED + oracles.judging(f"SELECT e.station_id, r.* EXCLUDE (station_id) FROM readings r JOIN first_ f ON f.station_id = r.station_id JOIN every_ e ON e.base = r.station_id WHERE r.us >= f.us0 + {_JUDGED_FROM} * 86400000000", "_c", given={
    "cells": "SELECT * FROM patterns_", "limits": "SELECT * FROM blended_",
    "history_rows": "SELECT e.station_id, CAST(ceil(greatest(360, 2 * coalesce(max(frozen_minutes), 0)) / 30.0) AS INTEGER) + 9 AS rows_, CAST(ceil(greatest(1440, 2 * coalesce(max(frozen_minutes), 0)) / 30.0) AS INTEGER) + 9 AS clock_rows FROM every_ e LEFT JOIN blended_ b ON b.station_id = e.station_id GROUP BY e.station_id"})


@query(_STARTED + "SELECT e.base AS station_id, e.days, e.mode, p.month, p.hour, p.channel, round(p.mean, 6) AS mean, round(p.std, 5) AS std, CAST(p.n AS BIGINT) AS n FROM patterns_ p JOIN every_ e ON e.station_id = p.station_id")
def coldstart_patterns(t: Tables) -> DataFrame:
    """The pattern of each station as if it had just begun, after so many days, borrowing from all others and not."""
    known = starting.models(t.readings, t.stations, t.cells, t.limits, _DAYS)
    named = known.cells.join(starting.scenarios(t.stations, _DAYS).select("station_id", "base", "days", "mode"), "station_id")
    return rounded(rounded(named.drop("station_id").withColumnRenamed("base", "station_id"), "mean"), "std", digits=5)


@query(_STARTED_JUDGED + "SELECT e.base AS station_id, e.days, e.mode, v.verdict, count(*) AS n FROM verdicts_c v JOIN every_ e ON e.station_id = v.station_id GROUP BY ALL")
def coldstart_run(t: Tables) -> DataFrame:
    """Verdicts of the second half of each station's readings by what it would have known in each scenario."""
    known = starting.models(t.readings, t.stations, t.cells, t.limits, _DAYS)
    first = t.readings.groupBy("station_id").agg(F.min(micros("ts")).alias("first"))
    later = t.readings.join(first, "station_id").filter(micros("ts") >= F.col("first") + _JUDGED_FROM * 1440 * MINUTE).drop("first")
    return starting.judged(later, t.stations, known, _DAYS).groupBy("station_id", "days", "mode", "verdict").agg(F.count("*").alias("n"))


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


_SITES = ", sites AS (SELECT 'P' || CAST(s_suppkey AS VARCHAR) AS station_id, 40 + s_suppkey * 37 % 200 / 10.0::DOUBLE AS lat, s_suppkey * 91 % 300 / 10.0::DOUBLE - 15 AS lon, 'Z' || CAST(s_nationkey AS VARCHAR) AS climate_zone FROM supplier) "


@query(_SITES + f"SELECT station_id, other, round(km, 6) AS km, CAST(rank AS INTEGER) AS rank FROM (SELECT a.station_id, b.station_id AS other, {_KM} AS km, row_number() OVER (PARTITION BY a.station_id ORDER BY {_KM}, b.station_id) AS rank FROM sites a JOIN sites b ON a.station_id <> b.station_id) WHERE rank <= 3")
def nearest_stations(t: Tables) -> DataFrame:
    return rounded(coldstart.nearest(t.sites, 3), "km")


@query(_SITES + "SELECT a.station_id, b.station_id AS other, a.climate_zone FROM sites a JOIN sites b ON a.climate_zone IS NOT DISTINCT FROM b.climate_zone AND a.station_id <> b.station_id")
def same_zone(t: Tables) -> DataFrame:
    return coldstart.same_zone(t.sites)


@query(_SITES + f"SELECT a.station_id, b.station_id AS other, round({_KM}, 6) AS km FROM sites a JOIN sites b ON a.station_id <> b.station_id WHERE {_KM} <= 400")
def peer_neighbours(t: Tables) -> DataFrame:
    return peers.within(t.sites, digits=6)


_ANOMALY = f"""
, hours_ AS (SELECT l.station_id, l.channel, l.us // 3600000000 AS hour, l.value - coalesce(s.smooth, f.e) AS anomaly, row_number() OVER (PARTITION BY l.station_id, l.channel, l.us // 3600000000 ORDER BY l.us, l.seq) AS k FROM long_ l LEFT JOIN smooth s USING (station_id, seq, channel) LEFT JOIN joined f USING (station_id, seq, channel)),
calendar AS (SELECT station_id, unnest(range(min(hour), max(hour) + 1)) AS hour FROM hours_ GROUP BY station_id),
anomalies AS (SELECT c.station_id, ch.channel, c.hour, h.anomaly FROM calendar c, (VALUES ('temperature_c'), ('pressure_hpa'), ('humidity_pct')) ch(channel) LEFT JOIN hours_ h ON h.station_id = c.station_id AND h.hour = c.hour AND h.channel = ch.channel AND h.k = 1),
near_ AS (SELECT a.station_id, b.station_id AS other FROM stations a JOIN stations b ON a.station_id <> b.station_id WHERE {_KM} <= 1000),
middle AS (SELECT n.station_id, a.channel, a.hour, median(a.anomaly) AS m FROM near_ n JOIN anomalies a ON a.station_id = n.other WHERE a.anomaly IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
diffs AS (SELECT a.station_id, a.channel, a.hour, a.anomaly - m.m AS difference FROM anomalies a LEFT JOIN middle m USING (station_id, channel, hour)),
rolled AS (SELECT *, CASE WHEN count(difference) OVER w >= 100 THEN avg(difference) OVER w END AS rolling FROM diffs WINDOW w AS (PARTITION BY station_id, channel ORDER BY hour ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
"""


@query(_ANOMALY + "SELECT station_id, channel, hour, round(difference, 6) AS difference FROM diffs WHERE difference IS NOT NULL")
def peer_difference(t: Tables) -> DataFrame:
    return rounded(t.peer_differences.filter("difference IS NOT NULL"), "difference")


@query(_ANOMALY.replace(">= 100 THEN", ">= 10 THEN") + "SELECT station_id, channel, hour, round(rolling, 4) AS rolling FROM rolled WHERE rolling IS NOT NULL")
def peer_rolling(t: Tables) -> DataFrame:
    return rounded(peers.rolling(t.peer_differences, _sparse_peers()).filter("rolling IS NOT NULL").select("station_id", "channel", "hour", "rolling"), "rolling", digits=4)


@query(_ANOMALY.replace(">= 100 THEN", ">= 10 THEN") + """
, lim AS (SELECT station_id, channel, quantile_cont(abs(rolling), 0.999) * 1.2 AS threshold, count(*) AS n_windows FROM rolled WHERE rolling IS NOT NULL GROUP BY ALL HAVING count(*) >= 50)
SELECT station_id, channel, round(threshold, 4) AS threshold, n_windows, count(*) FILTER (abs(rolling) > threshold) AS alarms FROM rolled JOIN lim USING (station_id, channel) GROUP BY ALL
""")
def peer_limit(t: Tables) -> DataFrame:
    s = _sparse_peers()
    rolled = peers.rolling(t.peer_differences, s)
    out = peers.alarms(rolled, peers.limits(rolled, s)).groupBy("station_id", "channel", "threshold", "n_windows").agg(F.count_if("alarm").alias("alarms"))
    return rounded(out, "threshold", digits=4)


def _sparse_peers():
    """The adapter's stations lie far apart and report less than hourly, so fewer hours of a week have a value."""
    return replace(DEFAULT, peers=replace(DEFAULT.peers, radius_km=1000.0, fraction=10 / 168, min_windows=50))


# Events and evaluation.


@query("""
SELECT station_id, ts, base - pressure_hpa AS score FROM (SELECT *, quantile_cont(pressure_hpa, 0.5) OVER w AS base, count(*) OVER w AS held FROM readings WHERE pressure_hpa IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY us RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW))
WHERE held >= 20 AND pressure_hpa - base <= -10
""")
def event_low(t: Tables) -> DataFrame:
    return evaluation.low_pressure(t.readings)


@query("""
, d AS (SELECT station_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, max(temperature_c) AS high, min(temperature_c) AS low, count(*) AS n FROM readings WHERE temperature_c IS NOT NULL GROUP BY ALL),
e AS (SELECT d.* FROM d JOIN (SELECT station_id, greatest(3, floor(0.5 * quantile_cont(n, 0.5))) AS least_ FROM d GROUP BY ALL) USING (station_id) WHERE n >= least_), q AS (SELECT station_id, quantile_cont(high, 0.997) AS hot, quantile_cont(low, 0.003) AS cold FROM e GROUP BY ALL)
SELECT station_id, 'heat' AS kind, CAST(day AS VARCHAR) AS day, high AS score FROM e JOIN q USING (station_id) WHERE high >= hot UNION ALL SELECT station_id, 'cold', CAST(day AS VARCHAR), -low FROM e JOIN q USING (station_id) WHERE low <= cold
""")
def event_heat_cold(t: Tables) -> DataFrame:
    return dated(evaluation.hot_and_cold(t.readings), "day")


def _gridded(t: Tables) -> DataFrame:
    """Hourly means, so that readings exactly three hours apart exist."""
    return t.readings.groupBy("station_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("temperature_c").alias("temperature_c"))


@query("""
, g AS (SELECT station_id, date_trunc('hour', ts) AS ts, avg(temperature_c) AS v FROM readings GROUP BY ALL)
SELECT a.station_id, a.ts, round(abs(a.v - b.v), 6) AS score FROM g a JOIN g b ON a.station_id = b.station_id AND a.ts = b.ts + INTERVAL 3 HOUR WHERE a.v IS NOT NULL AND b.v IS NOT NULL
""")
def event_sharp(t: Tables) -> DataFrame:
    return rounded(evaluation.sharp(_gridded(t)), "score")


@query("""
, low AS (SELECT station_id, ts, base - pressure_hpa AS score, row_number() OVER (PARTITION BY station_id ORDER BY base - pressure_hpa DESC, ts) AS k FROM (
  SELECT *, quantile_cont(pressure_hpa, 0.5) OVER w AS base, count(*) OVER w AS held FROM readings WHERE pressure_hpa IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY us RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW)) WHERE held >= 20 AND pressure_hpa - base <= -10),
picked AS (SELECT station_id, k, ts, score, [ts] AS chosen FROM low WHERE k = 1
  UNION ALL SELECT p.station_id, l.k, l.ts, l.score, list_append(p.chosen, l.ts) FROM picked p JOIN LATERAL (
    SELECT * FROM low l WHERE l.station_id = p.station_id AND l.k > p.k AND len(list_filter(p.chosen, lambda c: abs(epoch_us(c) - epoch_us(l.ts)) <= 3 * 86400000000)) = 0 ORDER BY l.k LIMIT 1) l ON TRUE WHERE len(p.chosen) < 8)
SELECT station_id, ts, score FROM picked
""")
def greedy_separation(t: Tables) -> DataFrame:
    return evaluation.separated(evaluation.low_pressure(t.readings), evaluation.APART["low"], evaluation.MOST["low"])


_WINDOWS = """
, centres AS (SELECT station_id, ts, ts - INTERVAL 6 HOUR AS start_, ts + INTERVAL 6 HOUR AS end_ FROM readings WHERE temperature_c >= 45),
fresh AS (SELECT *, CASE WHEN start_ <= max(end_) OVER (PARTITION BY station_id ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM centres),
spans AS (SELECT station_id, w AS window_, min(start_) AS start_, max(end_) AS end_ FROM (SELECT *, sum(f) OVER (PARTITION BY station_id ORDER BY start_, end_) AS w FROM fresh) GROUP BY ALL)
"""


def _spans(t: Tables) -> DataFrame:
    return evaluation.merge(evaluation.windows(t.readings.filter("temperature_c >= 45").select("station_id", "ts"), 0.25).select("station_id", "start", "end"))


@query(_WINDOWS + "SELECT station_id, CAST(window_ AS BIGINT) AS num, start_, end_ FROM spans")
def merge_windows(t: Tables) -> DataFrame:
    return _spans(t).select("station_id", F.col("window").alias("num"), F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(_WINDOWS + """
, kept AS (SELECT r.station_id, r.seq, (SELECT count(*) FROM spans s WHERE s.station_id = r.station_id AND s.end_ < r.ts) AS chunk FROM readings r WHERE qc_flag = 0 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.station_id = r.station_id AND r.ts BETWEEN s.start_ AND s.end_))
SELECT station_id, seq, chunk FROM kept QUALIFY count(*) OVER (PARTITION BY station_id, chunk) >= 20
""")
def cut_chunks(t: Tables) -> DataFrame:
    return evaluation.chunks(t.readings, _spans(t), 20).select("station_id", "seq", "chunk")


@query(_WINDOWS + """
SELECT 'heat' AS kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(fault) AS BIGINT) AS fault, CAST(sum(suspect) AS BIGINT) AS suspect, CAST(sum(weather) AS BIGINT) AS weather, CAST(sum(valid) AS BIGINT) AS valid, count(*) AS windows, CAST(sum(hit) AS BIGINT) AS windows_with_fault FROM (
  SELECT s.station_id, s.window_, count(*) AS n, count(*) FILTER (verdict = 'FAULT') AS fault, count(*) FILTER (verdict = 'SUSPECT') AS suspect, count(*) FILTER (verdict = 'WEATHER') AS weather, count(*) FILTER (verdict = 'VALID') AS valid, max(CASE WHEN verdict = 'FAULT' THEN 1 ELSE 0 END) AS hit
  FROM spans s JOIN verdicts v ON v.station_id = s.station_id AND v.ts BETWEEN s.start_ AND s.end_ GROUP BY ALL) HAVING count(*) > 0
""")
def event_window_counts(t: Tables) -> DataFrame:
    spans = _spans(t).withColumnRenamed("window", "event").withColumn("kind", F.lit("heat"))
    return evaluation.event_counts(evaluation.inside(t.judged.select("station_id", "ts", "verdict"), spans))


@query("SELECT station_id, count(*) AS n, count(*) FILTER (verdict IN ('FAULT', 'SUSPECT')) AS alarm, count(*) FILTER (verdict = 'FAULT') AS fault, count(*) FILTER (verdict = 'WEATHER') AS weather FROM verdicts GROUP BY ALL")
def clean_counts(t: Tables) -> DataFrame:
    return evaluation.clean_counts(t.judged, "station_id")


@query("""
, c AS (SELECT station_id, count(*) AS n, count(*) FILTER (verdict IN ('FAULT', 'SUSPECT')) AS alarm FROM verdicts GROUP BY ALL), p AS (SELECT *, alarm / n AS p, 1.96::DOUBLE * 1.96::DOUBLE AS z2 FROM c)
SELECT station_id, alarm, n, round(100 * p, 6) AS percent, round(100 * (p + z2 / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS low, round(100 * (p + z2 / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS high FROM p
""")
def wilson_interval(t: Tables) -> DataFrame:
    counts = evaluation.clean_counts(t.judged, "station_id").select("station_id", "alarm", "n")
    return rounded(evaluation.shares(counts), "percent", "low", "high")


@query("""
SELECT r.station_id, count(*) FILTER (qc_flag > 0) AS flagged, count(*) FILTER (qc_flag > 0 AND verdict IN ('FAULT', 'SUSPECT')) AS flagged_caught, count(*) FILTER (qc_flag > 0 AND verdict <> 'VALID') AS flagged_escalated, count(*) FILTER (qc_flag = 2) AS erroneous,
  count(*) FILTER (qc_flag = 2 AND verdict IN ('FAULT', 'SUSPECT')) AS erroneous_caught, count(*) FILTER (qc_flag = 0) AS unflagged, count(*) FILTER (qc_flag = 0 AND verdict IN ('FAULT', 'SUSPECT')) AS unflagged_alarm, count(*) FILTER (qc_flag = 0 AND verdict <> 'VALID') AS unflagged_escalated
FROM verdicts v JOIN readings r USING (station_id, seq) GROUP BY ALL
""")
def qc_agreement(t: Tables) -> DataFrame:
    return evaluation.agreement(t.judged)


@query("SELECT station_id, segment, count(*) AS n FROM (SELECT station_id, CAST(sum(CASE WHEN g > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY seq) AS BIGINT) AS segment FROM (SELECT *, (us - lag(us) OVER (PARTITION BY station_id ORDER BY seq)) / 6e7 AS g FROM readings)) GROUP BY ALL HAVING count(*) >= 3")
def segments(t: Tables) -> DataFrame:
    return evaluation.segments(t.readings, 90 / 1440, 3).groupBy("station_id", "segment").agg(F.count("*").alias("n"))


@query("SELECT station_id, CAST(year(ts) AS INTEGER) AS year, round_even(count(*) / (CASE WHEN year(ts) % 4 = 0 THEN 366 ELSE 365 END * 48.0::DOUBLE), 3) AS share FROM readings GROUP BY station_id, year(ts)")
def coverage(t: Tables) -> DataFrame:
    return evaluation.coverage(t.readings, CADENCE)


@query("""
, d AS (SELECT station_id, CAST(ts AS DATE) AS day, count(*) AS n FROM readings GROUP BY ALL), c AS (SELECT station_id, CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY station_id),
g AS (SELECT station_id, day, sum(CASE WHEN coalesce(n, 0) >= 24 THEN 1 ELSE 0 END) OVER w AS held, count(*) OVER w AS width FROM c LEFT JOIN d USING (station_id, day) WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT station_id, CAST(CAST(min(day) - 6 AS DATE) AS VARCHAR) AS start_, CAST(CAST(min(day) + 1 AS DATE) AS VARCHAR) AS end_ FROM g WHERE width = 7 AND held >= 0.9 * 7 GROUP BY station_id
""")
def warm_stretch(t: Tables) -> DataFrame:
    # Half of the nominal samples make a regular day of this adapter.
    cadence = t.stations.select("station_id", (F.col("cadence_minutes") * 1.8).alias("cadence_minutes"))
    return evaluation.warm_stretch(t.readings, cadence, days=7).select("station_id", F.col("start").cast("string").alias("start_"), F.col("end").cast("string").alias("end_"))


@query("""
SELECT station_id, seq, verdict, CASE WHEN bool_or(range_flag) THEN 'FAULT' ELSE 'VALID' END AS baseline_range, CASE WHEN bool_or(range_flag OR frozen_flag) THEN 'FAULT' ELSE 'VALID' END AS baseline_persistence,
  CASE WHEN bool_or(range_flag OR frozen_flag OR plain_step OR m.value IS NULL) THEN 'FAULT' ELSE 'VALID' END AS baseline_rules, CASE WHEN bool_or(normality_flag) THEN 'FAULT' ELSE 'VALID' END AS baseline_climatology FROM marked m JOIN verdicts v USING (station_id, seq) GROUP BY ALL
""")
def baselines(t: Tables) -> DataFrame:
    names = ["baseline_range", "baseline_persistence", "baseline_rules", "baseline_climatology"]
    return evaluation.baselines(t.features).join(t.judged.select("station_id", "seq", "verdict"), ["station_id", "seq"]).select("station_id", "seq", "verdict", *names)


@query("SELECT m.station_id, m.seq, m.temperature_c AS a, m.temperature_c + 1 AS b FROM readings m WHERE seq % 7 = 0 AND temperature_c IS NOT NULL")
def run_difference(t: Tables) -> DataFrame:
    a = t.readings.filter("temperature_c IS NOT NULL")
    b = a.withColumn("temperature_c", F.when(F.col("seq") % 7 == 0, F.col("temperature_c") + 1).otherwise(F.col("temperature_c")))
    return evaluation.difference(a, b, ["station_id", "seq"], "temperature_c")


#: The verdicts of two runs, the second without the statistical models: what differs, by path.
_OFF = "SELECT 'full' AS config, []::VARCHAR[] AS off UNION ALL SELECT 'plain', ['isolation_forest', 'mahalanobis']"


@query(oracles.configured(_OFF) + """
, runs_of AS (SELECT c.config, c.station_id, c.seq, c.verdict, c.confidence, coalesce(f.kinds, []) AS kinds FROM verdicts_c c LEFT JOIN (
  SELECT config, station_id, seq, list(kind ORDER BY place) AS kinds FROM listed, configs_ WHERE NOT list_contains(off, kind) GROUP BY ALL) f USING (config, station_id, seq)),
leaves AS (
  SELECT config, station_id, seq, '/told/verdict' AS path, verdict AS x FROM runs_of UNION ALL SELECT config, station_id, seq, '/told/confidence', CAST(confidence AS VARCHAR) FROM runs_of
  UNION ALL SELECT config, station_id, seq, '/told/kinds', CAST(len(kinds) AS VARCHAR) FROM runs_of
  UNION ALL SELECT config, station_id, seq, '/told/kinds[' || i || ']', kinds[i + 1] FROM (SELECT *, unnest(range(len(kinds))) AS i FROM runs_of))
SELECT a.station_id, a.seq, a.path, CASE WHEN b.x IS NULL THEN 'missing' ELSE 'changed' END AS what FROM (FROM leaves WHERE config = 'full') a LEFT JOIN (FROM leaves WHERE config = 'plain') b ON b.station_id = a.station_id AND b.seq = a.seq AND b.path = a.path
WHERE b.x IS NULL OR (a.path <> '/told/confidence' AND a.x <> b.x) OR (a.path = '/told/confidence' AND abs(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE)) >= 1e-9)
""")
def run_compare(t: Tables) -> DataFrame:
    judged = engine.judge(t.readings, t.stations, t.models)
    kinds = F.transform(F.filter("checks", lambda x: x["flagged"]), lambda x: x["kind"]).alias("kinds")
    both = [stored(x.select("station_id", "seq", F.struct("verdict", "confidence", kinds).alias("told"), F.monotonically_increasing_id().alias("run_id"))) for x in (judged, studies.without(judged, ("isolation_forest", "mahalanobis")))]
    return evaluation.run_differences(*both, ["station_id", "seq"], ignore=("run_id",)).select("station_id", "seq", "path", "what")


# Systems side by side.

_SYSTEMS = _WINDOWS + """
, placed_ AS (SELECT r.station_id, r.seq, max(s.window_) AS event, any_value(r.qc_flag) AS qc_flag FROM readings r LEFT JOIN spans s ON s.station_id = r.station_id AND r.ts BETWEEN s.start_ AND s.end_ GROUP BY r.station_id, r.seq),
simple AS (SELECT station_id, seq, CASE WHEN bool_or(range_flag) THEN 'FAULT' ELSE 'VALID' END AS r, CASE WHEN bool_or(range_flag OR frozen_flag OR plain_step OR value IS NULL) THEN 'FAULT' ELSE 'VALID' END AS b, CASE WHEN bool_or(normality_flag) THEN 'FAULT' ELSE 'VALID' END AS c FROM marked GROUP BY ALL),
systems AS (SELECT p.*, x.system, x.verdict FROM placed_ p JOIN (
  SELECT 'full' AS system, station_id, seq, verdict FROM verdicts UNION ALL SELECT 'range', station_id, seq, r FROM simple UNION ALL SELECT 'rules', station_id, seq, b FROM simple UNION ALL SELECT 'climatology', station_id, seq, c FROM simple) x USING (station_id, seq)),
counted AS (SELECT system, count(*) FILTER (event IS NULL) AS clean_n, count(*) FILTER (event IS NULL AND verdict IN ('FAULT', 'SUSPECT')) AS clean_alarm, count(*) FILTER (event IS NULL AND verdict = 'FAULT') AS clean_fault, count(*) FILTER (event IS NOT NULL) AS event_n, count(*) FILTER (event IS NOT NULL AND verdict = 'FAULT') AS event_fault,
  count(*) FILTER (event IS NOT NULL AND verdict = 'SUSPECT') AS event_suspect, count(*) FILTER (event IS NOT NULL AND verdict = 'WEATHER') AS event_weather, count(DISTINCT {'s': station_id, 'e': event}) FILTER (event IS NOT NULL) AS windows, count(DISTINCT {'s': station_id, 'e': event}) FILTER (event IS NOT NULL AND verdict = 'FAULT') AS windows_with_fault FROM systems GROUP BY system),
kinds_ AS (SELECT system, CASE qc_flag WHEN 1 THEN 'suspect' ELSE 'erroneous' END AS fault_type, count(*) AS injected, count(*) FILTER (verdict IN ('FAULT', 'SUSPECT')) AS detected_new FROM systems WHERE qc_flag > 0 GROUP BY ALL)
"""


def _systems(t: Tables) -> DataFrame:
    """system, station_id, seq, verdict, qc_flag and event (of a hot spell, else null)."""
    spans = _spans(t).withColumnRenamed("window", "event")
    inside = evaluation.inside(t.judged.select("station_id", "seq", "ts"), spans, 0.0).groupBy("station_id", "seq").agg(F.max("event").alias("event"))
    simple = evaluation.baselines(t.features).select("station_id", "seq", "qc_flag", F.col("baseline_range").alias("range"), F.col("baseline_rules").alias("rules"), F.col("baseline_climatology").alias("climatology"))
    rows = simple.join(t.judged.select("station_id", "seq", F.col("verdict").alias("full")), ["station_id", "seq"]).join(inside, ["station_id", "seq"], "left")
    return rows.unpivot(["station_id", "seq", "qc_flag", "event"], ["full", "range", "rules", "climatology"], "system", "verdict")


def _kinds(rows: DataFrame) -> DataFrame:
    """What the source's own flags mark stands for injected faults."""
    found = rows.filter("qc_flag > 0").groupBy("system", F.when(F.col("qc_flag") == 1, "suspect").otherwise("erroneous").alias("fault_type"))
    return found.agg(F.count("*").alias("injected"), F.count_if(F.col("verdict").isin(*evaluation.ALARM)).alias("detected_new"))


@query(_SYSTEMS + "SELECT * FROM counted")
def system_counts(t: Tables) -> DataFrame:
    return studies.by_system(_systems(t))


@query(_SYSTEMS + """
, change AS (SELECT k.system, k.fault_type, 100 * (k.detected_new - f.detected_new) / f.injected AS change FROM kinds_ k JOIN kinds_ f ON f.system = 'full' AND f.fault_type = k.fault_type),
worst AS (SELECT system, least(0, min(change)) AS worst_change, CASE WHEN min(change) < 0 THEN arg_min(fault_type, {'a': change, 'b': fault_type}) END AS worst_type FROM change GROUP BY system)
SELECT c.system, round(worst_change, 6) AS worst_change, worst_type, 0.0::DOUBLE AS level_shift_gain, round(100 * (c.clean_alarm / c.clean_n - f.clean_alarm / f.clean_n), 6) AS clean_rise, round(100 * (coalesce(c.event_suspect / nullif(c.event_n, 0), 0) - coalesce(f.event_suspect / nullif(f.event_n, 0), 0)), 6) AS suspect_rise,
  c.windows_with_fault <= f.windows_with_fault AND coalesce(c.event_fault / nullif(c.event_n, 0), 0) <= coalesce(f.event_fault / nullif(f.event_n, 0), 0) AND worst_change >= -2 AND c.clean_alarm / c.clean_n - f.clean_alarm / f.clean_n <= 0.002 AS adopt
FROM counted c JOIN counted f ON f.system = 'full' AND c.system <> 'full' JOIN worst w ON w.system = c.system
""")
def decision_rules(t: Tables) -> DataFrame:
    rows = stored(_systems(t))
    return rounded(studies.decisions(studies.by_system(rows), _kinds(rows)), "worst_change", "level_shift_gain", "clean_rise", "suspect_rise")


@query(_SYSTEMS + """
SELECT c.system, arg_min(fault_type, {'a': 100 * detected_new / injected, 'b': fault_type}) AS weakest_type, round(min(100 * detected_new / injected), 6) AS weakest_percent, round(any_value(100 * clean_alarm / clean_n), 6) AS clean_alarm_percent, any_value(windows_with_fault) AS windows_with_fault, any_value(windows) AS windows FROM counted c JOIN kinds_ USING (system) GROUP BY c.system
""")
def tradeoff(t: Tables) -> DataFrame:
    rows = stored(_systems(t))
    return rounded(studies.tradeoff(studies.by_system(rows), _kinds(rows)), "weakest_percent", "clean_alarm_percent")


@query(_SYSTEMS + """
SELECT station_id, round(100 * count(*) FILTER (event IS NULL AND verdict IN ('FAULT', 'SUSPECT')) / count(*) FILTER (event IS NULL), 6) AS clean_alarm, round(100 * count(*) FILTER (event IS NULL AND verdict = 'FAULT') / count(*) FILTER (event IS NULL), 6) AS clean_fault,
  round(100 * count(*) FILTER (event IS NOT NULL AND verdict = 'FAULT') / nullif(count(*) FILTER (event IS NOT NULL), 0), 6) AS event_fault, round(100 * count(*) FILTER (event IS NOT NULL AND verdict = 'WEATHER') / nullif(count(*) FILTER (event IS NOT NULL), 0), 6) AS event_weather,
  count(DISTINCT event) AS windows, count(DISTINCT event) FILTER (verdict = 'FAULT') AS windows_with_fault, 30.0::DOUBLE AS cadence_minutes FROM systems WHERE system = 'full' GROUP BY station_id
""")
def station_table(t: Tables) -> DataFrame:
    return rounded(studies.by_station(_systems(t).filter("system = 'full'"), t.stations), "clean_alarm", "clean_fault", "event_fault", "event_weather")


@query(_WINDOWS + """
SELECT v.station_id, CAST(s.window_ AS BIGINT) AS event, v.seq, l.kind || coalesce(':' || l.channel, '') AS check_name, l.severity FROM verdicts v JOIN spans s ON s.station_id = v.station_id AND v.ts BETWEEN s.start_ AND s.end_ JOIN listed l ON l.station_id = v.station_id AND l.seq = v.seq WHERE verdict = 'FAULT'
""")
def window_forensics(t: Tables) -> DataFrame:
    rows = evaluation.inside(t.judged, _spans(t).withColumnRenamed("window", "event"))
    return studies.forensics(rows).select("station_id", "event", "seq", F.col("check").alias("check_name"), "severity")


@query()
def distance_baseline(t: Tables) -> DataFrame:
    return studies.raw_distance(t.plain).groupBy("station_id", "baseline_distance").agg(F.count("*").alias("n"))


# Injection.


def _plan(t: Tables) -> DataFrame:
    """One fault of each kind a station, at fixed places."""
    kinds = [(0, "frozen", CHANNELS[0], 10, 17), (1, "spike", CHANNELS[1], 30, 30), (2, "step", CHANNELS[2], 45, 46), (3, "drift", CHANNELS[0], 55, 66), (4, "dropout", CHANNELS[1], 75, 75)]
    rows = F.array(*[F.struct(F.lit(e).alias("event"), F.lit(k).alias("fault_type"), F.lit(c).alias("channel"), F.lit(a).cast("long").alias("start_index"), F.lit(b).cast("long").alias("end_index")) for e, k, c, a, b in kinds])
    return t.stations.select("station_id", F.explode(rows).alias("x")).select("station_id", "x.*", F.lit(1.0).alias("sign"))


_FAULTED = """
  SELECT n.station_id, n.seq, n.ts, n.us, n.idx, CASE WHEN idx BETWEEN 10 AND 17 THEN hold WHEN idx BETWEEN 55 AND 66 THEN temperature_c + 5.0::DOUBLE * (idx - 54) / 12 ELSE temperature_c END AS temperature_c, CASE WHEN idx = 30 THEN pressure_hpa + 15 WHEN idx = 75 THEN NULL ELSE pressure_hpa END AS pressure_hpa,
  CASE WHEN idx IN (45, 46) THEN humidity_pct + 45 ELSE humidity_pct END AS humidity_pct, CASE WHEN idx BETWEEN 10 AND 17 THEN 'frozen' WHEN idx = 30 THEN 'spike' WHEN idx IN (45, 46) THEN 'step' WHEN idx BETWEEN 55 AND 66 THEN 'drift' WHEN idx = 75 THEN 'dropout' END AS fault_type, n.qc_flag
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY seq) - 1 AS idx FROM readings) n LEFT JOIN (SELECT station_id, temperature_c AS hold FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY seq) - 1 AS idx FROM readings) WHERE idx = 9) h USING (station_id)
"""


@query("SELECT station_id, idx, temperature_c, pressure_hpa, humidity_pct, fault_type FROM (" + _FAULTED + ")")
def inject_faults(t: Tables) -> DataFrame:
    return injection.inject(t.readings, _plan(t), CADENCE).select("station_id", "idx", *CHANNELS, "fault_type")


@query(oracles.judging(_FAULTED) + """
, plan_ AS (SELECT * FROM (VALUES (0, 'frozen', 10, 17), (1, 'spike', 30, 30), (2, 'step', 45, 46), (3, 'drift', 55, 66), (4, 'dropout', 75, 75)) p(event, fault_type, a, b)),
hits AS (SELECT r.station_id, p.event, p.fault_type, r.idx - p.a AS place, f.verdict IN ('FAULT', 'SUSPECT') AS alarm, c.verdict IN ('FAULT', 'SUSPECT') AS was, f.verdict AS v, c.verdict AS w
  FROM plan_ p JOIN readings_f r ON r.idx BETWEEN p.a AND p.b + 2 JOIN verdicts_f f ON f.station_id = r.station_id AND f.seq = r.seq JOIN verdicts c ON c.station_id = r.station_id AND c.seq = r.seq)
SELECT station_id, CAST(event AS INTEGER) AS event, fault_type, bool_or(alarm) AS detected, bool_or(alarm AND NOT was) AS detected_new, CAST(min(place) FILTER (alarm) * 30 AS DOUBLE) AS delay_minutes, CAST(min(place) FILTER (alarm AND NOT was) * 30 AS DOUBLE) AS delay_new_minutes,
  bool_or(alarm AND NOT was) AND bool_or(v = 'FAULT' AND w <> 'FAULT') AS named_fault, NOT bool_or(alarm AND NOT was) AND bool_or(v = 'WEATHER' AND w <> 'WEATHER') AS masked_as_weather FROM hits GROUP BY ALL
""")
def detection_paired(t: Tables) -> DataFrame:
    faulted = stored(evaluation.upto_events(injection.inject(t.readings, _plan(t), CADENCE), _plan(t), CADENCE))
    columns = ("station_id", "seq", "ts", "idx")
    both = [faulted.select(*columns, *CHANNELS), faulted.select(*columns, *[F.col(f"raw_{c}").alias(c) for c in CHANNELS])]
    judged, clean = (engine.judge(x, t.stations, t.models).select("station_id", "idx", "verdict") for x in both)
    return evaluation.detection(_plan(t), judged, clean, CADENCE)


_FACTORS = (0.25, 1.0, 4.0)
_SWEPT = ", sweep_ AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', {x}::DOUBLE)" for x in _FACTORS) + ") x(name, factor))" + oracles.judging("""
  SELECT n.* REPLACE (n.station_id || '|' || f.name AS station_id, CASE WHEN idx = 30 THEN pressure_hpa + 15 * factor ELSE pressure_hpa END AS pressure_hpa, CASE WHEN idx IN (45, 46) THEN humidity_pct + 45 * factor ELSE humidity_pct END AS humidity_pct), n.station_id AS base, factor
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY seq) - 1 AS idx FROM readings) n, sweep_ f
""", "_s", given={x: f"SELECT m.* REPLACE (m.station_id || '|' || f.name AS station_id) FROM {x} m, sweep_ f" for x in ("cells", "limits", "history_rows", "factors", "far_limit", "forest_nodes", "forest_sizes", "forest_limit")})


@query(_SWEPT + """
, plan_ AS (SELECT * FROM (VALUES ('spike', 30, 30), ('step', 45, 46)) p(fault_type, a, b)),
hits AS (SELECT r.base, r.factor, p.fault_type, bool_or(f.verdict IN ('FAULT', 'SUSPECT') AND c.verdict NOT IN ('FAULT', 'SUSPECT')) AS new
  FROM plan_ p JOIN readings_s r ON r.idx BETWEEN p.a AND p.b + 2 JOIN verdicts_s f ON f.station_id = r.station_id AND f.seq = r.seq JOIN verdicts c ON c.station_id = r.base AND c.seq = r.seq GROUP BY ALL)
SELECT fault_type, factor AS severity, count(*) AS injected, count(*) FILTER (new) AS detected_new, round(100 * avg(CAST(new AS DOUBLE)), 6) AS percent FROM hits GROUP BY ALL
""")
def severity_sweep(t: Tables) -> DataFrame:
    clean = t.judged.select("station_id", (F.col("place") - 1).alias("idx"), "verdict")
    swept = studies.severity_sweep(t.readings, _plan(t), t.stations, t.models, clean, CADENCE, _FACTORS)
    return rounded(studies.by_severity(swept), "percent")


@query()
def make_plan(t: Tables) -> DataFrame:
    return injection.make_plan(t.readings.groupBy("station_id").agg(F.count("*").alias("n")), CADENCE)


# Devices.


@query("""
, samples AS (SELECT 'D' || CAST(user_id % 3 AS VARCHAR) AS station_id, date_trunc('minute', TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * event_id) AS minute, CASE WHEN event_type = 'error' THEN 999 ELSE value / 10 END::DOUBLE AS v, 950 + k AS p, (k % 60 + 30)::DOUBLE AS h FROM base_)
SELECT station_id, minute, count(*) AS samples, CASE WHEN count(*) FILTER (v BETWEEN -90 AND 60) >= 12 THEN round(CAST(avg(v) FILTER (v BETWEEN -90 AND 60) AS FLOAT)::DOUBLE, 3) END AS temperature_c, count(*) FILTER (v > 60) > 0 AS out_of_range FROM samples GROUP BY ALL
""")
def edge_minute(t: Tables) -> DataFrame:
    raw = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    samples = raw.select(
        F.concat(F.lit("D"), (F.col("user_id") % 3).cast("string")).alias("station_id"), F.expr("timestampadd(SECOND, event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"),
        F.when(F.col("event_type") == "error", 999.0).otherwise(F.col("value") / 10).alias("temperature_c"), (950.0 + k).alias("pressure_hpa"), (k % 60 + 30).cast("double").alias("humidity_pct"))
    s = replace(DEFAULT, edge=replace(DEFAULT.edge, min_valid=12))
    out = edge.minutes(samples, s)
    return out.select("station_id", "minute", "samples", F.round(F.col("temperature_c").cast("double"), 3).alias("temperature_c"), F.array_contains("flags", "range:temperature_c").alias("out_of_range"))
