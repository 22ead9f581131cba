"""Distance of a reading's departures and rates from the station's clean centre, in units of its covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import stored
from ..settings import CHANNELS, DEFAULT, Settings
from .checks import Check

FEATURES = tuple(f"d_{c}" for c in CHANNELS) + tuple(f"r_{c}" for c in CHANNELS)
FLOAT32_MAX = 3.4028234e38


def rates(features: DataFrame) -> DataFrame:
    """Rates per minute, the hour's angle and whether a row is usable: time goes on, no value is missing now or before."""
    angle = 2 * 3.141592653589793 * (F.hour("ts") + F.minute("ts") / 60.0) / 24.0
    usable = F.coalesce(F.col("dt1") > 0, F.lit(False))
    new = {}
    for c in CHANNELS:
        usable = usable & F.col(c).isNotNull() & F.col(f"{c}_1").isNotNull()
        new[f"r_{c}"] = (F.col(c) - F.col(f"{c}_1")) / F.nullif("dt1", F.lit(0.0))
    for c in CHANNELS:
        usable = usable & (F.abs(c) < FLOAT32_MAX) & (F.abs(new[f"r_{c}"]) < FLOAT32_MAX)
    return features.withColumns(new | {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "usable": F.coalesce(usable, F.lit(False))})


def departures(features: DataFrame, uses_table: bool = True) -> DataFrame:
    out = rates(features)
    new = {f"d_{c}": F.col(c) - F.col(f"smooth_{c}") if uses_table else F.col(c) for c in CHANNELS}
    out = out.withColumns(new)
    if uses_table:
        out = out.withColumn("usable", F.col("usable") & F.col("d_temperature_c").isNotNull() & F.col("d_pressure_hpa").isNotNull() & F.col("d_humidity_pct").isNotNull())
    return out


def covariance(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, n, means, upper triangle of the sample covariance by row) from usable rows."""
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    out = rows.filter("usable").groupBy("station_id").agg(F.count("*").alias("n"), F.array(*[F.avg(f) for f in FEATURES]).alias("mean"), F.array(*[F.covar_samp(a, b) for a, b in pairs]).alias("cov"))
    return out.filter(F.col("n") >= s.models.min_rows)


def fit(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, mean, inv_cov row by row, threshold); rows from departures(). One 6 x 6 inverse a station."""
    import pandas as pd

    ridge = s.models.ridge

    def inverse(batches):
        import numpy as np

        upper = np.triu_indices(6)
        for frame in batches:
            out = []
            for cov in frame["cov"]:
                m = np.zeros((6, 6))
                m[upper] = cov
                m = m + np.triu(m, 1).T + ridge * np.eye(6)
                out.append(np.linalg.inv(m).ravel())
            yield pd.DataFrame({"station_id": frame["station_id"], "mean": frame["mean"], "inv_cov": out})

    rows = stored(rows.filter("usable").select("station_id", "usable", *FEATURES))
    models = covariance(rows, s).select("station_id", "mean", "cov").mapInPandas(inverse, "station_id string, mean array<double>, inv_cov array<double>")
    models = stored(models)
    limit = distances(rows, models).filter("d2 IS NOT NULL").groupBy("station_id").agg(F.expr(f"percentile(d2, {s.models.distance_quantile}D)").alias("threshold"))
    return models.join(limit, "station_id")


def distances(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows with d2, the six contributions and the feature that contributes most (null where a row is not usable)."""
    joined = rows.join(models, "station_id", "left")
    d = F.array(*[F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)])
    joined = joined.withColumn("dev", F.when(F.col("usable") & F.col("mean").isNotNull(), d))
    parts = []
    for i in range(6):
        total = F.lit(0.0)
        for j in range(6):
            total = total + F.col("inv_cov")[6 * i + j] * F.col("dev")[j]
        parts.append(F.col("dev")[i] * total)
    joined = joined.withColumn("contributions", F.when(F.col("dev").isNotNull(), F.array(*parts)))
    ranked = F.array_sort(F.zip_with("contributions", F.array(*map(F.lit, FEATURES)), lambda v, n: F.struct((-v).alias("v"), n.alias("n"))))
    return joined.withColumns({"d2": F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v), "top_feature": F.try_element_at(ranked, F.lit(1))["n"]}).drop("dev")


def check() -> Check:
    return Check("mahalanobis", None, F.col("d2") > F.col("threshold"), True, F.col("d2"))


def ranked_contributions() -> Column:
    """Contributions by size, largest first."""
    return F.array_sort(F.zip_with("contributions", F.array(*map(F.lit, FEATURES)), lambda v, n: F.struct((-F.abs(v)).alias("order"), n.alias("feature"), v.alias("contribution"))))


def explain(rows: DataFrame, distance: DataFrame, forests: DataFrame | None = None) -> DataFrame:
    """Why the statistical layers found rows (departures() and rates() done) unusual: their squared distance with its exact
    contributions by size, and the forest's score, both against their thresholds. Not available where a row is not usable."""
    out = distances(rows, distance)
    told = [F.col("d2").isNotNull().alias("available"), F.bround("d2", 3).alias("distance2"), F.bround("threshold", 3).alias("distance_threshold"), (F.col("d2") > F.col("threshold")).alias("far"),
            F.transform(ranked_contributions(), lambda x: F.struct(x["feature"].alias("feature"), F.bround(x["contribution"], 4).alias("value"))).alias("contributions")]
    if forests is not None:
        from . import forest

        out = forest.attach(out, forests).join(forests.select("station_id", F.col("threshold").alias("iforest_threshold")), "station_id", "left")
        told += [F.bround("iforest_score", 4).alias("forest_score"), F.bround("iforest_threshold", 4).alias("forest_threshold"), forest.rare().alias("rare")]
    return out.select("station_id", "seq", "ts", *told)


def explain_latest(rows: DataFrame, distance: DataFrame, station: str, seq: int | None = None, forests: DataFrame | None = None, newest: int = 60) -> DataFrame:
    """explain() of a station's latest row, or of a certain one among its newest rows."""
    recent = rows.filter(F.col("station_id") == station).orderBy(F.desc("ts"), F.desc("seq")).limit(newest)
    return explain(recent.limit(1) if seq is None else recent.filter(F.col("seq") == seq), distance, forests)
