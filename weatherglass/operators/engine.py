"""The batch pipeline: readings -> features -> checks -> verdicts -> records, estimates, health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import stored
from ..settings import CHANNELS, DEFAULT, Settings
from . import checks, clock, features, forest, fusion, mahalanobis, normality
from . import limits as learned


@dataclass
class Models:
    """What clean history has taught, as tables by station. A layer without its table does not run."""

    cells: DataFrame | None = None
    limits: DataFrame | None = None
    distance: DataFrame | None = None
    forest: DataFrame | None = None

    def named(self, names: DataFrame) -> Models:
        """The same models under other names: names (station_id, base) may have several for a station (base)."""
        pairs = names.select(F.col("base").alias("base_"), F.col("station_id").alias("name_"))

        def under(table: DataFrame | None) -> DataFrame | None:
            return table and table.join(pairs, F.col("station_id") == F.col("base_")).drop("station_id", "base_").withColumnRenamed("name_", "station_id")

        return Models(under(self.cells), under(self.limits), under(self.distance), under(self.forest))


def train(clean: DataFrame, stations: DataFrame, s: Settings = DEFAULT, *, limits: DataFrame | None = None) -> Models:
    """All models of the layers that are on. limits: known ones, instead of those learned from clean."""
    cells = stored(normality.fit(clean, s))
    own = stored(learned.fit(clean, stations, s)) if limits is None and s.layers.limits else limits
    rows = features.features(clean, stations, cells, None, s, measure=False)
    distance = mahalanobis.fit(mahalanobis.departures(rows), s) if s.layers.mahalanobis else None
    return Models(cells, own, distance and stored(distance), stored(forest.fit(mahalanobis.rates(rows), s)) if s.layers.mlmodel else None)


def judge(readings: DataFrame, stations: DataFrame, models: Models, s: Settings = DEFAULT, *, now=None, clock_results: DataFrame | None = None) -> DataFrame:
    """readings with checks, verdict, confidence, reason and flagged channels. clock_results: those of clock.results, if they
    are there already."""
    with_clock = s.layers.timing and models.cells is not None
    results = clock_results
    if with_clock and results is None:
        results = stored(clock.results(readings, stations, models.cells, models.limits, s))
    rows = features.features(readings, stations, models.cells, models.limits, s, clock=results if with_clock else None)
    found: list[checks.Check] = []
    if models.forest is not None and s.layers.mlmodel:
        rows = forest.attach(mahalanobis.rates(rows), models.forest)
        rows = rows.join(models.forest.select("station_id", F.col("threshold").alias("iforest_threshold")), "station_id", "left")
        found.append(forest.check())
    if models.distance is not None and s.layers.mahalanobis:
        rows = mahalanobis.distances(mahalanobis.departures(rows), models.distance)
        found.append(mahalanobis.check())
    return decided(checks.apply(rows, checks.all_checks(s, now=now, with_clock=with_clock, models=found)), s)


def decided(checked: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return fusion.fuse(checked, s).withColumn("flagged_channels", fusion.flagged_channels(s))


#: Columns of a stored record, besides those that estimates and health need.
RECORD = ("station_id", "seq", "ts", *CHANNELS, "verdict", "confidence", "reason", "notices", "flagged_channels", "checks")
BESIDE = ("us", "place", "cadence_minutes", "rule", "signature", "coherent", *(f"{x}_{c}" for x in ("smooth", "s") for c in CHANNELS))


def records(judged: DataFrame, *more: str) -> DataFrame:
    """The columns that are stored."""
    return judged.select(*RECORD, *BESIDE, *more, F.to_date("ts").alias("day"))
