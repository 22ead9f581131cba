"""The cold-start run: how would each station have been judged, had it just begun, with a pattern borrowed from the others and
without?

Every station is taken in turn for a new one, with so many days of own history, in two modes. A station, days and mode together
are a scenario, and each scenario is a station of its own for the engine: what the scenarios have learned and how they judge
are then the same few aggregations and one judgement for all of them. What a station borrows comes from sums over all stations
less its own, so that no pairs of stations are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import MINUTE, micros, stored
from ..settings import CHANNELS, DEFAULT, Settings
from . import coldstart, engine, features, forest, mahalanobis, normality
from . import limits as learned

#: Days of own history, and the readings from which a station has own cells and own limits (fixed values).
DAYS = (0, 7, 30, 90, 180, 365, 1460)
MORE_THAN_CELLS, MORE_THAN_LIMITS = 50, 200
#: Own history from which the forest and the distance learn (fixed value).
MODELS_FROM_DAYS = 90
MODES = ("starter", "own_only")
BORROWED = ("frozen_minutes", "noise_std", "typical_step")


def borrowed_cells(cells: DataFrame, stations: DataFrame, borrow: DataFrame | None = None) -> DataFrame:
    """Each station's (station_id) starter: the mean pattern of all others, or of those in borrow (station_id, other). Sums are of
    departures from the mean of all, so that taking a station's own off loses no digits. At most 864 sums are broadcast."""
    if borrow is not None:
        return coldstart.pool(borrow.select("station_id", "other").join(cells.withColumnRenamed("station_id", "other"), "other"), ["station_id"])
    middle = cells.groupBy(*coldstart.CELL).agg(F.avg("mean").alias("middle"))
    own = cells.join(F.broadcast(middle), coldstart.CELL).withColumn("d", F.col("mean") - F.col("middle")).withColumn("q", F.col("std") * F.col("std") + F.col("d") * F.col("d"))
    total = own.groupBy(*coldstart.CELL).agg(F.first("middle").alias("middle"), F.sum("d").alias("all_d"), F.sum("q").alias("all_q"), F.sum("n").alias("all_n"), F.count("*").alias("all_k"))
    rows = stations.select("station_id").crossJoin(F.broadcast(total)).join(own.select("station_id", *coldstart.CELL, "d", "q", "n"), ["station_id", *coldstart.CELL], "left")
    k = F.col("all_k") - F.col("d").isNotNull().cast("int")
    rows = rows.withColumns({"k": k, "d": F.col("all_d") - F.coalesce("d", F.lit(0.0)), "q": F.col("all_q") - F.coalesce("q", F.lit(0.0))}).filter("k > 0")
    d = F.col("d") / F.col("k")
    return rows.select("station_id", *coldstart.CELL, (F.col("middle") + d).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("k") - d * d)).alias("std"), (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"))


def borrowed_limits(limits: DataFrame, stations: DataFrame, borrow: DataFrame | None = None) -> DataFrame:
    """(station_id, channel, resolution and BORROWED) of each station's others: the mean of their limits (zero ones don't count)
    and the coarsest resolution."""
    known = limits.select("station_id", "channel", "resolution", *[F.nullif(x, F.lit(0.0)).alias(x) for x in BORROWED])
    if borrow is not None:
        joined = borrow.select("station_id", "other").join(known.withColumnRenamed("station_id", "other"), "other")
        return joined.groupBy("station_id", "channel").agg(F.max("resolution").alias("resolution"), *[F.avg(x).alias(x) for x in BORROWED])
    top = known.groupBy("channel").agg(F.max(F.when(F.col("resolution").isNotNull(), F.struct("resolution", "station_id"))).alias("top"))
    rest = known.join(F.broadcast(top), "channel").filter(F.col("top").isNull() | (F.col("station_id") != F.col("top.station_id")))
    second = rest.groupBy("channel").agg(F.max("resolution").alias("second"))
    total = known.groupBy("channel").agg(*[f(x).alias(f"{n}_{x}") for x in BORROWED for n, f in (("sum", F.sum), ("count", F.count))]).join(top, "channel").join(second, "channel", "left")
    rows = stations.select("station_id").crossJoin(F.broadcast(total)).join(known.drop("resolution"), ["station_id", "channel"], "left")

    def others(x: str) -> Column:
        n = F.col(f"count_{x}") - F.col(x).isNotNull().cast("int")
        return F.when(n > 0, (F.col(f"sum_{x}") - F.coalesce(x, F.lit(0.0))) / n)

    return rows.select("station_id", "channel", F.when(F.col("top.station_id") == F.col("station_id"), F.col("second")).otherwise(F.col("top.resolution")).alias("resolution"), *[others(x).alias(x) for x in BORROWED])


def scenarios(stations: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """(station_id, base, own, days, mode, cadence_minutes): station_id names the scenario, base its station, own its history."""
    each = F.array(*[F.struct(F.lit(d).alias("days"), F.lit(m).alias("mode")) for d in days for m in MODES])
    rows = stations.select(F.col("station_id").alias("base"), "cadence_minutes", F.explode(each).alias("x")).select("base", "cadence_minutes", "x.*")
    return rows.withColumns({"own": F.concat_ws("|", "base", F.col("days").cast("string")), "station_id": F.concat_ws("|", "base", F.col("days").cast("string"), "mode")})


def histories(readings: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """readings of the first days of each station, once for each number of days; station_id is then that of the history."""
    first = readings.groupBy("station_id").agg(F.min(micros("ts")).alias("first_"))
    within = F.filter(F.array(*map(F.lit, days)), lambda d: micros("ts") < F.col("first_") + d.cast("long") * (1440 * MINUTE))
    rows = readings.join(first, "station_id").withColumn("days", F.explode(within)).drop("first_")
    return rows.withColumn("station_id", F.concat_ws("|", "station_id", F.col("days").cast("string")))


def models(clean: DataFrame, stations: DataFrame, cells: DataFrame, limits: DataFrame, days: tuple[int, ...] = DAYS, s: Settings = DEFAULT, borrow: DataFrame | None = None) -> engine.Models:
    """What each scenario knows. clean: the stations' own clean history; cells and limits: those that all stations have learned
    from all of theirs, to be borrowed."""
    every, own = stored(scenarios(stations, days)), histories(clean, days)
    facts = stored(own.groupBy("station_id").agg(F.count("*").alias("rows"), F.count_distinct(F.to_date("ts")).alias("own_days")))
    known = every.select(F.col("own").alias("station_id"), "cadence_minutes").distinct()

    def taught(rows: DataFrame, more_than: int) -> DataFrame:
        return rows.join(facts.filter(F.col("rows") > more_than).select("station_id"), "station_id", "left_semi")

    def of_mode(mode: str, rows: DataFrame, by: str) -> DataFrame:
        named = every.filter(F.col("mode") == mode).select(F.col(by).alias("k_"), F.col("station_id").alias("name_"))
        return rows.join(named, rows["station_id"] == F.col("k_")).drop("station_id", "k_").withColumnRenamed("name_", "station_id")

    own_cells = stored(taught(normality.fit(own, s), MORE_THAN_CELLS))
    own_limits = stored(taught(learned.fit(own, known, s), MORE_THAN_LIMITS))
    start = borrowed_cells(cells, stations, borrow)
    columns = ("station_id", *coldstart.CELL, "mean", "std", "n")
    patterns = coldstart.blend(of_mode("starter", start, "base"), of_mode("starter", own_cells, "own"), s).select(*columns).unionByName(of_mode("own_only", own_cells, "own").select(*columns))
    base = of_mode("starter", borrowed_limits(limits, stations, borrow), "base").select("station_id", "channel", *[F.col(x).alias(f"base_{x}") for x in ("resolution", *BORROWED)])
    weight = F.least(F.lit(1.0), F.coalesce("own_days", F.lit(0)) / s.coldstart.days)
    rows = base.join(of_mode("starter", own_limits, "own").select("station_id", "channel", "resolution", *BORROWED, "n_runs"), ["station_id", "channel"], "left")
    rows = rows.join(every.select("station_id", "own", "cadence_minutes"), "station_id").join(facts.select(F.col("station_id").alias("own"), "own_days"), "own", "left").withColumn("w", weight)
    mixed = [F.coalesce(F.col("w") * F.col(x) + (1 - F.col("w")) * F.col(f"base_{x}"), x, f"base_{x}").alias(x) for x in BORROWED]
    names = ("station_id", "cadence_minutes", "channel", "resolution", *BORROWED, "step_cap", "n_runs")
    blended = rows.select("station_id", "cadence_minutes", "channel", F.coalesce("resolution", "base_resolution").alias("resolution"), *mixed, F.lit(None).cast("double").alias("step_cap"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"))
    out = engine.Models(stored(patterns), stored(blended.select(*names).unionByName(of_mode("own_only", own_limits, "own").select(*names))))
    if any(d >= MODELS_FROM_DAYS for d in days):
        long = taught(own, MORE_THAN_LIMITS).filter(F.col("days") >= MODELS_FROM_DAYS).drop("days")
        seen = features.features(of_mode("starter", long, "own").unionByName(of_mode("own_only", long, "own")), every, out.cells, None, s, measure=False)
        out.distance = stored(mahalanobis.fit(mahalanobis.departures(seen), s)) if s.layers.mahalanobis else None
        out.forest = stored(forest.fit(mahalanobis.rates(seen), s)) if s.layers.mlmodel else None
    return out


def judged(readings: DataFrame, stations: DataFrame, known: engine.Models, days: tuple[int, ...] = DAYS, s: Settings = DEFAULT) -> DataFrame:
    """engine.judge's rows of readings that no scenario has learned from, with days, mode and scenario; station_id is the
    station's again."""
    every = scenarios(stations, days)
    rows = readings.withColumnRenamed("station_id", "base").join(every.select("base", "station_id"), "base").select("station_id", "seq", "ts", *CHANNELS)
    out = engine.judge(rows, every, known, s).withColumnRenamed("station_id", "scenario")
    return out.join(every.select(F.col("station_id").alias("scenario"), F.col("base").alias("station_id"), "days", "mode"), "scenario")
