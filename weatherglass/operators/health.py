"""Sensor health: daily residuals, drift (Theil-Sen with a test for autocorrelated days), scores and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import MINUTE, clamp
from ..settings import CHANNELS, DEFAULT, Settings


def daily_residuals(fused: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, channel, day, sum, n): clipped departures from the smooth expected value; a channel's faults are left out.
    fused needs verdict, flagged_channels, smooth_ and s_ columns."""
    parts = []
    for c in CHANNELS:
        used = F.col(c).isNotNull() & F.col(f"smooth_{c}").isNotNull() & F.col(f"s_{c}").isNotNull() & ~((F.col("verdict") == "FAULT") & F.array_contains("flagged_channels", c))
        parts.append(F.when(used, F.struct(F.lit(c).alias("channel"), clamp(F.col(c) - F.col(f"smooth_{c}"), s.drift.winsor * F.col(f"s_{c}")).alias("residual"))))
    rows = fused.select("station_id", F.to_date("ts").alias("day"), F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return rows.groupBy("station_id", F.col("x.channel").alias("channel"), "day").agg(F.sum("x.residual").alias("sum"), F.count("*").alias("n"))


def usable_days(daily: DataFrame, cadence: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, channel, day, mean) of days with enough samples for the station's cadence."""
    rows = usable_days_of(daily.join(cadence.select("station_id", "cadence_minutes"), "station_id"), s)
    return rows.select("station_id", "channel", "day", (F.col("sum") / F.col("n")).alias("mean"))


def usable_days_of(daily: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The rows with enough samples (n) for their cadence_minutes."""
    return daily.filter(F.col("n") >= F.greatest(F.lit(1.0), s.drift.day_fraction * 1440.0 / F.col("cadence_minutes")))


def drift(days: DataFrame, at: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row for each (station_id, channel, day) of at with enough days up to then: Theil-Sen slope, its z against the
    least-squares error inflated for autocorrelated days, the offset now and the projected service date. At most window_days
    points an evaluation, so the pairs that make its slopes are bounded."""
    p = s.drift
    keys = ["station_id", "channel", "at"]

    def ordinal(d: str) -> Column:
        return (F.datediff(d, F.lit("0001-01-01").cast("date")) + 1).cast("double")

    # Each day goes to the evaluation days that see it, and meets them by equality.
    seen = days.select("station_id", "channel", "day", F.col("mean").alias("y"), F.explode(F.sequence("day", F.date_add("day", p.window_days - 1))).alias("at"))
    points = seen.join(at.select("station_id", "channel", F.col("day").alias("at")), keys).select(*keys, ordinal("day").alias("x"), "y")
    base = points.groupBy(keys).agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_slope("y", "x").alias("ols"), F.regr_sxx("y", "x").alias("sxx"),
        F.expr("percentile(y, 0.5D)").alias("mid_y"), F.expr("percentile(x, 0.5D)").alias("mid_x")).filter(F.col("n") >= p.min_days)
    rest = points.join(base.select(*keys, "mx", "my", "ols"), keys).withColumn("r", F.col("y") - F.col("my") - F.col("ols") * (F.col("x") - F.col("mx")))
    rest = rest.withColumn("r1", F.lag("r").over(Window.partitionBy(*keys).orderBy("x")))
    errors = rest.groupBy(keys).agg(F.sum(F.col("r") * F.col("r")).alias("sse"), F.corr("r", "r1").alias("corr"))
    later = points.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"))
    slopes = points.join(base.select(keys), keys, "left_semi").join(later, keys).filter("x2 > x").groupBy(keys).agg(F.expr("percentile((y2 - y) / (x2 - x), 0.5D)").alias("slope"))
    rho = F.least(F.lit(p.ar1_max), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("corr", F.lit(0.0)), F.lit(0.0))))
    found = base.join(errors, keys).join(slopes, keys).withColumn("rho", rho)
    found = found.withColumn("se", F.sqrt(F.col("sse") / (F.col("n") - 2) / F.col("sxx")) * F.sqrt((1 + F.col("rho")) / (1 - F.col("rho"))))
    found = found.withColumns({
        "z": F.when(F.col("se") > 0, F.col("slope") / F.col("se")).otherwise(0.0),
        "offset_now": F.col("mid_y") - F.col("slope") * (F.col("mid_x") - F.col("x0")) + F.col("slope") * (ordinal("at") - F.col("x0"))})
    limit = F.lit(None).cast("double")
    for c in CHANNELS:
        limit = F.when(F.col("channel") == c, p.limit[c]).otherwise(limit)
    ahead = (F.signum("slope") * limit - F.col("offset_now")) / F.nullif("slope", F.lit(0.0))
    found = found.withColumns({"significant": F.abs("z") >= p.z, "ahead": ahead})
    date = F.when(F.col("significant") & (F.col("ahead") <= 0), F.col("at")).when(F.col("significant") & (F.col("ahead") <= p.max_days), F.date_add("at", F.floor("ahead").cast("int")))
    return found.select(*keys, "n", F.col("slope").alias("drift_per_day"), F.col("z").alias("drift_z"), (p.z * F.col("se")).alias("drift_floor_per_day"), "significant", "offset_now", date.alias("service_date"))


def isolated(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Significance only where no other channel of the station trends clearly at that day."""
    day = Window.partitionBy("station_id", "at")
    strong = (F.abs(F.coalesce("drift_z", F.lit(0.0))) >= s.drift.partner_z).cast("int")
    others = F.sum(strong).over(day) - strong
    alone = F.coalesce("significant", F.lit(False)) & (others == 0)
    return found.withColumns({"drift_significant": alone, "service_date": F.when(alone, F.col("service_date"))}).drop("significant")


def persistent(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Significance only where it held, with one sign, at each of the last persist_days days. found has one row a day."""
    n = s.drift.persist_days
    back = Window.partitionBy("station_id", "channel").orderBy(F.datediff("at", F.lit("1970-01-01").cast("date"))).rangeBetween(1 - n, 0)
    up = F.sum((F.col("drift_significant") & (F.col("drift_per_day") > 0)).cast("int")).over(back)
    down = F.sum((F.col("drift_significant") & (F.col("drift_per_day") < 0)).cast("int")).over(back)
    held = (up == n) | (down == n)
    return found.withColumn("held", held).withColumns({"drift_significant": F.col("held"), "service_date": F.when(F.col("held"), F.col("service_date"))}).drop("held")


def scores(fused: DataFrame, drifts: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Score and shares of each channel over the days before each station's newest record; null below min_records.
    drifts: (station_id, channel, drift_significant, offset_now, service_date), at the newest day."""
    h = s.health
    newest = Window.partitionBy("station_id")
    recent = fused.withColumn("now_us", F.max("us").over(newest)).filter(F.col("us") >= F.col("now_us") - int(h.window * MINUTE))
    def share(verdict: str, c: str) -> Column:
        return F.avg(((F.col("verdict") == verdict) & F.array_contains("flagged_channels", c)).cast("double"))

    near = F.col("us") >= F.col("now_us") - int(s.ticket.recent * MINUTE)
    wide = recent.groupBy("station_id").agg(
        F.max("ts").alias("now"), F.count("*").alias("records"),
        *[share("FAULT", c).alias(f"fault_{c}") for c in CHANNELS], *[share("SUSPECT", c).alias(f"suspect_{c}") for c in CHANNELS],
        *[F.avg(F.when(near, ((F.col("verdict") == "FAULT") & F.array_contains("flagged_channels", c)).cast("double"))).alias(f"recent_{c}") for c in CHANNELS])
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"fault_{c}").alias("fault_fraction"), F.col(f"suspect_{c}").alias("suspect_fraction"), F.col(f"recent_{c}").alias("recent_fraction")) for c in CHANNELS])
    rows = wide.filter(F.col("records") >= h.min_records).select("station_id", "now", "records", F.explode(parts).alias("x")).select("station_id", "now", "records", "x.*")
    if drifts is None:
        rows = rows.withColumns({"drift_significant": F.lit(False), "offset_now": F.lit(None).cast("double"), "service_date": F.lit(None).cast("date")})
    else:
        rows = rows.join(drifts.select("station_id", "channel", "drift_significant", "offset_now", "service_date"), ["station_id", "channel"], "left")
    limit = F.lit(1.0)
    for c in CHANNELS:
        limit = F.when(F.col("channel") == c, s.drift.limit[c]).otherwise(limit)
    ratio = F.when(F.coalesce("drift_significant", F.lit(False)), F.least(F.lit(1.0), F.abs("offset_now") / limit)).otherwise(0.0)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - h.fault * F.col("fault_fraction") - h.suspect * F.col("suspect_fraction") - h.drift * ratio))
    return rows.withColumn("score", F.bround(score, 2))


def reports(scored: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row a station: its worst channel's score, earliest service date, and a ticket (priority and channels) if needed."""
    t = s.ticket
    low = F.col("score") <= t.score
    faulty = F.coalesce(F.col("recent_fraction") >= t.fraction, F.lit(False))
    due = F.coalesce(F.datediff("service_date", F.to_date("now")) <= t.service_days, F.lit(False))
    order = F.when(F.col("channel") == CHANNELS[0], 0).when(F.col("channel") == CHANNELS[1], 1).otherwise(2)
    marked = scored.withColumns({"involved": low | faulty | due, "urgent": faulty | F.coalesce(F.col("service_date") <= F.to_date("now"), F.lit(False)) & due, "place": order})
    out = marked.groupBy("station_id").agg(
        F.max("now").alias("now"), F.max("records").alias("records"), F.min("score").alias("score"), F.min("service_date").alias("service_date"), F.max("urgent").alias("urgent"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("involved"), F.struct("place", "channel")))), lambda x: x["channel"]), ",").alias("channels"))
    ticket = F.when(F.col("channels") == "", None).when(F.col("urgent") | (F.col("score") <= t.high), "high").otherwise("normal")
    return out.withColumn("ticket", ticket).select("station_id", "now", "records", "score", "service_date", "ticket", "channels")
