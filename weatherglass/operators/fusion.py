"""Fusion of the checks into one verdict, with confidence and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import CHANNELS, DEFAULT, Settings
from .checks import allowed_step
from .reasons import clauses


def moves(c: str, s: Settings = DEFAULT) -> Column:
    """+1, -1 or 0: the change against the latest row of the kept history that is old enough (0 if its value is missing)."""
    change = F.col(c) - F.col(f"before_{c}")
    return F.when(F.abs(change) < s.fusion.min_move[c], 0).when(change > 0, 1).when(change < 0, -1).otherwise(0)


def quiet(c: str, s: Settings = DEFAULT) -> Column:
    """Whether neither of the last two intervals shows a noticeable change; intervals with missing values are passed over."""
    out = F.lit(True)
    for now, before, dt in ((c, f"{c}_1", "dt1"), (f"{c}_1", f"{c}_2", "dt2")):
        most = s.fusion.quiet_fraction * allowed_step(c, F.col(dt), s)
        if s.layers.limits:
            usual = F.col(f"typical_step_{c}")
            near = F.col(dt) <= 1.5 * F.col("cadence_minutes")
            most = F.when(usual.isNotNull() & near, F.least(most, s.fusion.quiet_multiple * usual)).otherwise(most)
        moved = (F.col(dt) > 0) & (F.abs(F.col(now) - F.col(before)) > most)
        out = out & ~F.coalesce(moved, F.lit(False))
    return out


def signature(s: Settings = DEFAULT) -> Column:
    """The first weather signature whose moves all fit."""
    out = F.lit(None).cast("string")
    for needed, what in reversed(s.fusion.signatures):
        fits = F.lit(True)
        for c, sign in needed.items():
            fits = fits & (F.col(f"move_{c}") == sign)
        out = F.when(fits, what).otherwise(out)
    return out


def coherent(s: Settings = DEFAULT) -> Column:
    """How many channels depart far from normal, if enough do at once; else 0."""
    far = [F.coalesce(F.abs(F.col(f"z_{c}")) >= s.fusion.coherent_z, F.lit(False)).cast("int") for c in CHANNELS]
    n = far[0] + far[1] + far[2]
    return F.when(n >= s.fusion.coherent_channels, n).otherwise(0)


def fuse(checked: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """verdict, confidence, reason, rule and notices of rows with features and checks; the first rule that fits decides."""
    f = s.fusion
    rows = checked.withColumns(
        {f"move_{c}": moves(c, s) for c in CHANNELS} | {f"quiet_{c}": quiet(c, s) for c in CHANNELS}
        | {"flags": F.filter("checks", lambda x: x["flagged"] & ~x["kind"].isin(*f.informational)), "notices": F.transform(F.filter("checks", lambda x: x["flagged"] & x["kind"].isin(*f.informational)), lambda x: x["check"])})
    hard = F.filter("flags", lambda x: x["severity"] == "hard")
    rows = rows.withColumns({
        "hard": hard,
        "faults": F.filter(hard, lambda x: x["kind"].isin(*f.fault)),
        "jumps": F.filter(hard, lambda x: x["kind"].isin(*f.jump)),
        "soft_flags": F.size(F.filter("flags", lambda x: x["severity"] == "soft")),
        "signature": signature(s), "coherent": coherent(s)})
    jumpers = F.array_distinct(F.transform("jumps", lambda x: x["channel"]))
    one = F.try_element_at(jumpers, F.lit(1))
    still = F.lit(True)
    for c in CHANNELS:
        still = still & (F.col(f"quiet_{c}") | (one == c))
    alone = (F.size(jumpers) == 1) & still & ~F.exists("flags", lambda x: x["channel"].isNotNull() & (x["channel"] != one))
    any_flag = F.size("flags") > 0
    rule = (F.when(F.size("faults") > 0, 1).when(alone, 2)
            .when(any_flag & (F.size("hard") == 0) & (F.col("signature").isNotNull() | (F.col("coherent") > 0)), 3)
            .when(any_flag, 4).otherwise(5))
    rows = rows.withColumn("rule", rule)
    c = f.confidence
    base = F.when(F.col("rule") == 1, c["fault1"]).when(F.col("rule") == 2, c["fault2"]).when(F.col("rule") == 3, c["weather"]).when(F.col("rule") == 4, c["suspect"]).otherwise(c["valid"])
    # A suspect verdict rests on its first flag, which then supports nothing.
    support = F.col("soft_flags") - ((F.col("rule") == 4) & (F.try_element_at("flags", F.lit(1))["severity"] == "soft")).cast("int")
    why = clauses(F.when(F.col("rule") == 1, F.col("faults")).when(F.col("rule") == 2, F.col("jumps")).otherwise(F.col("flags")))
    told = (F.when(F.col("rule") == 1, F.concat(F.lit("The sensor is at fault: "), why))
            .when(F.col("rule") == 2, F.concat(F.lit("The sensor of one channel is at fault, the others are calm: "), why))
            .when(F.col("rule") == 3, F.concat(F.lit("Weather, "), F.coalesce("signature", F.concat(F.col("coherent").cast("string"), F.lit(" channels far from normal"))), F.lit(": "), why))
            .when(F.col("rule") == 4, F.concat(F.lit("Worth a look: "), why)).otherwise("Nothing stands out."))
    return rows.withColumns({
        "verdict": F.when(F.col("rule") <= 2, "FAULT").when(F.col("rule") == 3, "WEATHER").when(F.col("rule") == 4, "SUSPECT").otherwise("VALID"),
        "confidence": F.bround(F.least(F.lit(f.most), base + f.bonus * support), 3),
        "reason": told}).drop("hard", "faults", "jumps", "soft_flags")


def flagged_channels(s: Settings = DEFAULT) -> Column:
    """The channels that the flagged checks point at, in the channels' order."""
    def kinds(*wanted: str) -> Column:
        return F.exists("checks", lambda x: x["flagged"] & x["kind"].isin(*wanted)) if wanted else F.lit(False)

    def named(c: str) -> Column:
        return F.coalesce(F.exists("checks", lambda x: x["flagged"] & (x["channel"] == c)), F.lit(False))

    out = []
    for c in CHANNELS:
        others = [k for k, channels in s.health.check_channels.items() if c in channels]
        out.append(F.when(named(c) | (kinds("dropout") & F.col(c).isNull()) | kinds(*others), F.lit(c)))
    return F.array_compact(F.array(*out))
