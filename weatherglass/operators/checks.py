"""Checks of one reading: each is a Column over the features, (check, kind, channel, flagged, severity, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import dew_point, wet_bulb
from ..schema import CHECK
from ..settings import CHANNELS, DEFAULT, Settings


@dataclass(frozen=True)
class Check:
    kind: str
    channel: str | None
    flagged: Column
    soft: Column | bool = False
    value: Column | None = None

    @property
    def column(self) -> Column:
        name = f"{self.kind}:{self.channel}" if self.channel else self.kind
        soft = F.lit(self.soft) if isinstance(self.soft, bool) else F.coalesce(self.soft, F.lit(False))
        return F.struct(
            F.lit(name).alias("check"), F.lit(self.kind).alias("kind"), F.lit(self.channel).cast("string").alias("channel"),
            F.coalesce(self.flagged, F.lit(False)).alias("flagged"), F.when(soft, "soft").otherwise("hard").alias("severity"),
            (self.value if self.value is not None else F.lit(None)).cast("double").alias("value"))


def gap_limit(s: Settings) -> Column:
    return s.gap_multiplier * F.col("cadence_minutes")


def allowed_step(c: str, dt: Column, s: Settings, learned: bool = False) -> Column:
    cap = F.lit(s.step.cap[c])
    if learned:
        cap = F.greatest(cap, F.coalesce(F.col(f"step_cap_{c}"), F.lit(0.0)))
    return F.least(s.step.rate[c] * dt, cap)


def physics(s: Settings = DEFAULT) -> list[Check]:
    t, rh = F.col("temperature_c"), F.col("humidity_pct")
    out = [Check("range", c, ~F.col(c).between(s.physics.low[c], s.physics.high[c])) for c in CHANNELS]
    td, tw = dew_point(t, rh), wet_bulb(t, rh)
    return [*out, Check("dew_point", None, td > t + s.physics.dew_tolerance, value=td), Check("wet_bulb", None, tw >= s.physics.wet_bulb, True, tw)]


def timestamp(s: Settings = DEFAULT, now: Column | None = None) -> Check:
    wrong = F.coalesce(F.col("us") <= F.col("us1"), F.lit(False))
    if now is not None:
        wrong = wrong | (F.col("ts") > now + F.expr(f"INTERVAL {int(s.future_minutes * 60)} SECOND"))
    return Check("timestamp", None, wrong)


def dropout(s: Settings = DEFAULT) -> Check:
    missing = sum((F.col(c).isNull().cast("int") for c in CHANNELS[1:]), F.col(CHANNELS[0]).isNull().cast("int"))
    return Check("dropout", None, missing > 0, value=missing)


def gap(s: Settings = DEFAULT) -> Check:
    return Check("gap", None, F.col("dt1") > gap_limit(s), value=F.col("dt1"))


def limits_fit(s: Settings = DEFAULT) -> Check:
    unlearned = F.lit(False)
    for c in CHANNELS:
        unlearned = unlearned | F.col(f"noise_std_{c}").isNull()
    moved = F.abs(F.col("cadence_minutes") / F.nullif("limit_cadence", F.lit(0.0)) - 1) > 0.25
    return Check("limits", None, F.col("has_limits") & (unlearned | F.coalesce(moved, F.lit(False))))


def frozen(c: str, s: Settings = DEFAULT) -> Check:
    """No change at all over the window. With a learned window, a run just past it is soft, one of a multiple hard, unless
    saturated air (or, if set, a freezing plateau) explains it."""
    window, run = F.col(f"frozen_window_{c}"), F.col(f"run_{c}")
    learned = F.coalesce(f"frozen_minutes_{c}", F.lit(0.0)) if s.layers.limits else F.lit(0.0)
    hard = (learned == 0) | (run >= s.frozen.hard_multiplier * window)
    if c != "pressure_hpa":
        if s.frozen.ceiling_aware:
            hard = hard & ~F.col(f"wet_{c}")
        if s.frozen.freezing_aware:
            hard = hard & ~F.col(f"cold_{c}")
    return Check("frozen", c, F.col(f"whole_{c}") & (F.col(f"spread_{c}") <= s.frozen.epsilon), ~hard, F.col(f"spread_{c}"))


def step(c: str, s: Settings = DEFAULT, plain: bool = False) -> Check:
    """A change above the allowance. With expected values, only what the usual daily cycle does not explain is judged, if that
    is less. plain: neither learned caps nor expected values."""
    dt, delta = F.col("dt1"), F.col(c) - F.col(f"{c}_1")
    if not plain and s.step.expected_aware:
        left = delta - (F.col(f"e_{c}") - F.col(f"e1_{c}"))
        delta = F.when(F.abs(left) < F.abs(delta), left).otherwise(delta)
    most = allowed_step(c, dt, s, not plain and s.layers.limits and s.limits.learned_step_cap)
    return Check("step", c, (dt > 0) & (dt <= gap_limit(s)) & (F.abs(delta) > most), value=delta)


def spike(c: str, s: Settings = DEFAULT) -> Check:
    dt1, dt2 = F.col("dt2"), F.col("dt1")  # out, then back
    out, back = F.col(f"{c}_1") - F.col(f"{c}_2"), F.col(c) - F.col(f"{c}_1")
    timed = (dt1 > 0) & (dt2 > 0) & (dt1 <= gap_limit(s)) & (dt2 <= gap_limit(s))
    jumped = (F.abs(out) > allowed_step(c, dt1, s)) & (F.abs(back) > allowed_step(c, dt2, s)) & (out * back < 0)
    return Check("spike", c, timed & jumped & (F.abs(F.col(c) - F.col(f"{c}_2")) <= allowed_step(c, dt1 + dt2, s)))


def noise(c: str, s: Settings = DEFAULT) -> Check:
    """Jitter by second differences, in which a smooth trend cancels."""
    limit = F.lit(s.noise.limit[c])
    if s.layers.limits:
        limit = F.greatest(limit, F.coalesce(F.col(f"noise_std_{c}"), F.lit(0.0)))
    return Check("noise", c, F.col(f"jitter_{c}") > limit, value=F.col(f"jitter_{c}"))


def drift(c: str, s: Settings = DEFAULT) -> Check:
    return Check("drift", c, F.col(f"peak_{c}") >= s.cusum.h, True, F.col(f"peak_{c}"))


def offset(c: str, s: Settings = DEFAULT) -> Check:
    """The median departure is large while those of the other channels are small."""
    calm = F.lit(True)
    for other in CHANNELS:
        if other != c:
            calm = calm & (F.abs(F.col(f"departure_{other}")) < s.offset.others_below)
    return Check("offset", c, (F.abs(F.col(f"departure_{c}")) >= s.offset.z) & calm, True, F.col(f"departure_{c}"))


def clock(s: Settings = DEFAULT) -> Check:
    """Needs clock_flag (see clock.results)."""
    return Check("clock", None, F.col("clock_flag"), True)


def cojump(s: Settings = DEFAULT) -> Check:
    jumps = [F.coalesce(step(c, s, plain=True).flagged, F.lit(False)).cast("int") for c in CHANNELS]
    return Check("cojump", None, jumps[0] + jumps[1] + jumps[2] >= s.timing.cojump, value=jumps[0] + jumps[1] + jumps[2])


def normal(c: str, s: Settings = DEFAULT) -> Check:
    return Check("normality", c, F.abs(F.col(f"z_{c}")) > s.normality.z, True, F.col(f"z_{c}"))


def health(s: Settings = DEFAULT, now: Column | None = None) -> list[Check]:
    out = [timestamp(s, now), dropout(s), gap(s), limits_fit(s)]
    for c in CHANNELS:
        out += [frozen(c, s), step(c, s), spike(c, s), noise(c, s), drift(c, s)]
    return out + [offset(c, s) for c in CHANNELS if s.offset.enabled]


def all_checks(s: Settings = DEFAULT, *, now: Column | None = None, with_clock: bool = False, models: list[Check] = ()) -> list[Check]:
    """Every check of the layers that are on, in their order. models: the checks of the isolation forest and the distance."""
    out: list[Check] = []
    if s.layers.physics:
        out += physics(s)
    if s.layers.health:
        out += health(s, now)
    if s.layers.timing:
        out += ([clock(s)] if with_clock else []) + [cojump(s)]
    if s.layers.normality:
        out += [normal(c, s) for c in CHANNELS]
    return out + list(models)


def apply(features: DataFrame, checks: list[Check]) -> DataFrame:
    """features with the array of check results."""
    return features.withColumn("checks", F.array(*[c.column for c in checks]) if checks else F.array().cast(f"array<{CHECK}>"))
