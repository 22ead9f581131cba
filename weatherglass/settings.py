"""Thresholds of the engine. All are literals in the plan, so that switched-off layers vanish by constant folding."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

#: The channels, in the order that fixes the order of the checks.
CHANNELS = ("temperature_c", "pressure_hpa", "humidity_pct")


def per(t: float, p: float, h: float) -> dict[str, float]:
    return dict(zip(CHANNELS, (t, p, h), strict=True))


@dataclass(frozen=True)
class Layers:
    physics: bool = True
    health: bool = True
    normality: bool = True
    mlmodel: bool = True
    mahalanobis: bool = True
    timing: bool = True
    limits: bool = True
    impute: bool = True


@dataclass(frozen=True)
class Physics:
    low: dict = field(default_factory=lambda: per(-90.0, 300.0, 0.0))
    high: dict = field(default_factory=lambda: per(60.0, 1100.0, 100.0))
    dew_tolerance: float = 0.5
    wet_bulb: float = 35.0


@dataclass(frozen=True)
class Frozen:
    window: dict = field(default_factory=lambda: per(60.0, 180.0, 120.0))
    epsilon: float = 0.0
    min_samples: int = 3
    hard_multiplier: float = 2.0
    ceiling_aware: bool = True
    ceiling: float = 99.5
    freezing_aware: bool = False
    freezing_band: float = 1.0
    freezing_humidity: float = 85.0


@dataclass(frozen=True)
class Step:
    rate: dict = field(default_factory=lambda: per(1.0, 0.5, 5.0))
    cap: dict = field(default_factory=lambda: per(10.0, 10.0, 40.0))
    expected_aware: bool = True


@dataclass(frozen=True)
class Noise:
    window: float = 30.0
    min_samples: int = 7
    limit: dict = field(default_factory=lambda: per(0.5, 0.5, 3.0))


@dataclass(frozen=True)
class Offset:
    enabled: bool = False
    window: float = 720.0
    min_samples: int = 4
    z: float = 2.5
    others_below: float = 1.0


@dataclass(frozen=True)
class Cusum:
    window: float = 360.0
    reference: float = 15.0
    cap: float = 4.0
    k: float = 1.5
    h: float = 40.0
    sigma: dict = field(default_factory=lambda: per(1.0, 0.5, 5.0))


@dataclass(frozen=True)
class Limits:
    frozen_quantile: float = 0.999
    frozen_margin: float = 1.0
    min_runs: int = 30
    noise_quantile: float = 0.999
    noise_margin: float = 1.1
    min_noise: int = 200
    step_quantile: float = 0.999
    step_margin: float = 1.1
    min_steps: int = 500
    usual_percentile: float = 0.75
    min_usual: int = 200
    learned_step_cap: bool = False


@dataclass(frozen=True)
class Normality:
    min_samples: int = 10
    z: float = 4.0
    min_std: dict = field(default_factory=lambda: per(0.1, 0.1, 1.0))


@dataclass(frozen=True)
class Coldstart:
    samples: float = 30.0
    days: float = 365.0


@dataclass(frozen=True)
class Models:
    trees: int = 100
    subsample: int = 256
    seed: int = 42
    forest_quantile: float = 0.005
    distance_quantile: float = 0.995
    ridge: float = 1e-6
    min_rows: int = 50


@dataclass(frozen=True)
class Timing:
    window: float = 1440.0
    every_hours: float = 3.0
    channels: tuple = ("temperature_c", "humidity_pct")
    max_shift: int = 6
    min_bins: int = 18
    min_shift: int = 1
    improvement: float = 0.5
    cojump: int = 2


@dataclass(frozen=True)
class Fusion:
    informational: tuple = ("gap", "limits")
    fault: tuple = ("range", "dew_point", "frozen", "dropout")
    jump: tuple = ("step", "spike")
    quiet_fraction: float = 0.5
    quiet_multiple: float = 1.5
    coherent_z: float = 2.0
    coherent_channels: int = 2
    direction_window: float = 60.0
    min_move: dict = field(default_factory=lambda: per(1.0, 1.0, 5.0))
    #: (moves by channel, what it looks like), first match first.
    signatures: tuple = (
        ({"temperature_c": -1, "humidity_pct": 1}, "cooling and moistening"),
        ({"temperature_c": 1, "humidity_pct": -1}, "warming and drying"),
        ({"pressure_hpa": -1, "humidity_pct": 1}, "falling pressure and moistening"),
        ({"pressure_hpa": 1, "humidity_pct": 1}, "rising pressure and moistening"),
    )
    confidence: dict = field(default_factory=lambda: {"valid": 0.9, "fault1": 0.95, "fault2": 0.8, "weather": 0.7, "suspect": 0.5})
    bonus: float = 0.05
    most: float = 0.99


@dataclass(frozen=True)
class Health:
    window: float = 10080.0
    min_records: int = 30
    every: float = 60.0
    fault: float = 100.0
    suspect: float = 50.0
    drift: float = 40.0
    check_channels: dict = field(default_factory=lambda: {"dew_point": ("temperature_c", "humidity_pct")})


@dataclass(frozen=True)
class Drift:
    window_days: int = 60
    min_days: int = 21
    day_fraction: float = 0.5
    winsor: float = 3.0
    z: float = 4.0
    ar1_max: float = 0.9
    persist_days: int = 7
    partner_z: float = 2.5
    limit: dict = field(default_factory=lambda: per(0.5, 1.0, 3.0))
    max_days: int = 3650


@dataclass(frozen=True)
class Ticket:
    score: float = 60.0
    high: float = 30.0
    service_days: int = 30
    recent: float = 60.0
    fraction: float = 0.5


@dataclass(frozen=True)
class Impute:
    lookback: float = 180.0
    halflife: float = 120.0
    band: float = 1.96
    sigma: dict = field(default_factory=lambda: per(1.0, 1.0, 5.0))
    fill: int = 10


@dataclass(frozen=True)
class Injector:
    seed: int = 42
    events: int = 3
    separation: float = 120.0
    duration: dict = field(default_factory=lambda: {"frozen": 240.0, "spike": 0.0, "step": 60.0, "drift": 360.0, "noise": 60.0, "dropout": 30.0, "clock_shift": 5760.0})
    shift_hours: float = 3.0
    magnitude: dict = field(default_factory=lambda: {"spike": per(15.0, 15.0, 50.0), "step": per(12.0, 12.0, 45.0), "drift": per(5.0, 5.0, 20.0), "noise": per(2.0, 2.0, 10.0)})
    grace: float = 60.0


@dataclass(frozen=True)
class Edge:
    min_valid: int = 30
    frozen_minutes: int = 30


@dataclass(frozen=True)
class Peers:
    radius_km: float = 400.0
    min_peers: int = 3
    window: int = 168
    fraction: float = 0.6
    quantile: float = 0.999
    margin: float = 1.2
    min_windows: int = 500


@dataclass(frozen=True)
class Settings:
    layers: Layers = Layers()
    gap_multiplier: float = 3.0
    future_minutes: float = 5.0
    default_cadence: float = 1.0
    physics: Physics = Physics()
    frozen: Frozen = Frozen()
    step: Step = Step()
    noise: Noise = Noise()
    offset: Offset = Offset()
    cusum: Cusum = Cusum()
    limits: Limits = Limits()
    normality: Normality = Normality()
    coldstart: Coldstart = Coldstart()
    models: Models = Models()
    timing: Timing = Timing()
    fusion: Fusion = Fusion()
    health: Health = Health()
    drift: Drift = Drift()
    ticket: Ticket = Ticket()
    impute: Impute = Impute()
    injector: Injector = Injector()
    edge: Edge = Edge()
    peers: Peers = Peers()

    @property
    def spare_rows(self) -> int:
        """Rows of history besides those of the longest window."""
        return max(self.frozen.min_samples, self.noise.min_samples) + 2

    def widest_window(self, clock: bool = False) -> float:
        """Minutes of the longest configured window; clock: with that of the clock check."""
        return max([self.frozen.window[c] for c in CHANNELS] + [self.noise.window, self.cusum.window, self.fusion.direction_window]
                   + [self.offset.window] * self.offset.enabled + [self.timing.window] * (clock and self.layers.timing))

    def history_rows(self, cadence: float, frozen: float = 0.0, clock: bool = False) -> int:
        """Rows of history that a station of this cadence keeps, if its longest learned frozen window is so many minutes."""
        return -int(-max(self.widest_window(clock), frozen * self.frozen.hard_multiplier) // cadence) + self.spare_rows


def merged(settings, changes: dict):
    """settings with nested changes (from YAML, for instance): a deep merge."""
    known = {f.name for f in fields(settings)}
    if unknown := set(changes) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    new = {}
    for name, value in changes.items():
        old = getattr(settings, name)
        new[name] = merged(old, value) if is_dataclass(old) else {**old, **value} if isinstance(old, dict) else value
    return replace(settings, **new)


def load(path: str, base: Settings | None = None) -> Settings:
    import yaml

    with open(path) as f:
        return merged(base or Settings(), yaml.safe_load(f) or {})


DEFAULT = Settings()
