"""What checks need of a reading's history, measured for whole blocks of rows at once.

History is the last kept_rows arrivals of a station, the reading itself included, each check taking those of its time window
(late arrivals too). Built-in functions on arrays are interpreted row by row, and frames with constant bounds can't say "at
most so many rows, of these only the last so many minutes, in arrival order", so this one step runs in numpy over Arrow
batches: one pass a lag, each for all rows. Its memory is bounded by a block of features.dealt() and a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.core import MINUTE, importable
from ..settings import CHANNELS, Settings


def fields(s: Settings) -> dict[str, str]:
    """The columns that measured() adds, with their types."""
    out = {}
    for c in CHANNELS:
        out |= {f"frozen_window_{c}": "double", f"spread_{c}": "double", f"whole_{c}": "boolean", f"run_{c}": "double", f"wet_{c}": "boolean", f"cold_{c}": "boolean"}
        out |= {f"jitter_{c}": "double", f"peak_{c}": "double", f"before_{c}": "double", f"departure_{c}": "double"}
    return out


def whole_groups(batches, keys: tuple[str, ...] = ("station_id", "block")):
    """(table, first row of each row's group) of whole groups of neighbouring rows with equal keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        starts = group_starts(table, keys)
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[: starts[-1]]
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, group_starts(held, keys)


def group_starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.maximum.accumulate(np.where(fresh, np.arange(table.num_rows), 0))


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.float64)


def measures(table: pa.Table, starts: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """The columns of fields() for each row; not-a-number where there is no value."""
    n = table.num_rows
    us, here = table.column("us").to_numpy(), np.arange(n)
    v, e, sd = ({c: numbers(table, f"{x}{c}") for c in CHANNELS} for x in ("", "e_", "s_"))
    cadence, humidity = numbers(table, "cadence_minutes"), v["humidity_pct"]
    first = np.maximum(starts, here - table.column("kept_rows").to_numpy() + 1)
    lags = int((here - first).max()) + 1

    def since(minutes) -> np.ndarray:
        return us - minutes * MINUTE

    width = {c: np.maximum(s.frozen.window[c], (s.frozen.min_samples - 1) * cadence) for c in CHANNELS}
    if s.layers.limits:
        width = {c: np.fmax(width[c], numbers(table, f"frozen_minutes_{c}")) for c in CHANNELS}
    frozen_from = {c: since(width[c]) for c in CHANNELS}
    noise_from = since(np.maximum(s.noise.window, (s.noise.min_samples - 1) * cadence))
    move_to = since(np.maximum(s.fusion.direction_window, cadence))
    gap = s.gap_multiplier * cadence * MINUTE

    def filled(value, kind=np.float64) -> dict[str, np.ndarray]:
        return {c: np.full(n, value, kind) for c in CHANNELS}

    none = np.nan
    high, low, count, holes = filled(none), filled(none), filled(0), filled(False, bool)
    wet, cold, going, since_us = filled(True, bool), filled(True, bool), {c: ~np.isnan(v[c]) for c in CHANNELS}, {c: us.copy() for c in CHANNELS}
    near, nearer, total, complete, seen = filled(none), filled(none), filled(0.0), filled(True, bool), np.zeros(n)
    before, found = filled(none), np.zeros(n, bool)
    for lag in range(lags):  # newest first
        at = np.maximum(here - lag, first)
        on = here - lag >= first
        then = us[at]
        noisy, seen = on & (then >= noise_from), seen + (on & (then >= noise_from))
        moved = on & ~found & (then <= move_to) if lag else np.zeros(n, bool)
        found |= moved
        for c in CHANNELS:
            x = v[c][at]
            missing, inside = np.isnan(x), on & (then >= frozen_from[c])
            high[c], low[c] = np.where(inside, np.fmax(high[c], x), high[c]), np.where(inside, np.fmin(low[c], x), low[c])
            count[c] += inside
            holes[c] |= inside & missing
            wet[c] &= ~inside | (humidity[at] >= s.frozen.ceiling)
            cold[c] &= ~inside | ((np.abs(v["temperature_c"][at]) <= s.frozen.freezing_band) & (humidity[at] >= s.frozen.freezing_humidity))
            if lag:
                going[c] &= on & ~missing & (np.abs(x - v[c]) <= s.frozen.epsilon) & (since_us[c] - then <= gap)
                since_us[c] = np.where(going[c], then, since_us[c])
            complete[c] &= ~(noisy & missing)
            bend = (x - 2 * nearer[c] + near[c]) ** 2
            total[c] += np.where(noisy & (seen >= 3), bend, 0.0)
            near[c], nearer[c] = np.where(noisy, nearer[c], near[c]), np.where(noisy, x, nearer[c])
            before[c] = np.where(moved, x, before[c])
    out: dict[str, np.ndarray] = {}
    span = (us - us[first]) / MINUTE
    enough = seen >= s.noise.min_samples
    for c in CHANNELS:
        out |= {
            f"frozen_window_{c}": width[c], f"spread_{c}": high[c] - low[c], f"whole_{c}": (span >= width[c]) & (count[c] >= s.frozen.min_samples) & ~holes[c],
            f"run_{c}": np.where(np.isnan(v[c]), 0.0, (us - since_us[c]) / MINUTE), f"wet_{c}": wet[c], f"cold_{c}": cold[c],
            f"jitter_{c}": np.where(enough & complete[c], np.sqrt(total[c] / np.maximum(seen - 2, 1) / 6), none), f"before_{c}": before[c]}
    out |= cusum_peaks(us, here, first, lags, v, e, sd, cadence, s)
    return out | (median_departures(us, here, first, lags, v, e, sd, cadence, s) if s.offset.enabled else {f"departure_{c}": np.full(n, none) for c in CHANNELS})


def cusum_peaks(us, here, first, lags: int, v, e, sd, cadence, s: Settings) -> dict[str, np.ndarray]:
    """The largest two-sided cumulative sum of clipped departures over the window; none without usable samples."""
    q = s.cusum
    scale, begin = cadence / q.reference, us - q.window * MINUTE
    up, down, peak = ({c: np.full(len(us), x) for c in CHANNELS} for x in (0.0, 0.0, np.nan))
    for lag in range(lags - 1, -1, -1):  # oldest first
        at = np.maximum(here - lag, first)
        inside = (here - lag >= first) & (us[at] >= begin)
        for c in CHANNELS:
            spread = np.where((sd[c][at] == 0) | np.isnan(sd[c][at]), q.sigma[c], sd[c][at])
            z = np.clip((v[c][at] - e[c][at]) / spread, -q.cap, q.cap)
            on = inside & ~np.isnan(z)
            up[c] = np.where(on, np.maximum(0.0, up[c] + (z - q.k) * scale), up[c])
            down[c] = np.where(on, np.maximum(0.0, down[c] + (-z - q.k) * scale), down[c])
            peak[c] = np.where(on, np.fmax(peak[c], np.maximum(up[c], down[c])), peak[c])
    return {f"peak_{c}": peak[c] for c in CHANNELS}


def median_departures(us, here, first, lags: int, v, e, sd, cadence, s: Settings) -> dict[str, np.ndarray]:
    """The median z over the offset window; none with a missing value or a gap in it, or too few samples."""
    o = s.offset
    begin, gap = us - np.maximum(o.window, (o.min_samples - 1) * cadence) * MINUTE, s.gap_multiplier * cadence * MINUTE
    z = {c: np.full((len(us), lags), np.inf) for c in CHANNELS}
    whole, n, newer = {c: np.ones(len(us), bool) for c in CHANNELS}, np.zeros(len(us), np.int64), us.copy()
    for lag in range(lags):
        at = np.maximum(here - lag, first)
        inside = (here - lag >= first) & (us[at] >= begin)
        broken = inside & (newer - us[at] > gap)
        newer, n = np.where(inside, us[at], newer), n + inside
        for c in CHANNELS:
            x = (v[c][at] - e[c][at]) / np.where(sd[c][at] == 0, np.nan, sd[c][at])
            whole[c] &= ~(inside & np.isnan(x)) & ~broken
            z[c][:, lag] = np.where(inside & ~np.isnan(x), x, np.inf)
    out = {}
    for c in CHANNELS:
        ordered = np.sort(z[c], axis=1)
        middle = (ordered[here, np.maximum(n - 1, 0) // 2] + ordered[here, np.minimum(n // 2, lags - 1)]) / 2
        out[f"departure_{c}"] = np.where(whole[c] & (n >= o.min_samples), middle, np.nan)
    return out


def measured(rows: DataFrame, s: Settings) -> DataFrame:
    """rows (sorted by station_id, block and place) with the columns of fields(), without the rows of halos."""
    added = fields(s)
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("block", "halo")])
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches):
        for table, starts in whole_groups(batches):
            own = pa.array(~table.column("halo").to_numpy())
            new = measures(table, starts, s)
            kept = table.drop_columns(["block", "halo"])
            for name, kind in added.items():
                kept = kept.append_column(name, pa.array(new[name], from_pandas=kind == "double"))
            yield from kept.filter(own).combine_chunks().to_batches()

    return importable(rows).mapInArrow(run, schema)


def range_sums(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The sum of x over [low, high) of each range, from sums of 1, 2, 4, ... neighbours: logarithmic in the longest range, and
    nothing is taken away again, so that no sum is less exact than that of its own numbers."""
    out, at, length, part = np.zeros(len(low)), low.copy(), high - low, x.astype(np.float64)
    for level in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> level & 1)
        out[on] += part[at[on]]
        at[on] += 1 << level
        part = part + np.concatenate((part[1 << level :], np.zeros(min(1 << level, len(part)))))
    return out


def window_jitter(us: np.ndarray, x: np.ndarray, begin: np.ndarray, least: int) -> np.ndarray:
    """The jitter of x over [begin, us] of each row of one group sorted by us; none with fewer samples or a missing value."""
    n, missing = len(us), np.isnan(x)
    low, here = np.searchsorted(us, begin, "left"), np.arange(n)
    holes = np.concatenate(([0], np.cumsum(missing)))
    good = np.flatnonzero((here - low + 1 >= least) & (holes[here + 1] == holes[low]))
    out = np.full(n, np.nan)
    if len(good):
        bends = np.zeros(n + 1)
        # Those over a missing value are in no range that is asked for.
        bends[2:n] = np.nan_to_num((x[2:] - 2 * x[1:-1] + x[:-2]) ** 2)
        total = range_sums(bends, low[good] + 2, good + 1)
        out[good] = np.sqrt(total / (good - low[good] - 1) / 6)
    return out


def jitters(rows: DataFrame, s: Settings) -> DataFrame:
    """(station_id, seq and the jitter of each channel) of rows sorted by station_id, block and time, with noise_window in
    minutes; halos are left out."""
    schema = ", ".join(["station_id string", "seq long", *(f"{c} double" for c in CHANNELS)])

    def run(batches):
        for table, starts in whole_groups(batches):
            us, width = table.column("us").to_numpy(), numbers(table, "noise_window")
            found = {c: np.full(table.num_rows, np.nan) for c in CHANNELS}
            edges = [*np.unique(starts).tolist(), table.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                for c in CHANNELS:
                    found[c][a:b] = window_jitter(us[a:b], numbers(table, c)[a:b], us[a:b] - width[a:b] * MINUTE, s.noise.min_samples)
            own = ~table.column("halo").to_numpy()
            columns = [table.column(k).filter(pa.array(own)).combine_chunks() for k in ("station_id", "seq")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c][own], from_pandas=True) for c in CHANNELS)], names=["station_id", "seq", *CHANNELS])

    return importable(rows).select("station_id", "seq", "us", "block", "place", "halo", "noise_window", *CHANNELS).mapInArrow(run, schema)
