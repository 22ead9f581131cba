"""Isolation forest in numpy: fitted per station, all trees walked at once for a batch of rows.

All draws (which rows a tree grows from, on which feature and where a node is cut) come from one integer mixing function, so that
an engine with integer arithmetic alone grows the same trees. Nodes are numbered as in a heap: 1 is the root, 2n and 2n + 1 are
the children of n. Path lengths are kept in millionths, as integers: their sum over the trees is exact in any order.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import importable, stored
from ..settings import CHANNELS, DEFAULT, Settings
from .checks import Check

FEATURES = (*CHANNELS, *(f"r_{c}" for c in CHANNELS), "hour_sin", "hour_cos")
#: Rows of a station, by draw, among which its trees choose: so many times what a tree grows from.
POOL = 16
#: The modulus of draws, and the constants that mix them.
PRIME, FACTOR, TERM = 2_147_483_647, 48_271, 11
MILLION = 1_000_000
#: Features closer than this are not cut.
LEAST_SPREAD = 1e-9


def mixed(h, x):
    """The next draw, an integer below PRIME, from the last one and a number (both integers, arrays or Columns)."""
    y = (h * FACTOR + (x % PRIME + PRIME) % PRIME + TERM) % PRIME
    return (y * y + h) % PRIME


def draw(seed: int, *numbers):
    h = seed
    for x in numbers:
        h = mixed(h, x)
    return h


def average_depth(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays over heap numbers: feature (-1 at a leaf), threshold, and the path length that a leaf stands for."""

    def __init__(self, feature, threshold, length, rows: int):
        self.feature, self.threshold, self.length, self.rows = feature, threshold, length, rows

    @classmethod
    def fit(cls, x: np.ndarray, trees: int, subsample: int, seed: int, seq: np.ndarray | None = None) -> Forest:
        """From the rows of x, numbered by seq (else by place). A tree grows from those with its smallest draws."""
        seq = np.arange(len(x)) if seq is None else np.asarray(seq, np.int64)
        rows = min(subsample, len(x))
        depth = int(np.ceil(np.log2(max(rows, 2))))
        size = 2 ** (depth + 1)
        feature, threshold, length = np.full((trees, size), -1, np.int8), np.zeros((trees, size)), np.zeros((trees, size), np.int64)
        for t in range(trees):
            chosen = np.lexsort((seq, mixed(draw(seed, t), seq)))[:rows]
            todo = [(1, x[chosen], 0)]
            while todo:
                node, part, level = todo.pop()
                low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(0), np.zeros(0))
                open_ = np.flatnonzero(high - low > LEAST_SPREAD)
                if level == depth or not len(open_):
                    length[t, node] = level * MILLION + int(np.rint(average_depth(len(part)) * MILLION))
                    continue
                f = int(open_[draw(seed, t, node, 1) % len(open_)])
                cut = low[f] + draw(seed, t, node, 2) / PRIME * (high[f] - low[f])
                goes = part[:, f] <= cut
                feature[t, node], threshold[t, node] = f, cut
                todo += [(2 * node, part[goes], level + 1), (2 * node + 1, part[~goes], level + 1)]
        return cls(feature, threshold, length, rows)

    def totals(self, x: np.ndarray) -> np.ndarray:
        """The sum of each row's path lengths in all trees, in millionths."""
        trees, at = np.arange(len(self.feature)), np.ones((len(x), len(self.feature)), np.int64)
        while True:
            f = self.feature[trees, at]
            if (f < 0).all():
                return self.length[trees, at].sum(axis=1)
            right = np.take_along_axis(x, np.maximum(f, 0).astype(np.int64), axis=1) > self.threshold[trees, at]
            at = np.where(f < 0, at, 2 * at + right)

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean path / average depth): the lower, the more unusual."""
        return -np.exp2(-(self.totals(x) / MILLION / len(self.feature)) / max(float(average_depth(self.rows)), 1e-9))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, feature=self.feature, threshold=self.threshold, length=self.length, rows=self.rows)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Forest:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return cls(z["feature"], z["threshold"], z["length"], int(z["rows"]))


#: Packed forests of all stations up to this size are sent to all tasks.
BROADCAST_BYTES = 64 << 20
#: Rows that meet their station's forest at once, where forests are too large to be sent to all tasks.
PART_ROWS = 65_536


def fit(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(station_id, forest, threshold) from usable rows (see mahalanobis.rates). A station's trees choose among POOL times as many
    rows as one grows from, those with the smallest draws, which Spark picks before it brings them together; the threshold is a
    quantile of the scores of all usable rows."""
    m = s.models
    order = Window.partitionBy("station_id").orderBy(mixed(mixed(F.lit(m.seed).cast("long"), F.col("seq").cast("long")), F.lit(1).cast("long")), "seq")
    used = rows.filter("usable").select("station_id", "seq", *FEATURES)
    drawn = used.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= POOL * m.subsample).drop("k")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[list(FEATURES)].to_numpy(np.float64)
        return pd.DataFrame({"station_id": frame["station_id"].iloc[:1], "forest": [Forest.fit(x, m.trees, m.subsample, m.seed, frame["seq"].to_numpy()).packed()]})

    forests = stored(importable(drawn).groupBy("station_id").applyInPandas(one, "station_id string, forest binary"))
    scores = stored(attach(used.withColumn("usable", F.lit(True)), forests).select("station_id", "iforest_score").filter("iforest_score IS NOT NULL"))
    return forests.join(low_quantile(scores, m.forest_quantile), "station_id")


def low_quantile(scores: DataFrame, q: float) -> DataFrame:
    """(station_id, threshold): of each station's n scores the one of rank q n, rounded up. An approximate quantile a little
    above leaves the lowest ones, among which that rank is exact."""
    about = scores.groupBy("station_id").agg(F.count("*").alias("n"), F.percentile_approx("iforest_score", min(1.0, q + 0.002), 10_000).alias("most"))
    rank = F.row_number().over(Window.partitionBy("station_id").orderBy("iforest_score"))
    low = scores.join(about, "station_id").filter("iforest_score <= most").withColumn("k", rank)
    return low.filter(F.col("k") == F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - F.col("n") * q))).select("station_id", F.col("iforest_score").alias("threshold"))


def _scores(names: np.ndarray, usable: np.ndarray, x: np.ndarray, forests: dict[str, Forest]) -> pa.Array:
    """The scores of usable rows; none for the others and for stations without a forest."""
    out = np.full(len(names), np.nan)
    for name in set(names[usable]):
        if name in forests:
            own = np.flatnonzero(usable & (names == name))
            out[own] = forests[name].score(x[own])
    return pa.array(out, from_pandas=True)


def _columns(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """station_id, usable and FEATURES as arrays."""
    names, usable, *x = parts
    return np.array(names.to_pylist(), object), np.asarray(usable.fill_null(False).to_numpy(zero_copy_only=False), bool), np.column_stack([f.to_numpy(zero_copy_only=False).astype(np.float64) for f in x])


def attach(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows (with usable and FEATURES) with iforest_score, null where a row is not usable. Only the features go to Python. Small
    models (up to BROADCAST_BYTES) are sent to all tasks; else each PART_ROWS rows or so of a station meet their forest in a task,
    and the scores are joined to the rows by station and seq (which then must name a row)."""
    importable(rows)
    size = models.agg(F.coalesce(F.sum(F.octet_length("forest")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        known = rows.sparkSession.sparkContext.broadcast({r["station_id"]: bytes(r["forest"]) for r in models.select("station_id", "forest").collect()})
        held: dict[str, Forest] = {}

        @F.arrow_udf("double")
        def scored(parts: pa.Array) -> pa.Array:
            if not held:
                held.update((k, Forest.unpacked(v)) for k, v in known.value.items())
            return _scores(*_columns(parts.flatten()), held)

        return rows.withColumn("iforest_score", scored(F.struct("station_id", "usable", *FEATURES)))

    def meet(left, right):
        forests = {n: Forest.unpacked(f) for n, f in zip(right.column("station_id").to_pylist(), right.column("forest").to_pylist(), strict=True)}
        return left.select(["station_id", "seq"]).append_column("iforest_score", _scores(*_columns([left.column(c).combine_chunks() for c in ("station_id", "usable", *FEATURES)]), forests))

    used = rows.filter("usable").select("station_id", "seq", "usable", *FEATURES)
    counts = used.groupBy("station_id").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts_"))
    left = used.join(counts, "station_id").withColumn("part_", F.pmod(F.xxhash64("seq"), F.col("parts_"))).drop("parts_")
    right = models.select("station_id", "forest").join(counts, "station_id").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_") - 1))).drop("parts_")
    found = left.groupBy("station_id", "part_").cogroup(right.groupBy("station_id", "part_")).applyInArrow(meet, f"station_id string, seq {rows.schema['seq'].dataType.simpleString()}, iforest_score double")
    return rows.join(found, ["station_id", "seq"], "left")


def score(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(station_id, seq, iforest_score, iforest_threshold) of usable rows."""
    used = rows.filter("usable").select("station_id", "seq", "usable", *FEATURES)
    return attach(used, models).join(models.select("station_id", F.col("threshold").alias("iforest_threshold")), "station_id").select("station_id", "seq", "iforest_score", "iforest_threshold")


def rare() -> Column:
    return F.col("iforest_score") < F.col("iforest_threshold")


def check() -> Check:
    return Check("isolation_forest", None, rare(), True, F.col("iforest_score"))
