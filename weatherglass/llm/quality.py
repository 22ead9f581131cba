"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

Features: log counts of lower-cased words hashed into BUCKETS (crc32), scaled to length one; statistics of the whole text's
structure (characters, case, punctuation, repetition, lines), standardised; the length. The score is
sigmoid(bias + w.x + 1/2 * sum_f((V_f.x)^2 - V_f^2.x^2)), the pairwise interactions of all features at rank RANK in time
linear in the features. Labels, lang, source and doc_id are no features.

It is trained on labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of them (the first by a hash
of doc_id), on the driver; the model has a fixed size and is sent to the tasks, which score every document.

Null texts are empty texts and have a score like any other. Labels that are null or contradict each other are left out;
without usable labels the score is 1, so that nothing is rejected. Rows are kept, also repeated ones; a null doc_id is scored
and not held out. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, prepare, utf8

BUCKETS, RANK = 2048, 8
TRAIN_ROWS = 8000
FOLDS, THRESHOLD = 5, 0.3

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SPACE = b" \t\n\r\x0b\x0c"
STOPS = b".,;:!?"
MARKS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) and c not in STOPS)

_bucket: dict[bytes, int] = {}


def _buckets(words) -> list[int]:
    if len(_bucket) > 500_000:
        _bucket.clear()
    out = []
    for w in words:
        b = _bucket.get(w)
        if b is None:
            b = _bucket[w] = zlib.crc32(w) % BUCKETS
        out.append(b)
    return out


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(buckets, their values, structure statistics) of a text."""
    text = text or b""
    n = max(1, len(text))
    raw = text.split()
    counts = Counter(text.lower().split())
    size = max(1, len(raw))

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / n

    lines = [x for x in text.split(b"\n") if x.strip()]
    top = counts.most_common(3)
    lengths = np.fromiter(map(len, raw), np.float64, len(raw)) if raw else np.zeros(1)
    repeats = sum(map(bytes.__eq__, raw[1:], raw)) if len(raw) > 1 else 0
    stats = [
        np.log1p(len(text)), np.log1p(len(raw)), float(lengths.mean()), float(lengths.std()), np.log1p(float(lengths.max())),
        share(UPPER), share(DIGITS), share(SPACE), share(STOPS), share(MARKS), share(b"!"), share(b"|"), share(LETTERS),
        len(counts) / size, len(counts) / size**0.8, (top[0][1] if top else 0) / size, sum(c for _, c in top) / size, repeats / size,
        len(set(lines)) / max(1, len(lines)), len(lines) / size, sum(1 for x in raw if x[-1] in MARKS) / size, sum(1 for x in raw if x.isupper()) / size,
        sum(1 for x in raw if x[:1].isupper()) / size, float(not raw),
    ]
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0), stats
    values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    sums = np.bincount(_buckets(counts), weights=values, minlength=BUCKETS)
    at = np.flatnonzero(sums)
    values = sums[at]
    return at, values / np.linalg.norm(values), stats


N_STATS = len(features(b"")[2])


@dataclass
class Machine:
    """bias, linear weights, factors (features x rank), and the mean and scale of the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def score(self, found: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        """Probabilities of label 1, by the sum-of-squares identity over each text's non-zero features."""
        stats = self.inputs(np.array([x[2] for x in found], np.float64).reshape(len(found), N_STATS))
        w, v = self.linear[BUCKETS:], self.factors[BUCKETS:]
        line, summed, squares = stats @ w, stats @ v, (stats**2) @ (v**2)
        for k, (at, values, _) in enumerate(found):
            own = self.factors[at] * values[:, None]
            line[k] += self.linear[at] @ values
            summed[k] += own.sum(axis=0)
            squares[k] += (own**2).sum(axis=0)
        logit = self.bias + line + 0.5 * (summed**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(found: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, *, epochs: int = 30, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 1) -> Machine:
    """Adam on the logistic loss, with weights that balance the two labels."""
    n = len(found)
    stats = np.array([x[2] for x in found], np.float64)
    m = Machine(0.0, np.zeros(0), np.zeros(0), stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    x = np.zeros((n, BUCKETS + N_STATS), np.float32)
    for k, (at, values, _) in enumerate(found):
        x[k, at] = values
    x[:, BUCKETS:] = m.inputs(stats)
    y = labels.astype(np.float32)
    weight = np.where(y == 1, n / max(1, 2 * y.sum()), n / max(1, 2 * (1 - y).sum())).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.01, (x.shape[1], RANK)).astype(np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            own = x[order[k : k + batch]]
            target, each = y[order[k : k + batch]], weight[order[k : k + batch]]
            summed, square = own @ params[2], own**2
            logit = params[0] + own @ params[1] + 0.5 * (summed**2 - square @ params[2] ** 2).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * each / len(own)
            grads = [np.array([error.sum()]), own.T @ error, own.T @ (summed * error[:, None]) - (square.T @ error)[:, None] * params[2]]
            step += 1
            pace = rate * (1 - epoch / epochs)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                g = g + decay * p
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g**2
                p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.bias, m.linear, m.factors = float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64)
    return m


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine fitted on at most rows labelled documents that are not held out; None if one label is missing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "quality")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # chosen has at most `rows` rows of two numbers.
    sample = texts.join(F.broadcast(chosen), "doc_id")
    # Of documents that share an id one is used, the first by a hash of its text: so at most `rows` rows reach the driver.
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct("quality", "text"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("x")).select("doc_id", "x.quality", "x.text")

    def run(batches):
        for b in batches:
            found = [features(t) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))],
                names=["doc_id", "quality", "at", "value", "stats"])

    got = sample.mapInArrow(run, "doc_id long, quality int, at array<long>, value array<double>, stats array<double>").toArrow().to_pandas()
    got = got.sort_values("doc_id", kind="stable")
    if got["quality"].nunique() < 2:
        return None
    return fit(list(zip(got["at"], got["value"], got["stats"], strict=True)), got["quality"].to_numpy())


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(documents: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of documents (doc_id, text)."""
    spark = prepare(documents.sparkSession)
    machine = spark.sparkContext.broadcast(train(documents, labels, rows=rows))

    def run(batches):
        for b in batches:
            own = machine.value
            texts = utf8(b.column(2))
            s = own.score([features(t) for t in texts]) if own and texts else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def kept(documents: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with all their columns, whose score is at least the threshold."""
    machine = prepare(documents.sparkSession).sparkContext.broadcast(train(documents, labels, rows=rows))
    return passing(documents, lambda texts: machine.value.score([features(t) for t in texts]) >= threshold if machine.value and texts else [True] * len(texts))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
