"""Hard negatives by a norm-bucketed search.

Vectors become integers, floor(256 * x) per component; a score is their integer inner product. An anchor's positives are its
best other rows of the same label. For each positive with score s, its negatives are the best rows of other labels that score
from s / 2 to 19 s / 20: a window of scores. Both are one search for the best k scores in given windows.

Candidates are sorted by their norm: dealt to classes (a hash of the label) and in each class to ranges of norms, a range of
many rows to several strips; a strip is sorted by norm and cut into buckets of BUCKET_ROWS. By Cauchy-Schwarz a bucket of
largest norm t has no score above |q| t, so that a query leaves a strip at the first bucket where this is below its limit: the
greater of the window's lower end and the k-th score known so far. Queries are packed by class and by the norm that they need,
limit / |q|. Each pack first meets the strip of largest norms that can hold its rows, which gives limits; then it is sent to
the strips of norms that its queries still need. A strip stays in its task while the packs stream past it: candidates are
moved once, and only packs are copied. Scores are exact; ties go to the smaller id.

Rows whose label or vector is null, or with null or non-finite components, take no part, nor do empty vectors and rows with a
null id. Shorter vectors count as padded by zeros. A scaled component or a score beyond a 64-bit integer is held at that
integer's limit. An anchor's own row is every row with its id; rows that share an id are candidates each, anchors that share
one have results each. An anchor without other rows of its label has no positives and no rows; a window that no row meets
gives none. Hot labels, norms and vectors are many strips of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare
from .mtree import LIMIT, integers, matrix, pack, unpack

POSITIVES, NEGATIVES, EVERY = 5, 3, 50
BUCKET_ROWS, PACK_ROWS = 1024, 1024
#: A strip holds a 256th of all rows, within these bounds.
STRIP_ROWS = (4096, 65_536)
#: Classes of labels and ranges of norms: what reaches the driver is a row for each pair of them.
CLASSES, RANGES = 16, 64
#: Strips of up to so many tasks; further ones share tasks, one after the other.
TASKS = 10_000
#: Scores are compared as integers; bounds in floating point get this slack.
SLACK = 1e-9
#: Below this product of norms, inner products of doubles are exact.
EXACT = 2.0**52


def smallest(v: np.ndarray) -> np.ndarray:
    """v in the smallest integer type that holds it."""
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of the rows of q with those of x, held at the limits of a long."""
    if exact:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ x.astype(object).T
    return np.array([[max(-LIMIT, min(LIMIT - 1, int(s))) for s in row] for row in whole], np.int64).reshape(whole.shape)


class Strip:
    """Candidates by descending norm, in buckets."""

    def __init__(self, data: dict[str, np.ndarray]):
        self.ids, self.labels, self.v, self.norms = (data[k] for k in ("ids", "labels", "v", "norms"))
        self.wide = self.v.astype(np.float64)
        #: Buckets that were met and left out, for tests.
        self.met = self.passed = 0

    @staticmethod
    def made(ids, labels, v, norms) -> dict[str, np.ndarray]:
        order = np.lexsort((ids, -norms))
        return {"ids": ids[order], "labels": labels[order], "v": smallest(v[order]), "norms": norms[order]}

    def best(self, block: dict[str, np.ndarray], k: int, same: bool, bucket_rows: int = BUCKET_ROWS) -> list[np.ndarray]:
        """(query, window, vec_id, score) of the k best candidates in each window of each query of the block."""
        q, norms, high = block["v"], block["norms"], block["highs"]
        limit = block["lows"].copy()
        last = np.full(limit.shape, np.iinfo(np.int64).max)
        exact = float(norms.max(initial=0)) * float(self.norms[0]) < EXACT
        q = q.astype(np.float64) if exact else q
        held = [[np.zeros(0, np.int64)] * 3 for _ in range(limit.shape[1])]
        for a in range(0, len(self.ids), bucket_rows):
            rows = slice(a, a + bucket_rows)
            open_ = ((norms * float(self.norms[a]) * (1 + SLACK) + SLACK)[:, None] >= limit.astype(np.float64)) & (limit <= high)
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):  # norms fall and limits rise from here on
                self.passed += -(-(len(self.ids) - a) // bucket_rows)
                break
            self.met += 1
            s = scores(q[live], self.wide[rows] if exact else self.v[rows], exact)
            fit = ((block["labels"][live][:, None] == self.labels[rows]) == same) & (block["ids"][live][:, None] != self.ids[rows])
            for w in range(limit.shape[1]):
                good = fit & (s >= limit[live, w][:, None]) & (s <= high[live, w][:, None])
                if good.sum() > 4 * k * len(live) and s.shape[1] > k:
                    ranked = np.where(good, s, -LIMIT)
                    good &= s >= np.partition(ranked, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                i, j = np.nonzero(good)
                new, ids = s[i, j], self.ids[rows][j]
                i = live[i]
                better = (new > limit[i, w]) | (ids <= last[i, w])
                if not better.any():
                    continue
                i, new, ids = (np.concatenate((x, y[better])) for x, y in zip(held[w], (i, new, ids), strict=True))
                order = np.lexsort((ids, ~new, i))
                i, new, ids = i[order], new[order], ids[order]
                begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                place = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
                held[w] = [x[place < k] for x in (i, new, ids)]
                full = place == k - 1
                limit[i[full], w], last[i[full], w] = new[full], ids[full]
        return [np.concatenate([h[0] for h in held]), np.concatenate([np.full(len(h[0]), w) for w, h in enumerate(held)]), np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held])]


@dataclass
class Group:
    """Rows of one class and range: the numbers of their parts, and the smallest and largest value."""

    number: int
    klass: int
    first: int
    parts: int
    low: float
    high: float


def _class(label: str = "label") -> Column:
    return F.pmod(F.xxhash64(label), F.lit(CLASSES)).cast("int")


def dealt(rows: DataFrame, value: str, part_rows: int, most: int) -> tuple[DataFrame, list[Group]]:
    """rows with the number of their part ("part") and group ("group"), of about part_rows rows of one class and one of most
    ranges of the value."""
    n, classes = rows.agg(F.count("*"), F.count_distinct(_class())).first()
    ranges = max(1, min(most, -(-n // (part_rows * max(classes, 1)))))
    cuts = rows.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    where = F.size(F.filter(F.lit(sorted(set(cuts))), lambda x: x < F.col(value))) if cuts else F.lit(0)
    rows = rows.withColumn("group", _class() * ranges + where)
    groups, at = [], 0
    for r in rows.groupBy("group").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("group").collect():
        groups.append(Group(r["group"], r["group"] // ranges, at, -(-r["n"] // part_rows), r["low"], r["high"]))
        at += groups[-1].parts
    first, parts = ([0] * (CLASSES * ranges) for _ in range(2))
    for g in groups:
        first[g.number], parts[g.number] = g.first, g.parts
    of = lambda values: F.get(F.lit(values), F.col("group"))
    return rows.withColumn("part", (of(first) + F.pmod(F.xxhash64("number"), F.greatest(of(parts), F.lit(1)))).cast("int")), groups


def strips_of(points: DataFrame, width: int, strip_rows: int) -> tuple[DataFrame, list[Group]]:
    """(part, data) of the candidates."""
    numbered, groups = dealt(points, "norm", strip_rows, RANGES)

    def make(key, table):
        made = Strip.made(np.asarray(table.column("vec_id")), np.asarray(table.column("label")), matrix(table.column("v"), width), np.asarray(table.column("norm")))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pack(made)], pa.binary())})

    return cut(numbered.select("part", "vec_id", "label", "v", "norm").groupBy("part").applyInArrow(make, "part int, data binary")), groups


FOUND = "number long, window int, vec_id long, score long"


def met(strips: DataFrame, groups: list[Group], asked: DataFrame, chosen, width: int, k: int, same: bool, pack_rows: int, bucket_rows: int, sent: list[tuple[int, int]] | None) -> DataFrame | None:
    """What the queries find in the strips that chosen(their group) names as (first, parts)."""
    packs, kinds = dealt(asked, "need", pack_rows, RANGES)
    links = [(g.number, first, parts) for g in kinds for first, parts in chosen(g)]
    if not links:
        return None
    if sent is not None:
        of = {g.number: g for g in kinds}
        fit = {k.number: sum(g.parts for g in groups if not same or g.klass == k.klass) for k in kinds}
        sent.append((sum(of[number].parts * parts for number, _, parts in links), sum(k.parts * fit[k.number] for k in kinds)))

    def gather(key, table):
        windows = len(table.column("lows")[0].as_py())
        ends = {name: np.asarray(table.column(name).combine_chunks().flatten()).reshape(-1, windows) for name in ("lows", "highs")}
        data = pack({"ids": np.asarray(table.column("vec_id")), "numbers": np.asarray(table.column("number")), "labels": np.asarray(table.column("label")), "v": smallest(matrix(table.column("v"), width)), "norms": np.asarray(table.column("norm")), **ends})
        return pa.table({"group": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    packed = packs.select("group", "part", "vec_id", "number", "label", "v", "norm", "lows", "highs").groupBy("group", "part").applyInArrow(gather, "group int, data binary")
    table = asked.sparkSession.createDataFrame(links, "group int, first int, parts int")  # at most (classes x ranges)^2 rows
    copies = packed.join(F.broadcast(table), "group").select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "data")
    count = min(TASKS, max(g.first + g.parts for g in groups))
    both = strips.select("part", F.lit(0).alias("kind"), "data").unionByName(copies).repartitionById(count, F.pmod("part", F.lit(count)).cast("int")).sortWithinPartitions("part", "kind")

    def run(batches):
        strip = None
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                held = unpack(data.as_py())
                if not kind:
                    strip = Strip(held)
                    continue
                i, w, ids, found = strip.best(held, k, same, bucket_rows)
                yield pa.RecordBatch.from_arrays([pa.array(held["numbers"][i]), pa.array(w, pa.int32()), pa.array(ids), pa.array(found)], names=["number", "window", "vec_id", "score"])

    return both.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the k best of each window."""
    best = Window.partitionBy("number", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def needed(asked: DataFrame) -> DataFrame:
    """asked with the smallest norm of a row that any of a query's windows can hold; queries without an open window go."""
    least = F.array_min(F.transform(F.arrays_zip("lows", "highs"), lambda x: F.when(x["lows"] <= x["highs"], x["lows"])))
    need = F.when(F.col("least") <= 0, 0.0).when(F.col("norm") > 0, F.col("least").cast("double") / F.col("norm") * (1 - SLACK) - SLACK)
    return asked.withColumn("least", least).withColumn("need", need).filter("need IS NOT NULL").drop("least")


def search(strips: DataFrame, groups: list[Group], asked: DataFrame, *, width: int, k: int, same: bool, pack_rows: int = PACK_ROWS, bucket_rows: int = BUCKET_ROWS, sent: list[tuple[int, int]] | None = None) -> DataFrame:
    """(number, window, vec_id, score, rank) of the k best candidates in each window (lows, highs) of the queries asked
    (number, vec_id, label, v, norm), among rows of the same label or of other labels. sent gets for each round the pairs
    of a pack and a strip that meet, and how many there are."""
    asked = cut(asked)

    def fits(klass: int, g: Group) -> bool:
        return g.klass == klass if same else True

    def first(klass: int) -> Group | None:
        """The strips of largest norms that hold rows for queries of a class."""
        mine = [g for g in groups if (g.klass == klass) == same] or [g for g in groups if fits(klass, g)]
        return max(mine, key=lambda g: g.high, default=None)

    def begin(g: Group):
        top = first(g.klass)
        return [(top.first, 1)] if top and top.high >= g.low else []

    def others(g: Group):
        top = first(g.klass)
        out = [(s.first + (s is top), s.parts - (s is top)) for s in groups if fits(g.klass, s) and s.high >= g.low]
        return [x for x in out if x[1]]

    a = met(strips, groups, needed(asked), begin, width, k, same, pack_rows, bucket_rows, sent)
    if a is None:
        a = asked.sparkSession.createDataFrame([], FOUND)
    a = cut(ranked(a, k).drop("rank"))
    known = a.groupBy("number", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    known = known.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("known"))
    limit = F.transform("lows", lambda low, w: F.greatest(low, F.try_element_at("known", w)))
    again = cut(needed(asked.join(known, "number", "left").withColumn("lows", F.when(F.col("known").isNull(), F.col("lows")).otherwise(limit))).drop("known"))
    b = met(strips, groups, again, others, width, k, same, pack_rows, bucket_rows, sent)
    return ranked(a if b is None else a.unionByName(b), k)


def hard_negatives(vectors: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, strip_rows: int | None = None, pack_rows: int = PACK_ROWS, bucket_rows: int = BUCKET_ROWS, sent: list[tuple[int, int]] | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors (vec_id, embedding,
    label) that anchors selects."""
    prepare(vectors.sparkSession)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    labelled = integers(vectors.filter("label IS NOT NULL"), F.col("label").cast("long").alias("label"), anchors.alias("anchor"))
    points = cut(labelled.withColumns({"norm": size, "number": F.monotonically_increasing_id()}))
    rows, width = points.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    strips, groups = strips_of(points, width, strip_rows or max(STRIP_ROWS[0], min(STRIP_ROWS[1], rows // 256)))
    options = {"width": width, "pack_rows": pack_rows, "bucket_rows": bucket_rows, "sent": sent}
    asked = cut(points.filter("anchor").select("number", "vec_id", "label", "v", "norm"))
    whole = asked.withColumns({"lows": F.array(F.lit(-LIMIT)), "highs": F.array(F.lit(LIMIT - 1))})
    near = search(strips, groups, whole, k=positives, same=True, **options)
    # At most as many a query as positives: one list, in their order.
    listed = near.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    low, high = "(score - pmod(score, 2)) div 2 + pmod(score, 2)", "19 * ((score - pmod(score, 20)) div 20) + (19 * pmod(score, 20)) div 20"
    ends = near.select("number", "rank", F.expr(low).alias("low"), F.expr(high).alias("high"))
    ends = ends.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("ends"))
    kept = cut(listed.join(ends, "number"))
    blank = F.array_repeat(F.lit(0).cast("long"), positives)
    lows = F.slice(F.concat(F.col("ends.low"), F.transform(blank, lambda x: x + 1)), 1, positives)
    highs = F.slice(F.concat(F.col("ends.high"), blank), 1, positives)
    found = search(strips, groups, asked.join(kept.select("number", "ends"), "number").withColumns({"lows": lows, "highs": highs}).drop("ends"), k=negatives, same=False, **options)
    of = F.get("near", F.col("window"))
    return found.join(asked.select("number", F.col("vec_id").alias("anchor_id")).join(kept.select("number", "near"), "number"), "number").select(
        "anchor_id", of["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), of["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS p, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS c FROM good
), scores AS (
  SELECT q.vec_id AS anchor_id, x.vec_id AS vec_id, q.label = x.label AS same, CAST(sum(q.c * x.c) AS BIGINT) AS score
  FROM parts q JOIN parts x ON q.p = x.p AND q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
