"""Exact top-k search by inner product in M-trees, best first.

Vectors become integers, floor(256 * x) per component. With the norm bound M, each vector x gets one more component
sqrt(M^2 - |x|^2) and a query q gets zero there; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest scores are the nearest
vectors and metric bounds hold.

Vectors are dealt to cells, each to the nearest of at most CELLS pivots (rows drawn by a hash), and a cell's rows by a hash to
trees of about BLOCK_ROWS; each tree is an M-tree, stored as one row: leaf pages of at most PAGE entries, routing objects with
covering radii, and each entry's distance to its parent. Queries are packed into blocks, cell by cell. Each is searched first
in the cell of its nearest pivot, which gives it a k-th score; it then goes only to the cells that the pivot's distance less
the cell's covering radius doesn't exclude. In a tree, a query visits the pages in the order of their lower bounds,
max(0, d(q, routing object) - radius), until that bound exceeds its k-th distance; inside a page, entries with
|d(q, parent) - d(entry, parent)| above it are passed over without computing their distance. Bounds are slackened by a
rounding margin; scores themselves are exact integers, ties go to the smaller id.

Vectors that are null, empty, or hold null or non-finite components take no part, as candidates or as queries. Shorter
vectors count as padded by zeros. A scaled component or a score beyond a 64-bit integer is held at that integer's limit.
Rows with a null id take no part. Rows that share an id are candidates each, and a query's own row is every row with its id.
Query rows that share an id have a result each, ranks from 1 in each.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

SCALE, TOP, EVERY = 256, 5, 50
BLOCK_ROWS, PAGE, QUERY_ROWS = 4096, 256, 1024
#: Most pivots: their vectors and a row for each cell are what reaches the driver.
CELLS = 256
#: Trees of up to so many tasks; further ones share tasks, one after the other.
TASKS = 10_000
LIMIT = 1 << 63


def integers(vectors: DataFrame, *carried: Column) -> DataFrame:
    """(vec_id, v: array<long>) and the carried columns of the rows that take part."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), *carried)


def matrix(column, width: int) -> np.ndarray:
    """The lists of an Arrow column, none longer than width, as rows padded by zeros."""
    sizes = np.asarray(pc.list_value_length(column))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(pc.list_flatten(column))
    return out


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def extended(v: np.ndarray, bound: float) -> np.ndarray:
    """Vectors with the component that gives all of them the norm of the bound."""
    x = v.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(bound - (x**2).sum(axis=1), 0))))


def build(ids: np.ndarray, v: np.ndarray, bound: float, page: int = PAGE) -> dict[str, np.ndarray]:
    """An M-tree by bulk loading. Level 0 holds the vectors, level n the routing objects of the pages below; of each level:
    points, far (distance to the parent), ends (of its pages) and, above 0, radius. The last level has one page."""
    points, reach = extended(v, bound), np.zeros(len(ids))
    tree: dict[str, np.ndarray] = {}
    child = np.arange(len(ids))
    level, done = 0, False
    while not done:
        n = len(points)
        done = n <= page
        routes = np.arange(0, n, page) if not done else np.zeros(1, np.int64)
        square = (points**2).sum(axis=1)
        nearest = np.argmin(square[routes] - 2 * points @ points[routes].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        used, sizes = np.unique(nearest, return_counts=True)
        begin = np.cumsum(sizes) - sizes
        pages = [(r, a + k, min(a + k + page, a + m)) for r, a, m in zip(used.tolist(), begin.tolist(), sizes.tolist(), strict=True) for k in range(0, m, page)]
        points, reach, child = points[order], reach[order], child[order]
        heads = np.array([routes[r] for r, _, _ in pages])
        inverse = np.empty(n, np.int64)
        inverse[order] = np.arange(n)
        objects = points[inverse[heads]]
        ends = np.array([b for _, _, b in pages])
        own = np.repeat(np.arange(len(pages)), np.diff(np.concatenate(([0], ends))))
        far = np.sqrt(((points - objects[own]) ** 2).sum(axis=1))
        tree |= {f"points{level}": points, f"far{level}": far, f"ends{level}": ends, f"child{level}": child, f"reach{level}": reach}
        tree["root"] = objects
        reach = np.maximum.reduceat(far + reach, np.concatenate(([0], ends[:-1])))
        points, child, level = objects, np.arange(len(objects)), level + 1
    tree |= {"levels": np.array(level), "ids": ids[tree["child0"]], "bound": np.array(bound)}
    if bound >= 2.0**50:  # below that the points hold the integers exactly
        tree["v"] = v[tree["child0"]]
    return tree


def slack_of(square, bound: float):
    return 1e-9 * (square + bound) + 1e-9


def reach_of(square, bound: float, score):
    """The distance, slackened, of vectors that score as much. A score held at a long's lower limit excludes nothing."""
    return np.where(np.asarray(score, np.float64) <= -LIMIT, np.inf, np.sqrt(np.maximum(0.0, square + bound - 2.0 * np.asarray(score, np.float64)) + slack_of(square, bound)))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row of x to each pivot."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, held at the limits of a long. v holds floats where all products fit in their 53 bits."""
    if v.dtype == q.dtype == np.float64:
        return (v @ q).astype(np.int64)
    whole = [int(c) for c in q]
    return np.array([max(-LIMIT, min(LIMIT - 1, sum(a * b for a, b in zip(x, whole, strict=True)))) for x in v.astype(np.int64).tolist()], np.int64)


class Searcher:
    def __init__(self, tree: dict[str, np.ndarray]):
        self.tree, self.levels, self.bound = tree, int(tree["levels"]), float(tree["bound"])
        self.v = tree["v"] if "v" in tree else np.ascontiguousarray(tree["points0"][:, :-1])
        self.starts = [np.concatenate(([0], tree[f"ends{k}"][:-1])) for k in range(self.levels)]
        #: Distances computed and passed over, for tests and tuning.
        self.computed = self.skipped = 0

    def top(self, query_id: int, q: np.ndarray, k: int = TOP, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of this tree that can matter when floor is the k-th score known so far."""
        t = self.tree
        x = np.append(q.astype(np.float64), 0.0)
        square = float((x**2).sum())
        fits = self.v.dtype == np.float64 and square * self.bound < 2.0**104
        slack = slack_of(square, self.bound)
        found: list[tuple[int, int]] = []  # a heap of (score, -vec_id)

        def limit() -> float:
            s = found[0][0] if len(found) == k else None
            s = floor if s is None else s if floor is None else max(s, floor)
            return np.inf if s is None or s <= -LIMIT else max(0.0, square + self.bound - 2.0 * s + slack) ** 0.5

        top = self.levels - 1
        pages = [(0.0, top, 0, float(np.sqrt(((x - t["root"][0]) ** 2).sum())))]
        while pages:
            low, level, number, parent = heapq.heappop(pages)
            most = limit()
            if low > most:
                break
            a, b = int(self.starts[level][number]), int(t[f"ends{level}"][number])
            near = np.flatnonzero(np.abs(parent - t[f"far{level}"][a:b]) - t[f"reach{level}"][a:b] <= most + slack**0.5) + a
            self.computed += len(near)
            self.skipped += b - a - len(near)
            if not len(near):
                continue
            if level:
                d = np.sqrt(((t[f"points{level}"][near] - x) ** 2).sum(axis=1))
                for e, y, z in zip(near.tolist(), d.tolist(), (d - t[f"reach{level}"][near]).tolist(), strict=True):
                    if z <= most + slack**0.5:
                        heapq.heappush(pages, (max(0.0, z), level - 1, int(t[f"child{level}"][e]), y))
                continue
            whole = slice(a, b) if len(near) == b - a else near
            scores, ids = exact(self.v[whole], x[:-1] if fits else q), t["ids"][whole]
            least = found[0][0] if len(found) == k else floor
            good = ids != query_id
            if least is not None:
                good &= scores >= least
            if good.sum() > k:  # only what is at least the k-th best of the page can count
                good &= scores >= np.partition(scores[good], -k)[-k]
            for score, vec_id in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
                if len(found) < k:
                    heapq.heappush(found, (score, -vec_id))
                elif (score, -vec_id) > found[0]:
                    heapq.heapreplace(found, (score, -vec_id))
        return [(s, -i) for s, i in found]


SCHEMA = "number long, query_id long, vec_id long, score long"


def search(
    vectors: DataFrame, queries: DataFrame, *, k: int = TOP, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, cells: int = CELLS, sent: list[int] | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products for each row of queries (vec_id, embedding),
    over all rows of vectors but those with the query's own id. To sent, if given, go the pairs of a query and a cell that
    each of the two searches reads."""
    prepare(vectors.sparkSession)
    points = cut(integers(vectors).withColumn("row", F.monotonically_increasing_id()))
    asked = cut(integers(queries).withColumn("number", F.monotonically_increasing_id()))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, bound, width = points.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    bound, width = bound or 0.0, width or 1
    asked = asked.withColumn("v", F.slice("v", 1, width))
    drawn = points.orderBy(F.xxhash64("row"), "row").limit(max(1, min(cells, -(-n // block_rows)))).select("v").collect()
    pivots = np.unique(extended(matrix(pa.array([r.v for r in drawn], pa.list_(pa.int64())), width), bound), axis=0) if drawn else np.zeros((1, width + 1))

    def near(batches):
        for batch in batches:
            far = distances(extended(matrix(batch.column(1), width), bound), pivots)
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])], names=["vec_id", "v", "row", "cell", "far"])

    dealt = points.select("vec_id", "v", "row").mapInArrow(near, "vec_id long, v array<long>, row long, cell int, far double")
    sizes, radii = [0] * len(pivots), np.full(len(pivots), -np.inf)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["far"]
    blocks = [max(1, -(-m // block_rows)) for m in sizes]
    offsets = np.cumsum([0, *blocks[:-1]]).tolist()

    def grow(key, table):
        ids = np.asarray(table.column("vec_id"))
        order = np.argsort(ids, kind="stable")
        tree = build(ids[order], matrix(table.column("v"), width)[order], bound)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pack(tree)], pa.binary())})

    def of_cell(values: list[int]):
        return F.get(F.lit(values), F.col("cell"))

    numbered = dealt.select("vec_id", "v", "cell", F.pmod(F.xxhash64("row"), of_cell(blocks)).cast("int").alias("block"))
    trees = cut(numbered.groupBy("cell", "block").applyInArrow(grow, "cell int, block int, tree binary"))

    def home(batches):
        for batch in batches:
            far = distances(np.pad(matrix(batch.column(1), width).astype(np.float64), ((0, 0), (0, 1))), pivots)
            far[:, ~np.isfinite(radii)] = np.inf
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.nulls(len(cell), pa.int64())], names=["number", "cell", "floor"])

    def others(batches):
        for batch in batches:
            x = np.pad(matrix(batch.column(1), width).astype(np.float64), ((0, 0), (0, 1)))
            square, far = (x**2).sum(axis=1), distances(x, pivots)
            floors = batch.column(3).to_pylist()
            most = reach_of(square, bound, [-LIMIT if f is None else f for f in floors])
            open_ = (far - radii <= (most + slack_of(square, bound) ** 0.5)[:, None]) & np.isfinite(radii)
            open_[np.arange(len(x)), np.asarray(batch.column(2))] = False
            i, cell = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(cell, pa.int32()), batch.column(3).take(pa.array(i))], names=["number", "cell", "floor"])

    def gather(key, table):
        floors = table.column("floor")
        data = pack({
            "ids": np.asarray(table.column("vec_id")), "numbers": np.asarray(table.column("number")), "v": matrix(table.column("v"), width),
            "floors": np.asarray(floors.fill_null(-LIMIT)), "told": np.asarray(floors.is_valid()),
        })
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "queries": pa.array([data], pa.binary())})

    def run(batches):
        own = None
        for batch in batches:
            for kind, data in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                held, rows = unpack(data.as_py()), []
                if not kind:  # a tree stays while the query blocks sent to it stream past
                    own = Searcher(held)
                    continue
                known = [int(f) if told else None for f, told in zip(held["floors"], held["told"], strict=True)]
                for number, i, q, floor in zip(held["numbers"].tolist(), held["ids"].tolist(), held["v"], known, strict=True):
                    rows += [(number, i, v, s) for s, v in own.top(i, q, k, floor)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["number", "query_id", "vec_id", "score"])

    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")

    def ranked(rows):
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def met(links):
        """Results of the pairs (number, cell, floor): each tree of a cell meets each block of the cell's queries once. Trees are
        moved once, to a task each; only query blocks are copied."""
        counts = [0] * len(pivots)
        for r in links.groupBy("cell").count().collect():
            counts[r["cell"]] = r["count"]
        if sent is not None:
            sent.append(sum(counts))
        parts = [-(-c // query_rows) for c in counts]
        chosen = links.join(asked, "number").withColumn("part", F.pmod(F.xxhash64("number"), of_cell(parts)).cast("int"))
        packs = chosen.groupBy("cell", "part").applyInArrow(gather, "cell int, part int, queries binary")
        placed = (of_cell(offsets) + F.col("block")).alias("tree_number"), "cell"
        left = trees.filter(of_cell(parts) > 0).select(*placed, F.lit(0).alias("kind"), F.col("tree").alias("data"))
        right = packs.withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1))).select(*placed, F.lit(1).alias("kind"), F.col("queries").alias("data"))
        tasks = max(1, min(TASKS, sum(blocks)))
        both = left.unionByName(right).repartitionById(tasks, F.pmod("tree_number", F.lit(tasks)).cast("int")).sortWithinPartitions("tree_number", "kind")
        return both.mapInArrow(run, SCHEMA)

    homes = cut(asked.select("number", "v").mapInArrow(home, "number long, cell int, floor long"))
    first = cut(ranked(met(homes)).drop("rank"))
    floors = first.groupBy("number").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    told = asked.select("number", "v").join(homes.drop("floor"), "number").join(floors, "number", "left")
    links = cut(told.select("number", "v", "cell", "floor").mapInArrow(others, "number long, cell int, floor long"))
    return ranked(first.unionByName(met(links))).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS p, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS c FROM good
), scores AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(sum(q.c * x.c) AS BIGINT) AS score
  FROM parts q JOIN parts x ON q.p = x.p AND q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""
