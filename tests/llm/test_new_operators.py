"""Exact duplicates, periodic runs and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherglass.llm import exact_dedup as E
from weatherglass.llm import hard_negatives as H
from weatherglass.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, key int, row string, again boolean"
LONG = "many words of one text " * 100_000


def groups(rows):
    """Per row of (doc_id, text): what exact_duplicates says, by brute force; of full ties the first stays."""
    found = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        found[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for digest, members in found.items():
        best = min(members)
        out += [(rows[m[3]][0], rows[best[3]][0], len(members), m == best, digest) for m in members]
    return sorted(out, key=str)


ROWS = [(1, "a b c"), (2, "abc"), (3, "a  b\tc"), (4, "a bc"), (5, None), (6, ""), (7, " \n\x0b\x0c\r"), (None, "   x"), (None, "x"), (8, "x   "), (9, "one of its kind"), (9, "one of its kind"), (10, LONG), (11, LONG + " "), (12, LONG + "!"), (13, "\x00\x1f a"), (14, "é ü"), (15, "éü"), (None, "only"), (None, "only")]


@pytest.mark.parametrize("bounds", [{}, {"most_bytes": 1}, {"hot_rows": 1}])
def test_exact_duplicates(spark, bounds):
    rows = ROWS + [(100 + k, f"text {k % 300}") for k in range(500)] + [(1000 + k, "hot") for k in range(400)]
    docs = spark.createDataFrame([(*r, 1, "r", None) for r in rows], SCHEMA).repartition(5)
    got = E.exact_duplicates(docs, **bounds)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups(rows)


def test_deduplicated_keeps_whole_rows(spark):
    rows = [(*r, 1, "r", None) for r in ROWS] + [(200, "n", None, None, True)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = E.deduplicated(docs)
    assert got.schema == docs.schema
    want = sorted(((x[1], x[4]) for x in groups([r[:2] for r in rows]) if x[3]), key=str)
    mine = sorted(((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in got.collect()), key=str)
    assert mine == want
    empty = docs.limit(0)
    assert E.deduplicated(empty).count() == 0 == E.exact_duplicates(empty).count()


def test_unique_rows_pass_straight_through(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', IF(id < 40, 0, id)) AS text")
    counted = {}
    assert E.exact_duplicates(docs, counted=counted).filter("kept").count() == 3961
    assert counted["rows"] == 4000 and 40 <= counted["sent"] < 60


def test_filter_misses_no_repeated_key():
    r = np.random.default_rng(3)
    keys = [r.bytes(32) for _ in range(3000)]
    for most_bytes in (1 << 20, 1):
        one = E.Filter(200_000, most_bytes)
        once, twice = (np.zeros(one.bits, bool) for _ in range(2))
        for k in keys + keys[:100]:
            at = one.positions([k])[0]
            twice[at] |= once[at]
            once[at] = True
        one.twice = np.packbits(twice, bitorder="little")
        again = one.again(keys)
        assert again[:100].all() and again[100:].mean() < 0.05


def runs(w):
    """(start, end, smallest period) of all runs, by comparing the words at every distance."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            s = k
            while k < n - q and w[k] == w[k + q]:
                k += 1
            if k > s and k + q - s >= max(12, 2 * q):
                best.setdefault((s, k + q), q)
            k += 1
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def made(kind, n, r):
    if kind in (1, 2):
        return [r.randint(1, kind + 1) for _ in range(n)]
    if kind == 3:  # Fibonacci words have many runs
        a, b = [1], [1, 2]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:
        w = [1] * n
        for _ in range(r.randint(0, 3)):
            w[r.randrange(n)] = 2
        return w
    w = []
    while len(w) < n:
        part = [r.randint(1, 4) for _ in range(r.randint(1, max(1, n // 5)))]
        w += (part * r.randint(1, 3) + part[: r.randint(0, len(part))]) * r.randint(1, 3)
    return w


def test_runs_are_those_of_brute_force():
    r = random.Random(1)
    for k in range(600):
        w = made(k % 6, r.randint(1, 150) if k % 20 else 1200, r)
        assert [tuple(x) for x in P.runs_of(np.array(w)).tolist()] == runs(w), w
    for size in (12, 13, 24, 25):  # the shortest runs of each period
        for q in range(1, size // 2 + 1):
            w = [9, *(100 + k % q for k in range(size)), 8]
            assert [tuple(x) for x in P.runs_of(np.array(w)).tolist()] == runs(w)


def test_long_runs_take_little_time():
    n = 300_000
    for w in (np.ones(n, int), np.resize(np.arange(1, 8), n), np.resize(np.random.default_rng(1).integers(1, 5, 999), n)):
        assert P.runs_of(w)[0][:2].tolist() == [0, n]
    assert len(P.runs_of(np.resize([*[1] * 100, 2], n))) > n // 101


def periodic(doc_id, text):
    """What the query says of a document, by brute force."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("part_bytes", [1, 1 << 20])
def test_periodic_runs(spark, part_bytes):
    r = random.Random(2)
    rows = [(k, " ".join(f"w{x}" for x in made(k % 6, r.randint(1, 200), r))) for k in range(80)]
    rows += [(200 + k, " \n".join(str(x) for x in r.choices(range(60), k=r.randint(1, 300)))) for k in range(60)]
    rows += [(None, "a " * 30), (None, None), (300, None), (301, ""), (302, " \x0b\n"), (303, "x\u00a0y " * 20), (303, "x\u00a0y " * 20), (304, "\x00 \x1f " * 9), (305, "one"), (306, "a b " * 6), (307, "a b " * 5 + "a")]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 8
    docs = spark.createDataFrame([(*x, 1, "c", 5) for x in rows], "doc_id long, text string, runs int, collapsed string, start long").repartition(3)
    got = P.told(P.periodic_runs(P.planted(docs), part_bytes=part_bytes))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((periodic(*x) for x in rows), key=str)
    assert P.told(P.periodic_runs(P.planted(docs.limit(0)))).count() == 0


def test_periodic_runs_of_long_texts(spark):
    text = "the same few words again " * 120_000 + "end " * 90_000
    docs = spark.createDataFrame([(1, text), (5, text + "x")], "doc_id long, text string")
    assert all(zlib.crc32(str(i).encode()) % 10 for i in (1, 5))
    got = sorted((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs).collect())
    want = [(0, 600_000, 5), (600_000, 90_000, 1)]
    assert got == [(1, want, "the same few words again end"), (5, want, "the same few words again end x")]


def negatives(rows, anchors, positives=5, kept=3):
    """A Counter of all result rows for (vec_id, embedding, label) by comparing all pairs."""
    width = max((len(v) for _, v, _ in rows if v), default=1)
    used = [(i, [int(np.floor(256 * np.float64(x))) for x in v] + [0] * (width - len(v)), c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    hold = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    used = [(i, [hold(x) for x in v], c) for i, v, c in used]
    out = Counter()
    for i, v, c in used:
        if not anchors(i):
            continue
        scored = sorted((-hold(sum(a * b for a, b in zip(v, w, strict=True))), j, d) for j, w, d in used if j != i)
        for s, j in [(-s, j) for s, j, d in scored if d == c][:positives]:
            fit = [(-t, m) for t, m, d in scored if d != c and 50 * s <= 100 * -t <= 95 * s][:kept]
            out.update((i, j, n + 1, m, s, t) for n, (t, m) in enumerate(fit))
    return out


@pytest.mark.parametrize("bounds", [{}, {"strip_rows": 40, "pack_rows": 3, "bucket_rows": 16}, {"strip_rows": 100, "pack_rows": 50, "bucket_rows": 7}])
def test_hard_negatives(spark, bounds):
    r = np.random.default_rng(6)
    x = (r.normal(0, 1, (500, 8)) * r.lognormal(0, 0.8, (500, 1))).round(2)
    x[100:260] = x[100]  # a hot vector, of all labels
    label = np.where(r.random(500) < 0.4, 3, r.integers(-2, 40, 500))  # a hot label and rare ones
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    rows += [(600, None, 3), (605, [1.0, None], 3), (610, [float("nan")] * 8, 3), (615, [float("inf")] * 8, 3), (620, [1.0] * 8, None), (None, [1.0] * 8, 3), (625, [], 3), (630, [2.0, -1.0], 3), (50, [0.5] * 8, 3), (50, [0.5] * 8, 3), (635, [0.0] * 8, 3), (640, [1.0] * 8, 9999)]
    vectors = spark.createDataFrame([(*row, 1, "n", 2) for row in rows], "vec_id long, embedding array<double>, label int, number int, part string, norm int").repartition(4)
    got = H.hard_negatives(vectors, F.col("vec_id") % 5 == 0, **bounds)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == negatives(rows, lambda i: i % 5 == 0)
    assert H.hard_negatives(vectors.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert H.hard_negatives(vectors, F.lit(False)).count() == 0


def test_hard_negatives_of_huge_components(spark):
    rows = [(0, [1e15, -1e15], 1), (1, [3e15, 2e15], 1), (2, [1e12, 5.0], 1), (3, [1e13, 1e3], 2), (4, [7e14, 7e14], 2), (5, [1e-3, 1e3], 2), (6, [1e3, 1e3], 1), (7, [9e2, 8e2], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert Counter(map(tuple, H.hard_negatives(vectors, F.lit(True)).collect())) == negatives(rows, lambda i: True)


def test_buckets_below_the_limit_are_left_out(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (4000, 16))
    x *= (0.999 ** np.arange(4000))[:, None]
    rows = [(k, v.tolist(), k % 4) for k, v in enumerate(x.round(3))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sent = []
    got = Counter(map(tuple, H.hard_negatives(vectors, F.col("vec_id") % 200 == 0, strip_rows=50, pack_rows=1, sent=sent).collect()))
    assert got == negatives(rows, lambda i: i % 200 == 0)
    assert len(sent) == 4 and all(a < b / 2 for a, b in sent[:2]) and sum(a for a, _ in sent[2:]) < 0.8 * sent[3][1]
    v = np.floor(256 * x.round(3)).astype(np.int64)
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    strip = H.Strip(H.Strip.made(np.arange(4000), np.arange(4000) % 4, v, norms))
    block = {"ids": np.arange(8), "labels": np.arange(8) % 4, "v": v[:8], "norms": norms[:8], "lows": np.full((8, 1), -(1 << 63)), "highs": np.full((8, 1), (1 << 63) - 1)}
    strip.best(block, 5, True, 64)
    assert strip.passed > strip.met > 0


def test_new_oracles(spark):
    import duckdb

    from weatherglass.llm import queries

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("op11_exact_dedup", "op13_hard_negatives"):
        got = queries.queries()[name](spark, data).toPandas()
        order = list(got.columns)
        want = con.execute(queries.oracle_sql()[name]).df()[order]
        assert len(got) and got.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True))
