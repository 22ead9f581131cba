"""Text operators against brute force, on small planted tables and on hard rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken  # noqa: F401
import xxhash

from weatherglass.llm import decontamination as D
from weatherglass.llm import licenses, quality, sentencepiece_codec, sharding, simhash, token_counts
from weatherglass.llm.common import checkpoint_dir
from weatherglass.llm.components import components
from weatherglass.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"
rng = random.Random(5)
VOCABULARY = ["the", "of", "and", *("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(150))]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


#: Nulls, empty and very long texts, repeated rows and ids, ties, odd characters.
TEXTS = [None, "", "   \n", "One", "Two words", "a b c", prose(30, 1), prose(30, 1), prose(60, 2), prose(60, 2) + " more", prose(3000, 3), "é ü ✓ " * 5, "x" * 3000, prose(80, 4).upper(), "12 3a b4 -- 5"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", None, None, 9.5, 7) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], None, "s", 1, None, None), (None, prose(20, 9), None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_and_fm_index():
    r = np.random.default_rng(1)
    for n in (1, 5, 40, 300):
        text = r.integers(1, 4, n)
        text[r.random(n) < 0.1] = 0
        text[-1] = 0
        order = suffix_array(text)
        breaks = {int(p): k for k, p in enumerate(np.flatnonzero(text == 0))}
        key = lambda i: [(0, breaks[j]) if text[j] == 0 else (1, int(text[j])) for j in range(i, n)]
        assert order.tolist() == sorted(range(n), key=key)
        index = FMIndex(text, 3)
        for pattern in ([1], [2, 1], [3, 3], [1, 2, 3]):
            low, high = index.search(np.array([[0] * (4 - len(pattern)) + pattern]), np.array([len(pattern)]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(n) if text[i : i + len(pattern)].tolist() == pattern]
    wavelet = WaveletMatrix(np.array([3, 1, 0, 2, 3, 1]), 2)
    assert wavelet.rank(np.array([3, 1]), np.array([5, 6])).tolist() == [2, 2]
    assert wavelet.access(np.array([4]))[0].tolist() == [3]


def contamination(text, items):
    words = D.words_of(text.encode()) if text else []
    hit, names = set(), set()
    for name, item in items:
        own = D.words_of(item.encode()) if item else []
        for k in range(max(1, len(own) - 12) if own else 0):
            window = own[k : k + 13]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names.add(name)
    names = sorted(names)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, documents, nothing, block_bytes):
    long = prose(40, 77)
    items = [("10", long), ("9", prose(60, 2)), ("2", "Two words"), ("3", ""), ("4", None), ("5", "...")]
    extra = [(100, "start " + long + " end"), (101, " ".join(long.split()[:12])), (102, prose(2000, 8) + " " + " ".join(long.split()[3:16])), (103, (long + " ") * 4)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id string, text string, doc_id int")
    got = D.decontaminate(docs, bench, block_bytes=block_bytes)
    other = docs.select(docs.doc_id.alias("d"), "text")
    for r in got.join(other, got.doc_id == other.d).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contamination(r.text, items), r.doc_id
        assert sum(s["end"] - s["first"] for s in r.spans) == r.n_hit
    assert got.count() == docs.count()
    kept = {r.doc_id for r in D.kept(docs, bench, block_bytes=block_bytes).collect()}
    assert {100, 103, 8, 4}.isdisjoint(kept) and {101, 102, 0, 1} <= kept
    assert D.decontaminate(nothing, bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def reach(fps):
    """The smallest id that each of (id, fingerprint) reaches."""
    label = {i: i for i, _ in fps}
    for _ in fps:
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash(spark, documents, nothing):
    docs = documents.filter("doc_id IS NOT NULL")
    got = simhash.near_duplicates(docs).collect()
    fps = {(r.doc_id, fingerprint(r.text)) for r in docs.collect()}
    label = reach(sorted(fps))
    assert len(got) == docs.count()
    for r in got:
        assert (r.doc_id, int(r.fingerprint, 16)) in fps and len(r.fingerprint) == 16
        assert r.component_id == label[r.doc_id]
    assert simhash.near_duplicates(documents).filter("doc_id IS NULL").count() == 1
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"members": 64, "rows": 256}, {"members": 0, "rows": 1}])
def test_anchor_covering_loses_no_link(spark, bounds):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in r.choice(64, k, replace=False))) for b in base for k in (1, 2, 2, 3)]
    chain = [np.uint64((1 << (2 * k)) - 1) for k in range(20)]  # links of two bits only
    crowd = [base[0] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a in range(40) for b in range(40)]  # a crowded anchor
    fps = np.unique(np.concatenate((base, near, chain, crowd)).astype(np.uint64))
    words = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {row.node: row.root for row in components(simhash.links(words, **bounds)).collect()}
    a, b = [], []
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1
        a, b = a + [i] * len(j), b + j.tolist()
    label = simhash.forest(len(fps), np.array(a), np.array(b))
    mine = np.array([got.get(int(x), int(x)) for x in fps.view(np.int64)])
    for k in range(len(fps)):  # the same partition
        assert (label == label[k]).tolist() == (mine == mine[k]).tolist()


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (None, 1), (3, 5), (8, 9)] + [(k, k + 1) for k in range(20, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8} | {k: 20 for k in range(20, 61)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sharding(spark, documents, nothing):
    rows = [(i, prose(5 + i % 40, i % 150)) for i in range(1200)] + [(5000 + i, "hot text " * 9) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part_rows in (sharding.PART_ROWS, 20):
        got = sharding.shard(docs, shards=8, part_rows=part_rows).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        texts = dict(rows)
        sums, slots = {}, {}
        for r in got:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
            sums[r.shard] = sums.get(r.shard, 0) + r.size
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(sums) == set(range(8))
        if part_rows > 100:
            assert max(sums.values()) < 1.1 * sum(sums.values()) / 8
    where = {}
    for r in sharding.shard(docs, shards=8).collect():
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(x) > 1 for t, x in where.items() if not t.startswith("hot")) == 0 and len(where["hot text " * 9]) > 1
    assert sharding.shard(documents).count() == documents.count() and sharding.shard(nothing).count() == 0
    carried = sharding.shard(docs, shards=4, carry=("text",))
    assert carried.columns[-1] == "text" and carried.count() == len(rows)


def test_quality(spark, documents, nothing):
    good = [(i, prose(60, i)) for i in range(150)]
    bad = [(200 + i, " ".join(f"{w}{'***' if k % 2 else '$$$'}" for k, w in enumerate(prose(60, 300 + i).split()))) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), None) for i, _ in good + bad if i % 7] + [(3, None, 1), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.predicted == int(i < 200)
    assert quality.kept(docs, labels).columns == ["doc_id", "text"] and quality.kept(docs, labels).count() == 150
    assert quality.score(documents, labels).count() == documents.count() and quality.score(nothing, labels).count() == 0
    assert {r.predicted for r in quality.score(docs, labels.limit(0)).collect()} == {1}


def test_interactions_are_the_sum_of_all_pairs():
    r = np.random.default_rng(2)
    size = quality.BUCKETS + quality.N_STATS
    m = quality.Machine(0.2, r.normal(0, 0.1, size), r.normal(0, 0.1, (size, 3)), np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    found = quality.features(b"some words in a short text, some again")
    x = np.zeros(size)
    x[found[0]] = found[1]
    x[quality.BUCKETS :] = np.clip(found[2], -4, 4)
    logit = 0.2 + x @ m.linear + sum(x[i] * x[j] * (m.factors[i] @ m.factors[j]) for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert abs(m.score([found])[0] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_sentencepiece(spark, documents, nothing):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    extra = [(900, "日本語 €\n\t<s> x<0x0A> 🎉"), (901, "  two  spaces "), (902, "▁mark ▁")]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = sentencepiece_codec.encode(docs, MODEL, ids=True)
    rows = {r.doc_id: r for r in got.collect()}
    for i, text in texts.items():
        assert rows[i].ids == library.encode(text) and rows[i].n_tokens == len(rows[i].ids) and rows[i].round_trip and rows[i].parity
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(got, MODEL).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in texts.items() if i != 902)
    assert sentencepiece_codec.encode(documents, MODEL).count() == documents.count() and sentencepiece_codec.encode(nothing, MODEL).count() == 0


def test_token_counts(spark, documents, nothing):
    encoder = token_counts.encoder(open(RANKS, "rb").read())
    want = sorted((r.doc_id, len(encoder.encode_ordinary(r.text or ""))) for r in documents.filter("doc_id IS NOT NULL").collect())
    got = token_counts.count(documents, RANKS)
    assert sorted((r.doc_id, r.n_tokens) for r in got.filter("doc_id IS NOT NULL").collect()) == want and got.count() == documents.count()
    assert token_counts.count(nothing, RANKS).count() == 0


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block_bytes):
    r = np.random.default_rng(block_bytes)
    want = []
    for k in range(3):
        ids = r.integers(0, 4, 200).astype("<u2") if k else np.array([9, 9, 9, 0, 0, 9] + [1] * 50, "<u2")
        ids[ids == 3] = 9
        ids.tofile(tmp_path / f"f{k}.bin")
        ends = np.flatnonzero(ids == 9)
        want += [(f"f{k}.bin", n, int(c)) for n, c in enumerate(np.diff(np.concatenate(([-1], ends))) - 1)]
        if ends[-1] < len(ids) - 1:
            want.append((f"f{k}.bin", len(ends), len(ids) - 1 - int(ends[-1])))
    (tmp_path / "empty.bin").touch()
    got = token_counts.scan_files(spark, str(tmp_path), end=9, block_bytes=block_bytes).collect()
    assert sorted((x.file, x.ordinal, x.n_tokens) for x in got) == sorted(want)
    assert sum(not x.ended for x in got) >= 1


def test_licenses(spark, documents, nothing):
    texts = licenses.TEMPLATES
    changed = texts["mit"].replace("charge", "costs").replace("Software", "Program", 1)
    rows = [(1, prose(50, 1) + "\n" + texts["mit-notice"] + "\n" + prose(50, 2)), (2, texts["mit-notice"] * 3), (3, changed), (4, prose(400, 3)), (5, "Licensed under the moon, Version 2")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].license, got[1].coverage, got[1].n_matches, got[1].matches[0].first) == ("mit-notice", 1.0, 1, 50)
    assert got[2].n_matches == 3 and got[3].license == "mit" and 0.9 < got[3].coverage < 1 and got[4].license is None and got[5].license is None
    assert licenses.scan(documents).count() == documents.count() and licenses.scan(nothing).count() == 0


def test_licenses_take_the_best_window(spark):
    notice = "released under the mit license"
    rows = [(1, f"the the {notice}."), (2, "Released under the terms of the MIT License"), (3, f"mit {notice} license the mit"), (4, f"{notice} {notice}"), (5, f"the {notice} the")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (r.n_matches, r.coverage) for k, r in got.items()} == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 1.0), 4: (2, 1.0), 5: (1, 1.0)}
    assert (got[1].matches[0].first, got[1].matches[0].end) == (2, 7) and (got[3].matches[0].first, got[3].matches[0].end) == (1, 6)


def names(spark, *texts):
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [(r.license, sorted({m.license for m in r.matches})) for r in got]


def test_members_of_a_family_are_told_apart(spark):
    texts = {
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["lgpl-3.0-notice"], "This work is licensed under the GNU Affero General Public License, version 3.": ["agpl-3.0-notice"],
        "This work is licensed under the GNU General Public License, version 2.": ["gpl-2.0-notice"], "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0-notice"],
        "This work is licensed under the GNU Library General Public License, version 2.": [], "Licensed under CC BY 4.0.": ["cc-by-4.0-notice"], "Licensed under CC BY-SA 4.0.": ["cc-by-sa-4.0-notice"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0-notice"], "Licensed under CC BY-NC-SA 4.0.": ["cc-by-nc-sa-4.0-notice"], "Licensed under CC BY-NC 3.0.": [], "Released under the MIT License.": ["mit-notice"],
        "This is not Licensed under the Apache License Version 2": [], "Licensed under the Apache License Version 2": ["apache-2.0-notice"], "It isn't released under the MIT License.": [], "Licensed under the Apache License, Version 1.1.": [],
        "Never was it so. It is Licensed under the Apache License, Version 2.0.": ["apache-2.0-notice"], "Released under the BSD 3-Clause License": ["bsd-3-clause-notice"], "Released under the BSD 2-Clause License": ["bsd-2-clause-notice"],
        "SPDX-License-Identifier: BSD-3-Clause": ["spdx:bsd-3-clause"], "// SPDX-License-Identifier: (MIT OR Apache-2.0)": ["spdx:mit or apache-2.0"], "SPDX-License-Identifier: GPL-2.0-or-later WITH LLVM-exception\nand so on": ["spdx:gpl-2.0-or-later with llvm-exception"],
        "SPDX-License-Identifier: LicenseRef-Own": ["spdx"], "SPDX-License-Identifier: MIT and that is all": ["spdx:mit"], "SPDX-License-Identifier:": ["spdx"], "SPDX License": [],
    }
    for (text, want), (best, found) in zip(texts.items(), names(spark, *texts), strict=True):
        assert found == want and best == (want[0] if want else None), text
    plain = {n: t.replace("{", "").replace("}", "") for n, t in licenses.TEMPLATES.items()}
    for (name, _), (best, found) in zip(plain.items(), names(spark, *plain.values()), strict=True):
        family = name.rsplit("-", 1)[0]
        assert best == name, name
        assert all(x == name or x.rsplit("-", 1)[0] == family or name.startswith("apache") for x in found), (name, found)


def _patience(a, b, i=0, j=0):
    """Pairs by the definition: equal ends, then anchors that occur once in both, then the gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *_patience(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*_patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    once = [(x, b.index(w)) for x, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    chain = [once[k] for k in licenses.increasing([y for _, y in once])]
    if not chain:
        return []
    out, x, y = [], 0, 0
    for u, v in [*chain, (len(a), len(b))]:
        out += _patience(a[x:u], b[y:v], i + x, j + y)
        if u < len(a):
            out.append((i + u, j + v))
        x, y = u + 1, v + 1
    return out


def _scan(text, templates, coverage):
    """Matches of all templates by trying every window of a text."""
    words, out = D.words_of(text.encode()), []
    for name, template in sorted(templates.items()):
        parts = template.replace("}", "{").split("{")
        own = [D.words_of(p.encode()) for p in parts]
        t, runs, at = sum(own, []), [], 0
        for k, p in enumerate(own):
            if k % 2:
                runs.append((at, at + len(p)))
            at += len(p)
        width, least, found = int(len(t) * 1.25) + 3, int(np.ceil(coverage * len(t) - 1e-9)), {}
        for i in range(len(words)):
            if words[i] in t:
                pairs = _patience(t, words[i : i + width])
                where = dict(pairs)
                if len(pairs) >= least and all(a in where and all(where.get(k) == where[a] + k - a for k in range(a, b)) for a, b in runs):
                    found[i] = (-len(pairs), pairs[-1][1] - pairs[0][1], i + pairs[0][1], i + pairs[-1][1] + 1)
        i = 0
        while i < len(words):
            if i not in found:
                i += 1
                continue
            best, k = found[i], i + 1
            while k < best[3] and -best[0] < len(t):
                best = min(best, found.get(k, best))
                k += 1
            i = best[3]
            out.append((name, -best[0], best[2], best[3]))
    return out


def test_license_scan_is_that_of_all_windows():
    r = random.Random(4)
    letters = [chr(97 + k) for k in range(9)]
    for k in range(60):
        templates = {f"t{i}": " ".join(r.choices(letters, k=r.randint(2, 5))) + " {" + " ".join(r.choices(letters, k=r.randint(1, 2))) + "} " + " ".join(r.choices(letters, k=r.randint(1, 4))) for i in range(3)}
        texts = []
        for _ in range(4):
            words = r.choices(letters, k=r.randint(0, 60))
            for t in templates.values():
                at = r.randint(0, len(words))
                copy = t.replace("{", "").replace("}", "").split()
                if r.random() < 0.5:
                    copy[r.randrange(len(copy))] = "zz"
                words[at:at] = copy
            texts.append(" ".join(words))
        coverage = r.choice([0.6, 0.8, 1.0])
        got = licenses.Templates(templates, coverage).scan([t.encode() for t in texts])[1]
        for text, matches in zip(texts, got, strict=True):
            assert sorted((n, m, a, b) for n, _, a, b, m in matches) == sorted(_scan(text, templates, coverage)), text


def test_ties_of_licenses_go_to_the_smaller_name(spark):
    got = licenses.scan(spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string"), templates={"b": "alpha beta", "a": "gamma delta", "c": "beta"}).first()
    assert (got.license, got.n_matches, got.matched_words) == ("a", 3, 2)


#: Megabytes of words in one text.
HUGE = " ".join(VOCABULARY[(7 * k + k // 11) % len(VOCABULARY)] for k in range(1_700_000))


def test_texts_of_several_megabytes(spark):
    assert len(HUGE) > 8 << 20
    notice, passage = licenses.TEMPLATES["mit-notice"].replace("{", "").replace("}", ""), prose(40, 501)
    text = f"{notice} {HUGE} {passage} {notice}"
    docs = spark.createDataFrame([(1, text), (2, "short one"), (3, HUGE)], "doc_id long, text string")
    n = len(D.words_of(text.encode()))
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_matches, got[1].n_words, got[1].matches[1].end, got[3].n_matches) == (2, n, n, 0)
    bench = spark.createDataFrame([("7", passage)], "item_id string, text string")
    hit = {r.doc_id: r for r in D.decontaminate(docs, bench).collect()}
    assert (hit[1].n_words, hit[1].n_hit, hit[1].n_items, hit[1].contaminated, hit[3].n_hit) == (n, 40, 1, False, 0)
    told = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).collect()}
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(w), 42) for w in zip(*(HUGE.split()[k:] for k in range(3)), strict=False)], np.uint64)
    assert told[3] == sum(1 << j for j in range(64) if 2 * int(((hashes >> np.uint64(j)) & np.uint64(1)).sum()) > len(hashes))
    counts = {r.doc_id: r for r in sentencepiece_codec.encode(docs, MODEL).collect()}
    assert all(r.parity and r.round_trip for r in counts.values()) and counts[1].n_tokens > counts[3].n_tokens > 1_000_000
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    assert quality.score(docs, labels).count() == 3


def test_patience_is_a_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randint(0, 8) for _ in range(r.randint(0, 20))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        places = [r.randint(0, 30) for _ in range(12)]
        best = max((sum(1 for _ in s) for s in _increasing(places)), default=0)
        assert len(licenses.increasing(places)) == best
    assert licenses.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(k, k) for k in range(4)]


def _increasing(places):
    out = [[]]
    for p in places:
        out += [s + [p] for s in out if not s or s[-1] < p]
    return out


def test_sharding_of_repeated_rows(spark):
    rows = [(7, "the same text " * 3)] * 3000 + [(k, f"other {k}") for k in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=20).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
    mean = sum(r.size for r in got) / 20
    assert len(got) == 3200 and len(sizes) == 20 and all(abs(sum(r.size for r in x) - mean) < 0.13 * mean for x in sizes.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in sizes.values())


def test_decontamination_in_blocks(spark, documents):
    bench = spark.createDataFrame([(f"b{k}", prose(30, 1)[k * 3 :]) for k in range(6)] + [(None, prose(60, 2)), ("none", None), ("short", "Two words")], "item_id string, text string")
    one = sorted(map(str, D.decontaminate(documents, bench).collect()))
    assert one == sorted(map(str, D.decontaminate(documents, bench, block_bytes=150).collect())) and any("contaminated=True" in r for r in one)
    kept = [sorted(map(str, D.kept(documents, bench, block_bytes=b).collect())) for b in (1 << 20, 150)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < documents.count()
    blocks = [len(h.value.names) for h, _ in D.blocks_of(bench, 150)]
    assert len(blocks) > 3 and sum(blocks) == 8


def test_quality_of_repeated_documents(spark):
    docs = spark.createDataFrame([(k, f"good words {k} of a text") for k in range(40)] + [(k, f"!!! bad {k}") for k in range(40, 80)] + [(3, f"again {j}") for j in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int")
    a, b = (quality.train(d, labels) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.factors, b.factors) and np.array_equal(a.linear, b.linear)


def test_quality_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    got = quality.query(spark, data).filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(good) > 20 and len(bad) > 5 and (good[:, None] > bad[None, :]).mean() > 0.95 and (got.predicted == got.quality).mean() > 0.9


def _message(number, data):
    """A field of a protobuf message: bytes, an int or a float."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(data, bytes):
        return varint(number << 3 | 2) + varint(len(data)) + data
    if isinstance(data, float):
        return varint(number << 3 | 5) + struct.pack("<f", data)
    return varint(number << 3) + varint(data)


def _unigram(dummy_prefix=1):
    """A small unigram model, written out: its pieces have made-up scores."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256)), ("▁", -3.0, 1)]
    pieces += [(p, -4.0 - 0.01 * k, 1) for k, p in enumerate(["▁the", "▁a", "th", "e", "t", "h", "a", "b", "c", "▁ab", "bc", "abc", "d"])]
    out = b"".join(_message(1, _message(1, p.encode()) + _message(2, s) + _message(3, kind)) for p, s, kind in pieces)
    return out + _message(2, _message(3, 1) + _message(35, 1) + _message(40, 0)) + _message(3, _message(3, dummy_prefix) + _message(4, 1) + _message(5, 1))


@pytest.mark.parametrize("dummy_prefix", [0, 1])
def test_unigram_models(spark, tmp_path, dummy_prefix):
    from sentencepiece import SentencePieceProcessor

    data = _unigram(dummy_prefix)
    (tmp_path / "u.model").write_bytes(data)
    library, texts = SentencePieceProcessor(model_proto=data), ["", "the abc", "a  b", "abcabc thethe", "é the", "d", " the ", "ab abc bc", None]
    got = sentencepiece_codec.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "u.model"), ids=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert r.parity == (r.ids == library.encode(t or "")), t
    assert all(r.parity and r.round_trip for r in got)


def test_codec_memory_is_bounded():
    own = sentencepiece_codec.Codec(open(MODEL, "rb").read())
    small, sentencepiece_codec.REMEMBERED = sentencepiece_codec.REMEMBERED, 200_000
    try:
        for k in range(12):
            assert all(x[3] for x in own.encode([f"x{k}" * 5000, prose(200, k)]))
            assert own.held < 600_000
    finally:
        sentencepiece_codec.REMEMBERED = small


def test_codec_learns_common_segments_once(monkeypatch):
    own, asked = sentencepiece_codec.Codec(open(MODEL, "rb").read()), Counter()
    learn = own.learn
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 200_000)
    monkeypatch.setattr(own, "learn", lambda keys: asked.update(k.lstrip("▁") for k in keys) or learn(keys))
    for k in range(20):
        assert all(x[1] and x[3] for x in own.encode(["some common words", " ".join(f"w{k}x{j}" for j in range(200))]))
    assert sum(asked.values()) > 4000 and {asked[w] for w in ("some", "common", "words")} == {1}


@pytest.mark.parametrize("data", [open(MODEL, "rb").read(), _unigram(0), _unigram(1)], ids=["bpe", "plain", "prefixed"])
def test_codec_tells_what_decoding_gives(data):
    own, r = sentencepiece_codec.Codec(data), random.Random(8)
    parts = [*" ▁ab\n€é🎉\0", "  ", "<0x0A>", "<0x41>", "the ", "<s>", "<unk>", "▁▁"]
    texts = ["", " ", "▁", *("".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2000))]
    for some in ([""], [], texts):
        got = own.encode(some)
        assert len(got) == len(some)
        for text, (coded, back, _, same) in zip(some, got, strict=True):
            ids = np.frombuffer(coded, "<i4").tolist()
            assert (ids == own.library.encode(text)) == same and (own.decode([ids])[0] == own.expected(text)) == back, text


def test_checkpoint_folder_is_the_sessions(spark):
    assert checkpoint_dir(spark)
