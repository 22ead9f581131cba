"""Pages, vectors, conversations and the pipeline."""

import hashlib
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherglass.llm import chat, mtree, queries, wrappers

DATA = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><div id="header"><h1>Site</h1></div><nav><ul>{menu}</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content"><h2>{title}</h2>{body}<div class="share">share</div><div class="comments"><p>nice</p></div></div><aside>side</aside><form><p>mail</p></form><footer>&copy; us</footer></body></html>"""


def page(title, paragraphs):
    return PAGE.format(title=title, menu="".join(f'<li><a href="/{k}">m{k}</a></li>' for k in range(3)), body="".join(f"<p>{p}" for p in paragraphs))


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_pages(spark, broadcast_bytes):
    rows = [(k, f"http://a.example/{k}", page(f"T{k} &eacute;", [f"Some <b>bo</b>ld  text {k}", "&lt;x&gt;\n y"] * (1 + k)), "t") for k in range(4)]
    rows += [(10, "http://b.example/", page("Lone", ["only one"]), "t"), (11, None, None, "t"), (12, "http://a.example/x", "", "t"), (13, ":::", "plain text", "t"), (None, "http://a.example/1", page("N", ["q"]), None), (14, "http://a.example/y", "<p>" * 5000 + "deep", "t")]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), broadcast_bytes=broadcast_bytes).collect()}
    for k in range(4):
        assert got[k].text == f"T{k} é " + " ".join([f"Some bold text {k}", "<x> y"] * (1 + k)) and got[k].n_chars == len(got[k].text)
    assert (got[10].text, got[11].text, got[12].text, got[13].text, got[None].text, got[14].text) == ("Lone only one", "", "", "plain text", "N q", "deep")
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_is_a_union_free_expression():
    a, b = (wrappers.folded(wrappers.parse(page(t, p))) for t, p in (("A", ["x"]), ("B", ["x", "y", "z"])))
    told = wrappers.expression(wrappers.joined(a, b))
    assert "(<p>(slot)</p>)+" in told and "<h2>(slot)</h2>" in told and "'We use cookies'" in told
    one, two = (wrappers.folded(wrappers.parse(f"<div><h1>t</h1>{x}<p>b</p></div>")) for x in ("", "<table><tr><td>1</td></tr></table>"))
    assert "(<table>" in wrappers.expression(wrappers.joined(one, two)) and "</table>)?" in wrappers.expression(wrappers.joined(one, two))


def test_pages_of_any_depth(spark):
    shell = "<html><body><div class=tagline>All the news of {k}</div><div><div><div><div><article>{body}</article></div></div></div></div></body></html>"
    deep = "<div>" * 4000 + "<p>at the bottom</p>"
    rows = [(k, "http://a.example/", shell.format(k=k, body=f"<p>Paragraph {k} stands here at level eight, and says much more than the line above.</p>" * 3)) for k in range(2)]
    rows += [(k, "http://b.example/", deep) for k in (2, 3)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].count(f"Paragraph {k} stands here") == 3 for k in range(2)) and got[2] == got[3] == "at the bottom"


def text_by_page(*pages):
    held = {}
    for p in pages:
        wrappers._fold(held, "", wrappers.folded(wrappers.parse(p)))
    known = wrappers.rules(wrappers.unpacked(wrappers.packed(held[""])))
    return [wrappers.main_text(p, known) for p in pages]


def test_region_drops_nothing_but_boilerplate():
    few, many = "Some words of {0}", " ".join(f"And {{0}} says word {k}." for k in range(20))
    for layout in (f"<body><div class=intro>{few}</div><div class=story>{many}</div>", f"<main><article>{many}</article><section class=more>{few}</section></main>",
                   f"<body><h1>{few}</h1><div class=entry><p>{many}</div>", f"<body>{few}<div>{many}</div>", f"<body><div><div><ul><li>{few}<li>{few} too</ul><div>{many}</div></div></div>"):
        for names in (["one", "two"], ["alone"], ["same", "same"]):
            for name, got in zip(names, text_by_page(*(layout.format(n) for n in names)), strict=True):
                assert f"Some words of {name}" in got and all(f"And {name} says word {k}." in got for k in range(20))
    # Blocks that all pages share go, also lists and texts with inline elements; nav goes by its name.
    shared = "<body><nav>go</nav><div class=top>Best <b>news</b> in town</div><ul><li>Home<li>About us</ul><div class=story><p>{0}</div>"
    assert text_by_page(*(shared.format(many.format(n)) for n in "abc")) == [many.format(n) for n in "abc"]
    # Two layouts: the minority's body stays, though the majority's path holds a stub in it.
    major, minor = f"<body><div class=a>{many}</div>", f"<body><div class=a>stub {{0}}</div><div class=b>{many}</div>"
    assert text_by_page(*(major.format(n) for n in "abcd"), minor.format("e"))[-1] == "stub e " + many.format("e")
    # A block that only some pages have is not boilerplate, even if it is the same in all of these.
    some = ["<body><div class=fix>Correction</div><div class=story>{0}</div>", "<body><div class=story>{0}</div>"]
    assert text_by_page(some[0].format(many.format("a")), some[1].format(many.format("b")), some[0].format(many.format("c")))[0] == "Correction " + many.format("a")


def test_wrapper_decides_what_is_boilerplate():
    many = " ".join(f"And {{0}} says word {k}." for k in range(20))
    # A block inside the article that all pages have with the same text is the host's; alone it is the page's.
    inside = f"<body><article><p>{many}</p><div class=x>Write to the desk</div><p>{many}</p></article>"
    alone, *_ = text_by_page(inside.format("a"))
    four = text_by_page(*(inside.format(n) for n in "abcd"))
    assert "Write to the desk" in alone and not any("Write to the desk" in t for t in four)
    assert four[0] == f"{many} {many}".format("a")
    assert all("Write to the desk" in t for t in text_by_page(*[inside.format("same")] * 4))
    # What a class is about decides, not how many pages have it.
    plain, own = f"<body><article><p>{many}</p><div class=related-links>Read {{0}} too</div></article>", f"<body><article><p>{many}</p><div class=related-work>Others have {{0}} said</div><section id=search-methods>How {{0}} searched</section></article>"
    for names in ((plain, plain, plain, own), (own, own, plain, own), (own,)):
        got = text_by_page(*(x.format(n) for x, n in zip(names, "abcd", strict=False)))
        for x, n, text in zip(names, "abcd", got, strict=False):
            assert text == f"{many}".format(n) + (f" Others have {n} said How {n} searched" if x is own else "")


BOILERPLATE = [
    '<div class="comments"><p>Reader comment: nice!</p></div>', '<div class="advert">BUY NOW cheap pills</div>', '<div id="cookie-notice">We use cookies</div>', '<aside>side</aside>', '<ul class="related-links"><li><a href=/>More</a></ul>',
    '<section id=comments-section><ol class=comment-list><li>First!<li>A long comment, longer than the article. ' + "It goes on and on. " * 90 + '</ol></section>', '<div class="shareButtons">Share</div>', '<div class="cookiebanner">Accept</div>', '<div class="site-footer">Imprint</div>',
    '<div class="newsletter-signup"><p>Stay tuned</p></div>', '<div class="ad-slot ad-slot-3">Adverts</div>', '<div role="contentinfo">Info</div>', '<div class="notice">Site notice</div>', '<form><p>Write</p></form>', '<div class="x social">Follow us</div>',
]


@pytest.mark.parametrize("share", [1, 2, 4])
def test_boilerplate_of_any_share_of_pages_goes(share):
    many = " ".join(f"And {{0}} says word {k}." for k in range(20))
    for block in BOILERPLATE:
        for inside in (True, False):
            page_ = (lambda x: f"<body><article><p>{many}</p>{x}</article></body>") if inside else (lambda x: f"<body><article><p>{many}</p></article>{x}</body>")
            names = ["a", "b", "c", "d"]
            got = text_by_page(*(page_(block if k % share == 0 else "").format(n) for k, n in enumerate(names)))
            assert got == [many.format(n) for n in names], block
    behind = f"<body><article><p>{many}</p></article><section id=discussion><p>Reader comment: nice!</p></section></body>"
    within = f"<body><article><p>{many}</p><section id=discussion><p>We discuss {{0}}.</p></section></article></body>"
    assert text_by_page(behind.format("a"), within.format("b")) == [many.format("a"), many.format("b") + " We discuss b."]


def test_articles_in_marked_elements_stay():
    many = " ".join(f"And {{0}} says word {k}." for k in range(20))
    for mark in ("post-content social", "menu-recipe", "widget-story", "research-notice", "recommended-reading", "alert-details", "notice", "promo", "header", "banner"):
        for layout in (f'<body><div class="{mark}"><p>{many}</p></div></body>', f'<body><nav>go</nav><h1>Of {{0}}</h1><div class="{mark}"><p>{many}</p></div><div class=comments>nice {{0}}</div></body>', f'<body><article><div class="{mark}"><p>{many}</p></div></article><footer>us</footer></body>'):
            for n in (1, 4):
                got = text_by_page(*(layout.format(x) for x in "abcd"[:n]))
                assert got == [("Of {0} " if "<h1>" in layout else "").format(x) + many.format(x) for x in "abcd"[:n]], mark
    # A layout that is marked as a whole, and an article that is marked inside it.
    shell = f'<body><div class="wrapper sidebar share"><nav>go</nav><article class="share"><p>{many}</p></article></div></body>'
    assert text_by_page(shell.format("a")) == [many.format("a")]
    assert [wrappers.marked(x) for x in ("cookie-notice", "comments", "adbox", "related-posts", "post-comments", "post-header", "address", "shared", "menu-recipe", "header", "navbar-#", "sharebuttons x", "adverts_top")] == ["hard", "hard", "hard", "soft", "hard", "", "", "", "", "soft", "hard", "hard", "hard"]


def test_rules_do_not_depend_on_the_number_of_children_or_the_order_of_pages():
    def made(k, n, shared_at):
        blocks = [f"<div id=n{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}><p>text {k} {j}</p></div>" for j in range(n)]
        blocks.insert(shared_at, "<div class=imprint>Written by the desk</div>")
        return f"<body><nav>go</nav><main>{''.join(blocks)}</main></body>"

    for n in (3, 15, 20, 60, 150):
        pages = [made(k, n, min(n, 2 + k)) for k in range(5)]
        want = [" ".join(f"text {k} {j}" for j in range(n)) for k in range(5)]
        for order in ([0, 1, 2, 3, 4], [4, 2, 0, 1, 3], [3, 4, 1, 0, 2]):
            got = text_by_page(*(pages[k] for k in order))
            assert got == [want[k] for k in order]
        halves = [{}, {}]
        for k in range(5):
            wrappers._fold(halves[k % 2], "", wrappers.folded(wrappers.parse(pages[k])))
        both = wrappers.rules(wrappers.joined(halves[1][""], wrappers.unpacked(wrappers.packed(halves[0][""]))))
        assert [wrappers.main_text(p, both) for p in pages] == want
    assert text_by_page(made(0, 20, 3), made(1, 20, 5)) == [" ".join(f"text {k} {j}" for j in range(20)) for k in range(2)]


def test_long_lists_are_aligned_through_their_anchors():
    r = np.random.default_rng(4)
    for _ in range(20):
        a = [str(x) for x in r.permutation(600)[:400]]
        b = [x for x in a if r.random() < 0.7]
        for at in sorted(r.integers(0, len(b), 60).tolist()):
            b.insert(at, f"new{at}")
        found = wrappers.common(a, b)
        assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert all(a[i] == b[j] for i, j in found) and len(found) == sum(not x.startswith("new") for x in b)
    assert wrappers.common(["x"] * 300, ["y"] * 300) == [] and len(wrappers.common(["x", "y"] * 300, ["x", "y"] * 200)) == 400


def test_hard_pages_take_linear_time():
    text = "<p>The article says something here.</p>"
    wrappers.deep()
    began = time.time()
    for size in (20_000, 200_000):
        for odd in ("<a " * size, "<div>" * 5000, "<span>" * (size // 10) + "</b>" * size, "<b><div>" + "<span>" * 3000 + "</b>" * size, "<a href=\"x>" * (size // 2), "<!-- " * size, "<!x " * size, "</" * size, "<" * size, "<li>" * 3000, '<a "' * size + ">"):
            assert wrappers.parse(text + odd).children
            wrappers.main_text(text + odd, None)
    assert time.time() - began < 60
    assert wrappers.main_text("<div>" * 30 + text + "</div>" * 30, None) == "The article says something here." == wrappers.main_text(text + "<a " * 1000, {"path": [], "constants": []})[:32]


def test_wrappers_do_not_grow_with_pages():
    held, sizes = {}, []
    for k in range(24):
        blocks = "".join(f"<div id=n{k:02d}{chr(97 + j % 26)}{chr(97 + j // 26)}><p>text {k} {j}</p></div>" for j in range(100))
        wrappers._fold(held, "", wrappers.folded(wrappers.parse(f"<body><main>{blocks.replace('id=n', 'id=' + chr(97 + k))}</main></body>")))
        sizes.append(len(wrappers.packed(held[""])))
    assert sizes[-1] <= max(sizes[:3]) and sizes[-1] < 20_000
    wide = wrappers.folded(wrappers.parse("".join(f"<i{k}></i{k}><b{k}></b{k}>" for k in range(30)) * 40))
    assert len(wide[4]) <= 60


def generated(seed):
    """(page, main text) of a site with a menu, an article of some blocks, and a footer; the text by the page's own making."""
    r = np.random.default_rng(seed)
    say = lambda n: " ".join(f"w{x}" for x in r.integers(0, 500, n))
    blocks, told = [], []
    for _ in range(r.integers(2, 7)):
        kind, text = r.integers(0, 4), say(r.integers(5, 40))
        told.append(text)
        blocks.append([f"<p>{text}</p>", f"<h2>{text}", f"<ul><li>{text}</ul>", f"<blockquote>{text.replace(' ', ' <em>', 1)}</em></blockquote>"][kind])
    nest = r.integers(0, 12)
    head = "".join(f"<li><a href=/{k}>menu {k}</a>" for k in range(4))
    body = f"<html><body><nav><ul>{head}</ul></nav><div class=cookie-notice>Cookies {say(3)}</div>{'<div>' * nest}<article>{''.join(blocks)}</article>{'</div>' * nest}<div class=comments><p>{say(9)}</p></div><footer>Foot {seed % 3}</footer></body></html>"
    return body, " ".join(told)


def test_generated_sites():
    for site in range(12):
        made = [generated(97 * site + k) for k in range(8)]
        for (_, want), got in zip(made, text_by_page(*(p for p, _ in made)), strict=True):
            assert got == want


def test_texts_are_compared_whole():
    a, b = (wrappers.folded(wrappers.parse("<p>" + "same beginning " * 8 + end)) for end in ("one", "two"))
    assert "(slot)" in wrappers.expression(wrappers.joined(a, b)) and "(slot)" not in wrappers.expression(wrappers.joined(a, a))
    assert wrappers.unpacked(wrappers.packed(a)) == a


def test_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (600, 16)).round(3)
    x[300:420] = x[300]  # ties
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(700, None, 0), (750, [1.0, None], 0), (800, [float("nan")] * 16, 0), (850, [float("inf")] * 16, 0), (900, [0.5] * 3, 0), (None, [1.0] * 16, 0), (950, [], 0), (50, [0.25] * 16, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = mtree.search(vectors, vectors.filter("vec_id % 50 = 0"), block_rows=128, query_rows=5).collect()
    used = [(k, np.floor(256 * np.array(v + [0.0] * (16 - len(v)))).astype(int)) for k, v, _ in rows if k is not None and k not in (700, 750, 800, 850, 950)]
    want = Counter()
    for q, a in used:
        if q % 50 == 0:
            want.update([(q, i + 1, k, -s) for i, (s, k) in enumerate(sorted((-int(a @ b), k) for k, b in used if k != q)[:5])])
    assert Counter(tuple(r) for r in got) == want and sum(r.query_id == 50 for r in got) == 10  # two rows ask with id 50
    huge = spark.createDataFrame([(0, [1e15, -1e15]), (50, [1e15, 1e15]), (51, [3e15, 2e15])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in mtree.search(huge, huge.filter("vec_id = 50")).orderBy("rank").collect()] == [(51, (1 << 63) - 1), (0, 0)]
    assert mtree.search(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, 12])
def test_queries_meet_few_cells_of_clustered_vectors(spark, cells):
    r = np.random.default_rng(8)
    centres = r.normal(0, 1, (6, 12))
    x = np.concatenate([40 * c / np.linalg.norm(c) + r.normal(0, 0.2, (100, 12)) for c in centres]).round(2)
    x[250:290] = x[250]
    vectors = spark.createDataFrame([(k % 550, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent: list[int] = []
    got = mtree.search(vectors, vectors.filter("vec_id % 50 = 0"), block_rows=20, query_rows=4, cells=cells, sent=sent).collect()
    v = np.floor(256 * x).astype(np.int64)
    ids = np.arange(len(x)) % 550
    want = Counter()
    for q in np.flatnonzero(ids % 50 == 0):
        order = [i for i in np.lexsort((ids, -(v @ v[q]))) if ids[i] != ids[q]][:5]
        want.update([(int(ids[q]), n + 1, int(ids[i]), int(v[i] @ v[q])) for n, i in enumerate(order)])
    assert Counter(tuple(row) for row in got) == want
    asked = sum(ids % 50 == 0)
    assert sent[0] == asked and sent[1] == 0 if cells == 1 else sum(sent) < asked * cells / 2


def test_tree_passes_over_entries():
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(c * 40, 1, (300, 8)) for c in range(6)]).astype(np.int64)
    ids = np.arange(len(v))
    searcher = mtree.Searcher(mtree.build(ids, v, float((v**2).sum(axis=1).max()), page=32))
    for k in range(0, len(v), 100):
        scores = v @ v[k]
        want = [i for i in np.lexsort((ids, -scores)) if i != k][:5]
        assert [i for _, i in sorted(searcher.top(k, v[k]), key=lambda x: (-x[0], x[1]))] == want
    assert searcher.levels > 2 and searcher.skipped > 0


def test_conversations(spark):
    nasty = "a\\e\\h ### user: <b></turn>\n: #\\"
    rows = [(1, 0, "user", nasty, 5), (1, 1, "assistant", nasty, 5), (2, 1, "b: c", None, 5), (2, 0, None, "x", 5), (2, 1, "assistant", "twice", 5), (2, 1, "assistant", "twice", 5), (None, 0, "assistant", "n", 5)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int"))
    done = chat.formatted(turns)
    read = {r.conv_id: [(t.role, t.text) for t in r.read] for r in done.select("conv_id", chat.read_back().alias("read")).collect()}
    assert read == {1: [("user", nasty), ("assistant", nasty)], 2: [("", "x"), ("assistant", "twice"), ("assistant", "twice"), ("b: c", "")], None: [("assistant", "n")]}
    told = {r.conv_id: r for r in chat.digests(done).collect()}
    assert (told[1].n_turns, told[1].loss_chars, told[1].loss_sha256) == (2, len(nasty), hashlib.sha256(nasty.encode()).hexdigest())
    assert told[2].loss_sha256 == hashlib.sha256(b"twicetwice").hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(chat.canonical_turns(empty))).count() == 0


def test_layouts(spark):
    table = spark.sql("SELECT 1 AS conv_id, 'q' AS prompt, 'a' AS response, 'other' AS text, 3 AS turn")
    assert chat.layout_of(table.schema).name == "prompt_response"
    rows = ['{"messages": [{"role": "user", "content": "q"}], "id": 3}', '{"conversations": [{"from": "human", "value": "q"}]}', '{"instruction": "q", "input": "", "output": "a"}', '{"prompt": "q", "completion": "a"}', '{"foo": 1}', None, "broken"]
    rows += ['{"messages": [{"content": "q"}, {"role": "user", "content": "r"}]}', '{"messages": [{"role": "user", "content": "q"}, {"from": "human", "value": "lost"}]}', '{"messages": [{"role": "user", "content": "q"}, 5]}', '{"messages": []}', '{"messages": "x"}']
    got = chat.canonical_turns_json(spark.createDataFrame(list(enumerate(rows)), "k int, js string"), "js", "k").orderBy("k").collect()
    assert [r.layout for r in got] == ["messages", "from_value", "instruction", "prompt_completion", None, None, None, "messages", None, None, None, None]
    assert [[(t.role, t.text) for t in r.turns or []] for r in got] == [[("user", "q")], [("user", "q")], [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a")], [], [], [], [("", "q"), ("user", "r")], [], [], [], []]


@pytest.mark.parametrize("name", ["op4_exact_top_k", "op5_chat_formatting"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    order = list(got.columns)
    assert got.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True))


def test_pipeline_keeps_a_row_of_each_component(spark):
    import corpus_pipeline as P

    from weatherglass.llm import simhash

    said = [" ".join(f"word{(k * 37 + j * j * (k + 3)) % 997}" for j in range(40)) for k in range(8)]
    rows = [(None, said[0]), (None, said[1]), (None, said[2]), (None, said[2]), (None, None), (None, ""), (7, said[3]), (7, said[4]), (7, said[4])]
    rows += [(3, said[5]), (5, said[5]), (5, said[6]), (None, said[6]), (9, said[7]), (None, said[7])]
    fps = {simhash.fingerprint(t.encode()) for t in said}
    assert len(fps) == 8 and min((a ^ b).bit_count() for a in fps for b in fps if a != b) > 2
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    got = P.near_duplicate_stage(spark, docs, DATA)
    assert got.columns == docs.columns
    want = [(None, said[0]), (None, said[1]), (None, said[2]), (None, ""), (7, said[3]), (7, said[4]), (3, said[5]), (5, said[6]), (9, said[7])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_clashing_names(spark, k):
    import corpus_pipeline as P

    names = ["id_", "no_id_", "digest_", "copy_", "no_text", "id", "no_id", "digest", "row_", "row", "score", "predicted", "quality", "held_out", "toxic", "label", "item_id", "fp", "root", "least", "key", "node", "u", "v", "anchor", "in_0", "in_1", "spans", "items", "n_words", "count", "parity", "ids", "n_tokens", "ID__"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).cache()
    more = docs.select("*", *(F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names))
    name, stage = P.STAGES[k]
    got, plain = stage(spark, more, DATA).collect(), stage(spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in plain) and len(got) > 10
    if name != "tokens":
        assert stage(spark, more, DATA).columns == more.columns
        assert all(r[n] == f"{n} of {r.doc_id}" for r in got for n in names)


def test_many_equal_rows_are_one_before_their_exchange(spark):
    import corpus_pipeline as P

    docs = spark.range(9000).selectExpr("CAST(NULL AS long) AS doc_id", "IF(id % 3 = 0, NULL, IF(id % 3 = 1, '', 'one text of these')) AS text", "id AS n").repartition(6)
    got = P.near_duplicate_stage(spark, docs, DATA)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(None, ""), (None, "one text of these")]


def test_pipeline(spark):
    import corpus_pipeline as P

    from weatherglass.llm import decontamination, quality, sentencepiece_codec, simhash

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = docs.collect()
    good = {r.doc_id for r in quality.score(docs, labels).filter("predicted = 1").collect()}
    fps = sorted((r.doc_id, simhash.fingerprint(r.text.encode())) for r in rows if r.doc_id in good)
    label = {i: i for i, _ in fps}
    for i, a in fps:  # each id after all smaller ones
        for j, b in fps:
            if (a ^ b).bit_count() <= 2:
                low = min(label[i], label[j])
                for k in [k for k, v in label.items() if v in (label[i], label[j])]:
                    label[k] = low
    first = {i for i, v in label.items() if i == v}
    windows = decontamination.Windows([(str(r.item_id), r.text.encode()) for r in bench.collect()])
    clean = set()
    for r in rows:
        if r.doc_id in first:
            (n,), (spans,), _ = windows.find([r.text.encode()])
            hit = sum(b - a for a, b in spans)
            if not (hit and 20 * hit >= n):
                clean.add(r.doc_id)
    got = P.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean)
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=f"{sentencepiece_codec.TOKENIZERS}/piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
    assert all(r.parity and r.round_trip for r in got)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns
    assert sentencepiece_codec.TOKENIZERS
