"""HTML extraction by union-free regular expressions, inferred per host.

A page is a sequence of tags and texts. A host's wrapper is a union-free regular expression over such tokens, kept as a tree
of elements: an element may be optional (missing in some pages) or repeated (several equal neighbours in a page), and a text
is a constant or a slot (texts that differ). Pages are aligned with the wrapper one by one, and wrappers with each other in
the same way: equal elements match, neighbours that match each other fold into a repeated group, an element that only one
side has becomes optional, and texts that differ become a slot. Each task folds its pages into one wrapper a host, and the
tasks' wrappers of a host are then folded into one, so no task holds a host's pages, and a wrapper's size is bounded by the
variety of tags, not by the pages.

The wrapper tells what is the host's and what is an article's (rules): the main region, the smallest element that all pages
have and outside which there is nothing but menus, headers, footers, sidebars, notices, adverts, forms, comments, and blocks
that are the same in all pages of the host; and those of its blocks that stand in all pages with the same text. Where layouts
differ the region is what they have in common, and of a host's only page nothing counts as the same in all. Extraction parses
each page, finds the region in it and joins its blocks: white space inside a block becomes one space, blocks are joined by one
space, character references are decoded. A page without the region falls back on its own main region.

What is boilerplate in a page is told by the names of elements and by the tokens of class, id and role: a token counts if all
of its words are of a fixed list, with one for boilerplate among them ("cookie-notice", "share-buttons"; not "menu-recipe"). No
count of pages overrules that, but the page's own structure and prose (text outside links and headings) do: what holds the main element or
the only article is no boilerplate, and where a word may also name an article's part ("notice", "social", "related"), the
element that holds most of the page's prose is not dropped. A section for discussion or replies behind the article is readers'
comments. What all pages have is kept apart as a set that only shrinks, so that it depends neither on the order in which pages
are folded nor on how many children an element has.

Numbers in class, id and role count as equal. Of many children of an element, those that come again count as repeated, and
those that some pages lack are told apart by name only: ids that differ from page to page don't make the wrapper grow.

Wrappers are sent to the tasks if they are below BROADCAST_BYTES; else pages and wrappers are joined by host.

Null and empty pages give an empty text; a null url is a host of its own. Rows are kept, also repeated ones; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, scalar, utf8

BROADCAST_BYTES = 32 << 20
GROUPS = 64
#: Longest text that a wrapper keeps as it is; of a longer one it keeps the beginning, the length and a digest.
SHORT = 64
#: Names of elements without content, and of those below which a wrapper does not look (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is no prose.
NO_PROSE = frozenset("a h1 h2 h3 h4 h5 h6".split())
#: Elements that are no part of an article.
ASIDE = frozenset("nav header footer aside form script style noscript iframe template button select option textarea input svg math dialog menu object embed canvas head title".split())
#: Words that mark boilerplate in class, id and role: those that hardly name an article's part, and those that may (fixed lists).
HARD = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsored cookie cookies consent gdpr comment comments disqus respond newsletter subscribe signup login share sharing nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer contentinfo complementary masthead pagination pager toolbar popup modal skip".split())
SOFT = frozenset("banner sponsor sponsors promo promos promotion promotions menu menus aside widget widgets header notice notices social related recommended recommendation recommendations search alert alerts".split())
#: Words that say where or how such an element stands, and the parts of an article that hard words are joined with.
FRAME = frozenset(
    "box bar bars wrap wrapper container list lists item items link links button buttons btn section sections area block blocks top bottom left right middle inner outer site page global primary secondary unit units slot slots form "
    "policy message messages panel panels posts articles body content row col column group holder module zone floating sticky fixed overlay thread text icon icons toggle count more latest popular up sign".split())
OWN = frozenset("post article entry".split())
#: Words of a section behind the article that holds readers' comments; inside an article they are its own.
BEHIND = frozenset("discussion replies reactions responses".split())
LONGEST = max(map(len, HARD | SOFT | FRAME | OWN))


@lru_cache(1 << 16)
def parts(token: str) -> tuple[str, ...] | None:
    """A class token as words of the lists, joined by -, _ or nothing; None if that can't be."""
    ways: list[tuple[str, ...] | None] = [()] + [None] * len(token)
    for k in range(1, len(token) + 1):
        if token[k - 1] in "-_#":
            ways[k] = ways[k - 1]
            continue
        for j in range(max(0, k - LONGEST), k):  # the longest word first
            if ways[j] is not None and any(token[j:k] in x for x in (HARD, SOFT, FRAME, OWN)):
                ways[k] = (*ways[j], token[j:k])
                break
    return ways[-1]


@lru_cache(1 << 16)
def marked(mark: str) -> str:
    """"hard" or "soft" if a token of class, id or role consists of words that mark boilerplate and of words for its place; else
    "". A token with any other word says what its element is about, and marks nothing."""
    found = ""
    for token in mark.split():
        told = frozenset(parts(token) or ())
        if told & HARD:
            return "hard"
        if told & SOFT and not told & OWN:
            found = "soft"
    return found


#: Tags that end an open paragraph or list item.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

DIGITS = re.compile(r"\d+")
STOP, NAME = re.compile("[>\"']"), re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Element:
    """name, mark (words of class, id and role), and children: elements and texts. settled() tells kind: "hard" or "soft"
    boilerplate, or "" for what is none, the digest and size of the text inside, and prose: its characters outside links and headings."""

    __slots__ = ("name", "mark", "children", "kind", "digest", "size", "prose", "alone")

    def __init__(self, name: str, mark: str = ""):
        self.name, self.mark, self.children = name, mark, []
        self.kind = "hard" if name in ASIDE else marked(mark) if mark and name not in ("html", "body", "main", "article") else ""
        self.digest, self.size, self.prose, self.alone = "", 0, 0, True

    @property
    def boilerplate(self) -> bool:
        return bool(self.kind)


class Stack:
    """The open elements, with the places of each name and of those that are not inline: every question takes constant time."""

    def __init__(self, root: Element):
        self.open, self.places, self.blocks = [root], {}, [0]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.open))
        if e.name not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append(e)

    def close(self, k: int) -> None:
        while len(self.open) > k:
            e = self.open.pop()
            self.places[e.name].pop()
            if e.name not in INLINE:
                self.blocks.pop()

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def end(self, name: str) -> None:
        """An end tag; that of an inline element does not reach out of a block."""
        k = self.last((name,))
        if k and not (name in INLINE and self.blocks[-1] > k):
            self.close(k)

    def close_to(self, names, stops) -> None:
        k = self.last(names)
        if k and k >= self.last(stops):
            self.close(k)


P_STOPS = frozenset("table td th li div article section main body button blockquote form".split())


def tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """The place of the > that ends a tag, outside quotes that are closed later; -1 without one. quotes: the last of each kind."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1 if quotes[m[0]] > m.start() else m.end()
    return -1


def parse(page: str) -> Element:
    """The tree of a page's tokens; unclosed and stray tags are mended as browsers do. Time is linear in the page."""
    root = Element("#page")
    stack, at, begun, n = Stack(root), 0, 0, len(page)
    quotes = {q: page.rfind(q) for q in "\"'"}
    articles = 0

    def said(a: int, b: int) -> None:
        if a < b:
            stack.open[-1].children.append(entities.unescape(page[a:b]))

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 == n:
            said(begun, n)
            return settled(root)
        head = page[lt + 1]
        if head in "!?":
            said(begun, lt)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt + 9)
                stack.open[-1].children.append(page[lt + 9 : n if end < 0 else end])
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            begun = at
            continue
        closing = head == "/"
        name = NAME.match(page, lt + 1 + closing)
        end = -1
        if name:
            end = tag_end(page, name.end(), quotes)
            end = page.find(">", name.end()) if end < 0 else end
            if end < 0:  # no tag ends from here on
                said(begun, n)
                return settled(root)
        if end < 0:
            at = lt + 1
            continue
        said(begun, lt)
        at = begun = end + 1
        attributes, name = page[name.end() : end], name[0].lower()
        if closing:
            stack.end(name)
            continue
        if name in ENDS_P:
            stack.close_to(("p",), P_STOPS)
        if name in SIBLINGS:
            stack.close_to(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,), SIBLINGS[name])
        mark = DIGITS.sub("#", " ".join(x[1] or x[2] or x[3] for x in ATTRIBUTE.findall(attributes)).lower()) if attributes.strip() else ""
        if mark and articles and not stack.places.get("article") and BEHIND & set(mark.split()):
            mark += " comments"
        articles += name == "article"
        own = Element(name, mark)
        stack.open[-1].children.append(own)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            own.children.append(page[at : close.start() if close else n])
            at = begun = close.end() if close else n
            continue
        stack.push(own)


# A wrapper's node: [name, mark, optional, repeated, children, digest, pages]; a text: ["#text", constant or None for a slot,
# optional, repeated, [characters seen], digest, pages]. The digest is that of all text inside, outside boilerplate: "" without
# text, None where it differs between pages; pages is the number of pages that have the node. The page's own node has one more
# part: what all pages have (shared).

#: Children from which equal ones count as repeated, and those that some pages lack are told apart by their names only: ids that
#: differ from page to page don't add up. What the wrapper decides rests on nodes that all pages have, which always stay.
WIDE = 96
#: Before the mark of an element that is an article's own, though it is marked like boilerplate.
KEPT = "+ "


def deep() -> None:
    """Pages nest to any depth. The functions on trees call themselves from Python only, which takes no stack of C's."""
    sys.setrecursionlimit(1 << 30)


def words(text: str) -> str:
    return " ".join(text.split())


def constant(text: str) -> str:
    """What stands for a text where texts are compared: never one value for two texts."""
    return text if len(text) <= SHORT else f"{text[:SHORT]}… {len(text)} {xxhash.xxh3_128_hexdigest(text)}"


def settled(root: Element) -> Element:
    """root, with the digest and prose of each element, and with an end to doubts about its kind: what is marked is no boilerplate
    if it holds the page's main or only article; and a soft mark does not count on what holds most of the page's prose."""
    articles = 0
    marked_: list[tuple[Element, bool]] = []

    def count(e: Element) -> tuple[int, bool]:
        nonlocal articles
        held, main = int(e.name == "article"), e.name == "main"
        articles += held
        for x in e.children:
            if not isinstance(x, str) and x.name not in RAW:
                more = count(x)
                held, main = held + more[0], main or more[1]
        if e.kind and e.name not in ASIDE:
            marked_.append((e, main or held == 1))
        return held, main

    def measure(e: Element, link: bool) -> int:
        e.prose = 0
        if e.name not in RAW and e.name not in ASIDE:
            link = link or e.name in NO_PROSE
            for x in e.children:
                if isinstance(x, str):
                    e.prose += 0 if link else len(x.strip())
                else:
                    inner = measure(x, link)
                    e.prose += 0 if x.kind else inner
        return e.prose

    def outer(e: Element) -> list[Element]:
        """The soft elements outside other boilerplate."""
        out = []
        for x in e.children:
            if not isinstance(x, str) and x.name not in RAW:
                out += [x] if x.kind == "soft" else [] if x.kind else outer(x)
        return out

    def keep(e: Element) -> None:
        e.kind, e.mark = "", KEPT + e.mark

    def digest(e: Element) -> None:
        names: dict[tuple, Element | None] = {}
        run: list[str] = []
        told, e.size = "", 0

        def end() -> str:
            if not run:
                return ""
            text = words("".join(run))
            run.clear()
            e.size += len(text)
            return constant(text)

        for x in e.children:
            if isinstance(x, str):
                run.append(x)
            elif x.name == "br":
                run.append(" ")
            elif x.name in INLINE:
                if not x.boilerplate:
                    run.append(f" {text_of(x)} ")
            else:
                told = both(told, end())
                digest(x)
                if not x.boilerplate:
                    told, e.size = both(told, x.digest), e.size + x.size
                first = names.setdefault((x.name, x.mark), x)
                if first is not x:
                    first.alone = x.alone = False
        e.digest = "" if e.name in RAW else both(told, end())

    count(root)
    for e, holds in marked_:
        if holds and articles == 1:
            keep(e)
    if marked_:
        measure(root, False)
        while soft := outer(root):
            most = max(soft, key=lambda x: x.prose)
            if not most.prose or 2 * most.prose < root.prose + sum(x.prose for x in soft):
                if root.prose or not most.prose:
                    break
            keep(most)
            measure(root, False)
    digest(root)
    return root


def name_of(e: Element) -> str:
    """What stands for an element with its text, where those of different pages are compared."""
    return xxhash.xxh3_128_hexdigest(f"{e.name}\0{e.mark}\0{e.digest}")


def shared(root: Element) -> list[str]:
    """The names of a page's blocks outside boilerplate that have text and no sibling of their kind."""
    out: set[str] = set()
    todo = [root]
    while todo:
        for x in todo.pop().children:
            if not isinstance(x, str) and x.name not in INLINE and not x.boilerplate:
                if x.digest and x.alone:
                    out.add(name_of(x))
                todo.append(x)
    return sorted(out)


def folded(element: Element) -> list:
    """The wrapper of one page: equal neighbours are folded into repeated groups."""
    children: list = []
    run: list[str] = []  # a text goes on through inline elements

    def end() -> None:
        text = words("".join(run))
        run.clear()
        if text:
            text_ = constant(text)
            children.append(["#text", text_, 0, 0, [len(text)], text_, 1])

    if element.name not in RAW:
        for x in element.children:
            if isinstance(x, str):
                run.append(x)
            elif x.name == "br":
                run.append(" ")
            elif x.name in INLINE:
                if not x.boilerplate:
                    run.append(f" {text_of(x)} ")
            else:
                end()
                children.append(folded(x))
        end()
    node = [element.name, element.mark, 0, 0, bounded(squeezed(children), both), "" if element.boilerplate else element.digest, 1]
    return [*node, shared(element)] if element.name == "#page" else node


def both(a: str | None, b: str | None) -> str | None:
    """The digest of two neighbours."""
    if a is None or b is None:
        return None
    return constant(f"{a}\0{b}") if a and b else a or b


def key(node: list) -> tuple:
    return (node[0], "" if node[0] == "#text" else node[1])


def squeezed(nodes: list) -> list:
    """Runs of matching neighbours, of one element or of a group that repeats as a whole, folded into repeated ones."""
    out: list = []
    for node in nodes:
        if out and key(out[-1]) == key(node):
            out[-1] = joined(out[-1], node, both)
            out[-1][3] = 1
        else:
            out.append(node)
        for size in (2, 3):  # A B A B -> (A B)+: both become repeated, so that later pages match any number
            if len(out) >= 2 * size and [key(x) for x in out[-size:]] == [key(x) for x in out[-2 * size : -size]]:
                tail = out[-size:]
                del out[-size:]
                for k, x in enumerate(tail):
                    out[k - size] = joined(out[k - size], x, both)
                    out[k - size][3] = 1
                break
    return out


def bounded(nodes: list, digest) -> list:
    """nodes, if they are few; else with one repeated node for each key that comes again, and if that is not enough, with one
    optional node a name for those that some pages lack. A wrapper grows with the variety of tags and with what all pages have,
    not with the pages."""
    for kind in (key, lambda x: (x[0], "" if x[0] == "#text" or _plain(x[0], x[1]) else "ad")):
        if len(nodes) <= WIDE:
            return nodes
        out: list = []
        at: dict[tuple, int] = {}
        for x in nodes:
            k = kind(x)
            if kind is not key:
                if not x[2]:
                    out.append(x)
                    continue
                x = [k[0], x[1] if k[0] == "#text" else k[1], *x[2:]]
            if k in at:
                out[at[k]] = joined(out[at[k]], x, digest if digest is both else same)
                out[at[k]][3] = 1
            else:
                at[k] = len(out)
                out.append(x)
        nodes = out
    return nodes


def same(a: str | None, b: str | None) -> str | None:
    """The digest of one place in two pages."""
    return a if a == b else None


def joined(a: list, b: list, digest=same) -> list:
    """Two matching nodes as one: of different pages, or (digest: both) neighbours in a page."""
    flags, pages = (a[2] | b[2], a[3] | b[3]), max(a[6], b[6]) if digest is both else a[6] + b[6]
    if a[0] == "#text":
        return ["#text", a[1] if a[1] == b[1] else None, *flags, [a[4][0] + b[4][0]], digest(a[5], b[5]), pages]
    node = [a[0], a[1], *flags, aligned(a[4], b[4], digest), digest(a[5], b[5]), pages]
    return [*node, sorted(set(a[7]) & set(b[7]))] if len(a) > 7 else node


def common(a: list, b: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence; in long lists, of one through the keys that both have once."""
    n, m = len(a), len(b)
    begin = 0
    while begin < min(n, m) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(n, m) - begin and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    a_, b_ = a[begin : n - end], b[begin : m - end]
    out = [(k, k) for k in range(begin)]
    if a_ and b_ and len(a_) * len(b_) <= WIDE * WIDE:
        best = [[0] * (len(b_) + 1) for _ in range(len(a_) + 1)]
        for i in range(len(a_) - 1, -1, -1):
            for j in range(len(b_) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a_[i] == b_[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a_) and j < len(b_):
            if a_[i] == b_[j]:
                out.append((begin + i, begin + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    elif a_ and b_:
        once = [{k: i for i, k in enumerate(x) if c[k] == 1} for x in (a_, b_) for c in (Counter(x),)]
        pairs = [(i, once[1][k]) for k, i in sorted(once[0].items(), key=lambda x: x[1]) if k in once[1]]
        ends: list[int] = []  # the last place of the best chain of each length, and the chain's pairs before it
        last: list[int] = []
        before = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(ends, j)
            before[k] = last[at - 1] if at else -1
            ends[at : at + 1], last[at : at + 1] = [j], [k]
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        i = j = 0
        for x, y in [*reversed(chain), (len(a_), len(b_))]:
            if chain:
                out += [(begin + i + u, begin + j + v) for u, v in common(a_[i:x], b_[j:y])]
            if x < len(a_):
                out.append((begin + x, begin + y))
            i, j = x + 1, y + 1
    return out + [(n - k, m - k) for k in range(end, 0, -1)]


def aligned(a: list, b: list, digest=same) -> list:
    """Two child lists as one, by a common subsequence: what only one has becomes optional."""
    out, i, j = [], 0, 0
    for x, y in [*common([key(x) for x in a], [key(x) for x in b]), (len(a), len(b))]:
        out += [[*v[:2], 1, *v[3:]] for v in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(joined(a[x], b[y], digest))
        i, j = x + 1, y + 1
    return bounded(squeezed(out), digest)


def expression(node: list) -> str:
    """A wrapper as a regular expression over tokens, for reading."""
    if node[0] == "#text":
        inner = "(slot)" if node[1] is None else repr(node[1])
    else:
        inner = f"<{node[0]}{' ' + node[1] if node[1] else ''}>" + "".join(map(expression, node[4])) + f"</{node[0]}>"
    return f"({inner})+" + "?" * node[2] if node[3] else f"({inner})?" if node[2] else inner


def packed(wrapper: list) -> str:
    """A wrapper as JSON: its nodes one after the other, each before its children and with their number."""
    out, left = [], [wrapper]
    while left:
        node = left.pop()
        if node[0] == "#text":
            out.append(node)
        else:
            out.append([*node[:4], len(node[4]), *node[5:]])
            left.extend(reversed(node[4]))
    return json.dumps(out)


def unpacked(text: str) -> list:
    top: list = []
    open_ = [(top, 1)]  # lists of children and their final lengths
    for node in json.loads(text):
        while len(open_[-1][0]) == open_[-1][1]:
            open_.pop()
        open_[-1][0].append(node)
        if node[0] != "#text":
            open_.append(([], node[4]))
            node[4] = open_[-1][0]
    return top[0]


@lru_cache(1 << 16)
def _plain(name: str, mark: str) -> bool:
    return mark.startswith(KEPT) and name not in ASIDE or not Element(name, mark).boilerplate


def masses(wrapper: list, sometimes: bool) -> dict[int, int]:
    """By node (its id): characters outside boilerplate, ten times those that aren't the same in all pages. sometimes: nothing
    is known to be the same, as with a single page; so it is with what is optional."""
    out: dict[int, int] = {}

    def add(node: list, weight: int, sometimes: bool) -> int:
        total = 0
        if node[0] == "#text":
            total = node[4][0] * weight
        elif _plain(node[0], node[1]):
            for x in node[4]:
                total += add(x, 1 if not sometimes and fixed(x) else weight, sometimes or bool(x[2]))
        out[id(node)] = total
        return total

    add(wrapper, 10, sometimes)
    return out


def fixed(node: list) -> bool:
    """Is a node's text the same in all pages that have its parent?"""
    return node[5] is not None and not node[2]


def region(wrapper: list) -> list[tuple[str, str]]:
    """The path (names and marks) to the main element: down from the page as long as one child holds most of the text and
    its siblings are boilerplate or the same in all pages; not below article or main."""
    path, node, sometimes = [], wrapper, wrapper[5] is not None
    mass = masses(wrapper, sometimes)
    while True:
        inner = [x for x in node[4] if x[0] == "#text" or _plain(x[0], x[1])]
        total = mass[id(node)]
        heavy = max(inner, key=lambda x: mass[id(x)], default=None)
        if heavy is None or heavy[2] or not total or mass[id(heavy)] < 0.6 * total or heavy[0] in ("#text", "p", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "dl", "figure"):
            return path
        if any(x is not heavy and x[5] != "" and (sometimes or not fixed(x)) for x in inner):
            return path
        path.append((heavy[0], heavy[1]))
        node = heavy
        sometimes = sometimes or node[5] is not None
        if node[0] in ("article", "main") and not any(x[0] == "article" for x in node[4]):
            return path


def rules(wrapper: list) -> dict:
    """What the wrapper says of its host's pages. path: to the main element. constants: blocks that stand in all pages with the
    same text (name_of), if there are several pages that are not all the same."""
    return {"path": region(wrapper), "constants": wrapper[7] if wrapper[6] > 1 and wrapper[5] is None else []}


def found(root: Element, path: list) -> list[Element]:
    """The elements of a page at a path (all of them at the last step)."""
    here = [root]
    for name, mark in path:
        here = [x for e in here for x in e.children if isinstance(x, Element) and x.name == name and x.mark == mark]
    return here


def text_of(*elements: Element, constants: frozenset = frozenset()) -> str:
    """The blocks of elements, joined, without boilerplate and without the host's constant blocks, unless such a block holds most
    of the elements' text."""
    blocks: list[list[str]] = [[]]
    size = sum(e.size for e in elements)

    def dropped(x: Element) -> bool:
        return x.boilerplate or bool(constants and x.digest and 2 * x.size <= size and name_of(x) in constants)

    def walk(e: Element) -> None:
        for x in e.children:
            if isinstance(x, str):
                blocks[-1].append(x)
            elif dropped(x):
                if x.name not in INLINE:
                    blocks.append([])
            elif x.name in INLINE:
                walk(x)
            else:
                blocks.append([])
                walk(x)
                blocks.append([])

    for e in elements:
        blocks.append([])
        walk(e)
    return " ".join(filter(None, (words("".join(b)) for b in blocks)))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def main_text(page: str, known: dict | None) -> str:
    """The main text of a page, given what its host's wrapper says."""
    root = parse(page)
    known = known or {"path": [], "constants": []}
    constants = frozenset(known["constants"])
    if known["path"] and (text := text_of(*found(root, known["path"]), constants=constants)):
        return text
    own = found(root, region(folded(root)))
    return text_of(*(own or [root]), constants=constants)


def _fold(held: dict[str, list], host: str, wrapper: list) -> None:
    held[host] = joined(held[host], wrapper) if host in held else wrapper


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of pages (url, html)."""
    prepare(pages.sparkSession)

    def per_task(batches):
        deep()
        held: dict[str, list] = {}
        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if page:
                    _fold(held, host_of(url), folded(parse(page.decode())))
            if len(held) > 20_000:
                yield batch_of(held)
                held = {}
        yield batch_of(held)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(packed, held.values()), pa.string())], names=["host", "wrapper"])

    def per_host(key, table):
        deep()
        held: dict[str, list] = {}
        for x in sorted(table.column("wrapper").to_pylist()):
            _fold(held, key[0].as_py(), unpacked(x))
        return pa.Table.from_batches([batch_of(held)])

    partial = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(per_task, "host string, wrapper string")
    # There is one wrapper a task and host; with many tasks they are folded in two steps.
    some = partial.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS))).applyInArrow(per_host, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(per_host, "host string, wrapper string")


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    spark = prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = cut(wrappers(pages).select("host", _regions()("wrapper").alias("region")))
    small = (scalar(known, "coalesce(sum(octet_length(host) + octet_length(region)), 0)") or 0) <= broadcast_bytes
    if small:
        regions = spark.sparkContext.broadcast({r["host"]: json.loads(r["region"]) for r in known.collect()})
    else:
        rows = rows.withColumn("host", _hosts()("url")).join(known, "host", "left").select("page_id", "url", "html", "region")

    def run(batches):
        deep()
        for batch in batches:
            urls, texts = batch.column(1).to_pylist(), []
            paths = [regions.value.get(host_of(u)) for u in urls] if small else [json.loads(x) if x else None for x in batch.column(3).to_pylist()]
            for page, path in zip(utf8(batch.column(2)), paths, strict=True):
                texts.append(main_text(page.decode(), path) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)


def _regions():
    @F.pandas_udf("string")
    def regions(x: pd.Series) -> pd.Series:
        deep()
        return x.map(lambda w: json.dumps(rules(unpacked(w))))

    return regions


def _hosts():
    @F.pandas_udf("string")
    def hosts(x: pd.Series) -> pd.Series:
        return x.map(host_of)

    return hosts


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
