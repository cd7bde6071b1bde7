"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text at block-level tags. A logistic classifier gives each
block a log-odds of being content, which becomes its terminal capacity: a block that looks
like content is tied to the source, one that does not to the sink. Smoothness edges tie
blocks that follow each other on the page, the stronger the nearer they are in the element
tree, and blocks that follow each other within the same container. Maximum flow separates
the page at the least cost; blocks on the source side are content.

The classifier is trained on the pages themselves: blocks inside article or main elements
are examples of content, blocks inside elements for navigation, forms and the like, or with a
class of just such a name, are examples of the rest, and what is learned is how the text of
either looks (links, length, punctuation, kind of block, class names). It is fitted on the blocks of
``sample_pages`` pages, those with the smallest hashes of their id, ``sample_blocks`` blocks
at most. Telling elements add a fixed log-odds, class names take one away, much less if
the word is only a part of the name (``has-sidebar``). An article or main inside an element
with such a name starts afresh. Text and neighbours together can overrule any of it.

Scripts, styles, comments of the markup, templates, form controls and the head never become
blocks. Tags that are not closed end where the next one of their kind or their parent does.
Null or empty pages have empty text; a page with no tags is one block. Repeated rows and null ids and URLs are kept. Only
the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import kind, logistic, narrow

SAMPLE_PAGES = 2_000
SAMPLE_BLOCKS = 60_000
STRUCTURE = 6.0  # log-odds that a telling element adds; under what the classifier (5) and the edges of a block (3) reach
NAMED = 6.0  # log-odds that a class name takes away, by how telling it is; can be overruled likewise
PART = 0.25  # how telling a word is that is only a part of a class name
NEAR = 1.0  # smoothness between neighbours in one parent; less by the distance in the tree
CONTAINER = 0.5  # smoothness between neighbours in one container

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "select", "button", "canvas", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
    "math", "mi", "mn", "mo", "mrow", "ms", "mtext", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "semantics",
}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "nav", "aside", "header", "footer", "body", "form", "blockquote"}
_GOOD_TAGS = {"article", "main"}
_BAD_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu"}
_BAD_NAMES = set(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification overlay pagination pager popup promo promotion related reply replies respond search share sharing sidebar sidebars signup "
    "social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets complementary contentinfo header".split()
)
_GOOD_NAMES = set("article articlebody body content entry main post postcontent story text".split())
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Element:
    name: str
    parent: int
    depth: int
    good: bool = False  # it or an ancestor holds content by its name
    bad: bool = False  # the same for elements that hold something else
    named: float = 0.0  # how telling a class name is that it or an ancestor has for something else
    names: float = 0.0  # good minus bad words among class names, it and its ancestors


@dataclass
class Block:
    parent: int
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _named(attributes: str) -> tuple[float, float]:
    bad, good = 0.0, 0.0
    for m in _NAMES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        words = [w.lower() for part in re.split(r"[^A-Za-z]+", value) for w in _WORD.findall(part)]
        if any(w in _BAD_NAMES for w in value.lower().split()):
            bad = 1.0
        elif any(w in _BAD_NAMES for w in words):
            bad = max(bad, PART)
        good += any(w in _GOOD_NAMES for w in words)
    return bad, good


def blocks(page: str | None) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order, and the elements they stand in (a block's parent is an index)."""
    elements, stack, out = [Element("", -1, 0)], [0], []
    current: Block | None = None
    page, at, links = page or "", 0, 0

    def text(raw: str):
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            block_parent = next(i for i in reversed(stack) if elements[i].name not in _INLINE)
            current = Block(block_parent, elements[block_parent].name)
        raw = entities.unescape(raw) if "&" in raw else raw
        current.parts.append(raw)
        if links:
            current.linked += len(raw.strip())

    def end_block():
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                out.append(current)
            current = None

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        inline = name in _INLINE
        if not inline:
            end_block()
        if m[1]:
            deep = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == name), 0)
            if deep:
                links -= sum(elements[i].name == "a" for i in stack[deep:])
                del stack[deep:]
            continue
        if name in _RAW and not (m[3] or "").rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in _VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):  # tags that end where the next of their kind begins
            open_name = elements[stack[k]].name
            if open_name in _CLOSES.get(name, ()) or (open_name == "p" and not inline):
                links -= sum(elements[i].name == "a" for i in stack[k:])
                del stack[k:]
                break
            if open_name in _SCOPE:
                break
        parent = elements[stack[-1]]
        bad_name, good_name = _named(m[3]) if m[3] else (0.0, 0.0)
        if name in ("body", "html"):
            bad_name = 0.0
        above, before = (0.0, 0.0) if name in _GOOD_TAGS else (parent.named, parent.names)  # an article starts afresh
        bad = parent.bad or name in _BAD_TAGS or name == "header" and not parent.good
        elements.append(Element(name, stack[-1], parent.depth + 1, parent.good or name in _GOOD_TAGS, bad, max(above, bad_name), before + good_name - bad_name))
        stack.append(len(elements) - 1)
        links += name == "a"
        if name == "head":
            close = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
            at = (close.start() if close else at)
    end_block()
    return out, elements


_COLUMNS = ("links", "words", "chars", "stop", "marks", "heading", "item", "paragraph", "names", "place")


def looks(found: list[Block], elements: list[Element]) -> np.ndarray:
    """What the classifier sees of each block: how its text looks, not which element it is in."""
    rows = []
    for i, b in enumerate(found):
        n, words = len(b.text), b.text.count(" ") + 1
        rows.append((
            min(1.0, b.linked / n), min(np.log1p(words), 6.0), n / words / 10, b.text[-1] in ".!?…:\"”", min(1.0, 20 * sum(b.text.count(c) for c in ".,;") / n),
            b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "dt", "dd", "td", "th"), b.tag == "p", np.clip(elements[b.parent].names, -2, 2),
            min(i, len(found) - 1 - i) / len(found),
        ))
    return np.array(rows, float).reshape(len(found), len(_COLUMNS))


def structure(found: list[Block], elements: list[Element]) -> np.ndarray:
    """1 in an article, -1 in an element for something else (also inside an article), 0 unknown."""
    return np.array([-1 if elements[b.parent].bad else int(elements[b.parent].good) for b in found])


def examples(found: list[Block], elements: list[Element]) -> np.ndarray:
    """As ``structure``, with elements of just such a name as something else, and those with a part of one unknown."""
    named = np.array([elements[b.parent].named for b in found])
    return np.where(named >= 1, -1, np.where((named > 0) & (structure(found, elements) > 0), 0, structure(found, elements)))


def _distance(a: int, b: int, elements: list[Element]) -> int:
    """Steps from one element to the other over their nearest common ancestor."""
    steps = 0
    while a != b:
        if elements[a].depth < elements[b].depth:
            a, b = b, a
        a, steps = elements[a].parent, steps + 1
    return steps


def smoothness(found: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """``(block, block, capacity)`` edges between blocks that are near on the page or in the tree."""
    edges = []
    container = lambda b: elements[b.parent].parent if b.tag in ("p", "li", "dt", "dd", "td", "th") or b.tag[1:].isdigit() else b.parent
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / (1 + max(0, _distance(found[i - 1].parent, b.parent, elements) - 2))))
        home = container(b)
        if last.get(home, i - 1) != i - 1:
            edges.append((last[home], i, CONTAINER))
        last[home] = i
    return edges


def _labels(room: list[float], left: list[dict[int, float]], tiny: float) -> list[int]:
    """1 + edges from each node to the nearest one with room, over edges that can still take flow; more than the nodes if there is no way."""
    far = len(room) + 1
    label = [1 if r > tiny else far for r in room]
    queue = deque(i for i, x in enumerate(label) if x == 1)
    while queue:
        j = queue.popleft()
        for i in left[j]:
            if label[i] == far and left[i][j] > tiny:
                label[i] = label[j] + 1
                queue.append(i)
    return label


def min_cut(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes stay with the source: terminal capacities are the log-odds, flow is pushed in bulk from node to node.

    Capacities are the same in both directions, so the flow may run from the nodes with negative
    odds to those with positive ones. The node furthest from any with room left goes first and
    hands its whole surplus on, which gathers on the way. A node that has been moved away some times
    (more in each round) waits for the next round, in which distances are taken anew and those
    without any way drop out. Kept are the nodes that still have a way to room.
    """
    n = len(odds)
    if not (odds > 0).any():
        return np.zeros(n, bool)
    if not (odds < 0).any():
        return np.ones(n, bool)
    left: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        left[a][b] = left[a].get(b, 0.0) + c
        left[b][a] = left[b].get(a, 0.0) + c
    surplus, room = np.maximum(-odds, 0).tolist(), np.maximum(odds, 0).tolist()
    tiny, turns = 1e-12, 4
    while True:
        label, moved = _labels(room, left, tiny), [0] * n
        waiting: list[list[int]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if surplus[i] > tiny and label[i] <= n:
                waiting[label[i]].append(i)
        top, started = n, False
        while top:
            if not waiting[top]:
                top -= 1
                continue
            i = waiting[top].pop()
            if label[i] != top or surplus[i] <= tiny:
                continue
            started = True
            if room[i] > tiny:
                flow = min(surplus[i], room[i])
                surplus[i] -= flow
                room[i] -= flow
            own = left[i]
            for j, c in own.items():
                if surplus[i] <= tiny:
                    break
                if c > tiny and label[j] == top - 1:
                    flow = min(surplus[i], c)
                    if surplus[j] <= tiny:
                        waiting[top - 1].append(j)
                    surplus[i] -= flow
                    surplus[j] += flow
                    own[j] = c - flow
                    left[j][i] += flow
            if surplus[i] > tiny:
                label[i] = min((label[j] + 1 for j, c in own.items() if c > tiny), default=n + 1)
                moved[i] += 1
                if label[i] <= n and moved[i] < turns:
                    waiting[label[i]].append(i)
                    top = label[i]
        turns *= 2
        if not started:
            return np.array(_labels(room, left, tiny)) <= n


def main_text(page: str | None, weights: np.ndarray) -> str:
    found, elements = blocks(page)
    if not found:
        return ""
    odds = np.clip(looks(found, elements) @ weights[:-1] + weights[-1], -5, 5) + STRUCTURE * structure(found, elements)
    for i, b in enumerate(found):
        if elements[b.parent].named:
            # a name inside an article takes back what the article gives
            odds[i] -= elements[b.parent].named * (NAMED + STRUCTURE * (elements[b.parent].good and not elements[b.parent].bad))
    return " ".join(b.text for b, content in zip(found, min_cut(odds, smoothness(found, elements)), strict=True) if content)


#: Used where no page of the sample has telling elements: text without links and with full stops is content.
UNTRAINED = np.array([-5.0, 1.0, 0.0, 1.0, 1.0, 0.5, -1.0, 1.0, 1.0, 0.0, -2.5])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS) -> np.ndarray:
    """Weights of the classifier, learned from blocks whose elements tell what they are."""
    base = narrow(pages, id=id_col, html=html_col)
    ids = base.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_pages)  # bounded

    def run(batches):
        for b in batches:
            for page in b.column("html"):
                found, elements = blocks(page.as_py())
                side = examples(found, elements)
                known = side != 0
                if known.any():
                    x = looks(found, elements)[known]
                    yield pa.RecordBatch.from_pydict({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "y": pa.array((side[known] > 0).astype(np.float64))})

    found = base.join(F.broadcast(ids), base["id"].eqNullSafe(ids["id"]), "left_semi").select("html").mapInArrow(run, "x array<double>, y double")
    rows = found.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample_blocks).toArrow()  # the same rows, however the files are laid out
    y = np.asarray(rows.column("y")) if rows.num_rows else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return UNTRAINED
    return logistic(np.array(rows.column("x").to_pylist()), y)


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **sampling) -> DataFrame:
    """``(id, url, text, n_chars)`` for every row."""
    weights = train(pages, id_col, html_col, **sampling) if weights is None else weights
    base = narrow(pages, id=id_col, url=url_col, html=html_col)

    def run(batches):
        for b in batches:
            texts = [main_text(page.as_py(), weights) for page in b.column("html")]
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    out = base.mapInArrow(run, f"id {kind(base)}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
