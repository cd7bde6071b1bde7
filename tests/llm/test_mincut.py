import html
import itertools
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import mincut as M

WEIGHTS = M.UNTRAINED


def cost(labels, odds, edges):
    wrong = sum(abs(o) for x, o in zip(labels, odds, strict=True) if x != (o > 0))
    return wrong + sum(c for a, b, c in edges if labels[a] != labels[b])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(1, 4)), max_size=12))
def test_cut_is_minimal(odds, edges):
    odds = np.array(odds, float)
    edges = [(a % len(odds), b % len(odds), float(c)) for a, b, c in edges if a % len(odds) != b % len(odds)]
    got = M.min_cut(odds, edges)
    best = min(cost(x, odds, edges) for x in itertools.product([False, True], repeat=len(odds)))
    assert abs(cost(got, odds, edges) - best) < 1e-9


def _chain_cost(odds, weight):
    """Least cost of a chain of nodes, from left to right."""
    kept = dropped = 0.0
    for o in odds.tolist():
        kept, dropped = min(kept, dropped + weight) + max(-o, 0), min(dropped, kept + weight) + max(o, 0)
    return min(kept, dropped)


def test_pages_of_many_blocks():
    n = 50_000
    rng = np.random.default_rng(1)
    chain = [(i - 1, i, 1.0) for i in range(1, n)]
    wide = chain + [(i - 5, i, 0.5) for i in range(5, n, 3)]
    alternating = np.where(np.arange(n) % 2 == 0, 3.0, -3.5)
    runs = np.where(np.arange(n) // 5_000 % 2 == 0, 0.001, -0.0007)
    for odds in (alternating, runs, rng.normal(0, 3, n), np.r_[np.full(n - 100, 11.0), np.full(100, -11.0)]):
        began = time.process_time()
        assert abs(cost(M.min_cut(odds, chain), odds, chain) - _chain_cost(odds, 1.0)) < 1e-6
        M.min_cut(odds, wide)
        assert time.process_time() - began < 60
    body = "".join(f"<tr><td>cell {i}, with words enough to read.</td><td><a href='/'>{i}</a></td></tr>" for i in range(n // 2))
    began = time.process_time()
    assert M.main_text(f"<article><table>{body}</table></article><footer>f</footer>", WEIGHTS).count("cell") == n // 2
    assert time.process_time() - began < 60


def test_formulas_and_drawings_of_an_article_are_text():
    page = "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><svg><style>a{}</style><text>axis</text></svg><object><p>Fallback.</p></object></article><footer>f</footer>"
    assert M.main_text(page, WEIGHTS) == "Where x=2 holds. axis Fallback."


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div id="cookie-notice">We use cookies.</div><!-- note --><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>face<br>text.<p>Second&nbsp;one, with a <a href="x>y">link</a>.
<aside>Related things</aside><div class="ad">Buy!</div><ul><li>item one<li>item two</ul><section class="comments"><p>Nice post, thanks for it.</p></section></article>
<form><label>Mail</label><input><button>Send</button></form><div class="sidebar-left"><p>Other stories here.</p></div><footer>&copy; us</footer>"""


def test_page():
    assert M.main_text(PAGE, WEIGHTS) == "Title & more First boldface text. Second one, with a link. item one item two"


def test_odd_pages():
    assert M.main_text(None, WEIGHTS) == "" and M.main_text("", WEIGHTS) == "" and M.main_text("<nav>x</nav>", WEIGHTS) == ""
    assert M.main_text("<article><p>un<b>closed &lt; <p>and &#233; 5 < 6", WEIGHTS) == "unclosed < and é 5 < 6"
    long = "word " * 200_000
    assert M.main_text(f"<article><p>{long}</p></article>", WEIGHTS) == long.strip()
    assert M.main_text("<article>" + "<div>" * 3000 + "deep text." + "</div>" * 3000 + "</article>", WEIGHTS) == "deep text."
    many = "".join(f"<p>Block {i} of the article.</p>" for i in range(2000))
    assert M.main_text(f"<nav><a>x</a></nav><article>{many}</article><footer>f</footer>", WEIGHTS).count("Block") == 2000


def test_no_telling_elements():
    body = "".join(f"<p>This is sentence number {i}, long enough to be read as running text, with commas.</p>" for i in range(6))
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8))
    assert M.main_text(f"<div><ul>{menu}</ul></div><div>{body}<p>Short.</p></div><div><ul>{menu}</ul></div>", WEIGHTS).endswith("commas. Short.")


def test_rows(spark):
    rows = [(1, "u", PAGE, 3), (None, None, PAGE, 4), (2, "v", None, 5), (1, "u", PAGE, 3), (3, "w", "", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = M.extract(pages).collect()
    assert sorted(str((r.page_id, r.url)) for r in got) == sorted(str((r[0], r[1])) for r in rows)
    assert all(r.n_chars == len(r.text) and bool(r.text) == (r.page_id not in (2, 3)) for r in got)
    assert M.extract(pages.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in M.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        cut = re.sub(r"</?(p|h1)>", "\0", inner[1] if inner else "").replace("<br>", " ")
        want = " ".join(x for x in (" ".join(html.unescape(p).split()) for p in re.sub(r"<[^>]*>", "", cut).split("\0")) if x)
        assert got[r.page_id] == want
