import re

import pytest

from panelcast.llm import decontam as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = cut(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = cut(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                found = grams.get(tuple(w[a : a + k]))
                if found:
                    hit |= set(range(a, a + k))
                    names |= found
        out.append((d, len(w), len(hit), len(names), bool(hit)))
    return sorted(out, key=str)


LONG = "One two three, four five SIX seven eight nine ten eleven twelve."
ITEMS = [(1, LONG), (2, "short é item"), (3, None), (4, "..."), (5, "one two three four five six seven eight nine ten"), (10, "short É item"), (1, LONG)]
DOCS = [(1, f"intro {LONG} outro"), (2, None), (3, ""), (4, "a Short é item; short é item short é item"), (None, LONG), (1, f"intro {LONG} outro"), (1, "another text"), (6, "one two three four five six seven eight nine"),
        (7, "pad " * 30_000 + LONG), (8, LONG + " " + LONG), (9, "shorté item short éitem")]


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, items string"), spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, gram int"))


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_rows(tables, limit):
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in D.flags(*tables, broadcast_bytes=limit).collect()), key=str)
    assert got == plain(DOCS, ITEMS)


def test_empty_tables(tables):
    docs, items = tables
    assert D.flags(docs.limit(0), items).count() == 0
    rows = D.flags(docs, items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.contaminated for r in rows)


def test_documents_go(tables):
    docs, items = tables
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) + str(r.text) for r in kept.collect()) == sorted(str(i) + str(t) for i, t in DOCS if not plain([(i, t)], ITEMS)[0][-1])


def test_spans_go(tables):
    docs, items = tables
    got = {(r.doc_id, r.text) for r in D.decontaminate(docs, items, "spans").collect()}
    assert (1, "intro. outro") in got and (2, None) in got and (3, "") in got and (1, "another text") in got and (9, "shorté item short éitem") in got
    assert (8, ".") in got and (None, ".") in got and (4, "a") in got
    assert D.decontaminate(docs, items, "spans").count() == len(DOCS)


def test_no_python_in_the_plan(spark, tables):
    plan = D.flags(*tables)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
