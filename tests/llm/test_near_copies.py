"""The near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random

import pytest

import corpus_pipeline as pipe


def sets_of(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_keep(rows):
    """Ids that stay, by comparing every pair."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if min(len(x), len(y)) < 0.8 * max(len(x), len(y)) - 1e-9:
                continue
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return sorted((rows[i][0] for i in range(len(rows)) if root[i] == i), key=str)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id for r in pipe.near_duplicates(spark, docs, "").collect()), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id for r in pipe.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == plain_keep([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("changes", [1, 3, 5])
def test_edited_copies(spark, changes):
    rng, rows = random.Random(changes), []
    for base in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for copy in range(4):
            own = list(words)
            for _ in range(changes * copy):
                own[rng.randrange(150)] = f"x{rng.randrange(5000)}"
            rows.append((base * 10 + copy, " ".join(own)))
    assert kept(spark, rows) == plain_keep(rows)


def test_odd_rows(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, None), (4, ""), (5, " \n"), (None, "a b"), (6, "c d e f g h"), (6, "c d e f g h"), (None, "z"), (None, "z")]
    assert [str(x) for x in kept(spark, rows)] == ["1", "3", "6", "None"]
    assert kept(spark, [(1, "only one")]) == [1]
    assert pipe.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3), (2, "A b", 4, 5, 6)], "doc_id long, text string, node long, k long, no_id long")
    assert [tuple(r) for r in pipe.near_duplicates(spark, docs, "").collect()] == [(1, "a b", 1, 2, 3)]


def test_texts_of_a_template_make_few_candidates(spark, monkeypatch):
    from panelcast.llm import near_copies as N

    rng, texts, seen = random.Random(1), [], []
    template = [f"t{i}" for i in range(140)]
    for i in range(800):
        texts.append((i, " ".join(template + [f"w{rng.randrange(100_000)}" for _ in range(60)])))
    inner = N._linked

    def counted(pairs, sets):
        seen.append(pairs.distinct().count())
        return inner(pairs, sets)

    monkeypatch.setattr(N, "_linked", counted)
    assert kept(spark, texts) == sorted(range(800), key=str)
    assert sum(seen) <= 3 * 800, seen


def test_bound_of_the_parities():
    import numpy as np

    from panelcast.llm import near_copies as N

    rng = random.Random(2)
    for _ in range(100):
        pool = [rng.randrange(1 << 64) for _ in range(400)]
        a, b = (np.array(sorted(rng.sample(pool, rng.randint(1, 300))), np.uint64) for _ in range(2))
        bits = [np.frombuffer(N.parities(x), np.uint64) for x in (a, b)]
        assert len(np.intersect1d(a, b)) <= N.most_shared(len(a), len(b), *bits)


def test_few_sets_are_held_at_once(spark):
    import pyarrow as pa

    from panelcast.llm import near_copies as N

    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(1000)]
    whole = pa.RecordBatch.from_pydict({"node": pa.array(range(1000)), "text": pa.array(texts)})
    sets = list(N._sets([whole]))
    assert max(b.num_rows for b in sets) <= 256 and sum(b.num_rows for b in sets) == 1000
    found = pa.array([x for b in sets for x in b.column("found").to_pylist()])
    pairs = pa.RecordBatch.from_pydict({"a": whole.column("node"), "b": whole.column("node"), "set_a": found, "set_b": found})
    alike = list(N._verify([pairs]))
    assert max(b.num_rows for b in alike) <= 256 and sum(b.num_rows for b in alike) == 1000
    kept(spark, [(1, "only one")])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024


def test_recurring_shingles_are_counted_in_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from panelcast.llm import near_copies as N

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b c d e f"] * 3 + ["own words of one text", None])})
    for stretch, want in ((N.STRETCH, 6), (4, 4)):  # two shingles, three times; of a stretch of two texts both, the third alone
        monkeypatch.setattr(N, "STRETCH", stretch)
        got = list(N._recurring([batch]))
        assert sum(np.asarray(b.column("n")).sum() for b in got) == want
