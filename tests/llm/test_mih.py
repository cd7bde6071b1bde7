import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import mih

QUERY = "id % 20 = 0"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 40), st.integers(1, 4), st.integers(1, 200))
def test_probing_finds_every_code_in_the_radius(seed, radius, m, n):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 256, (n, m)).astype(np.uint8)
    one = rng.integers(0, 256, m).astype(np.uint8)
    got = mih.Index(codes).within(one, radius)
    assert got.tolist() == np.flatnonzero(mih.hamming(codes, one) <= radius).tolist()


def exact(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            scores = sorted(((-float(w @ v), j) for j, w in good if j != i))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 2.0]), (20, [0.5, 0.5]), (40, None),
            (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in mih.search(df, QUERY, query_rows=1, block_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == exact([r for r in rows if r[0] != 8])
    assert mih.search(df.limit(0), QUERY).count() == 0
    assert mih.search(df.where("vec_id = 0"), QUERY).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = exact(rows)
    got = {}
    for r in mih.search(df, QUERY).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9
    by = dict(rows)
    for q, v in got.items():
        assert [s for _, s in v] == sorted((s for _, s in v), reverse=True)
        assert all(abs(s - np.dot(np.array(by[q], float), np.array(by[j], float))) < 1e-12 for j, s in v)
