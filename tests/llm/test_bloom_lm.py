import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import bloom_lm as B


def plain(rows):
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in cut if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in cut]


def same(got, want):
    key = lambda r: tuple(map(str, r[:5]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


ROWS = [(1, "A b a b c"), (2, None), (3, ""), (4, "a b\x0b\x1cc É é"), (None, "a b a b"), (5, "zz " * 20_000), (6, "b a"), (6, "b a"), (7, "a q"), (8, "never seen"), (9, "a b"), (10, "q"), (11, "x" * 100 + " a")]


@pytest.mark.parametrize("options", [{}, {"hot_tokens": 2, "segment_tokens": 50, "filter_bytes": 200}, {"hot_tokens": 0}])
def test_base_scores(spark, options):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ROWS], "doc_id long, text string, score double")
    got = B.score(docs, **options).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], plain(ROWS))
    assert all(r.score < 0 for r in got)


def test_groups_of_the_filter_do_not_change_the_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.score for r in B.score(docs, segment_tokens=5_000).collect()}
    many = {r.doc_id: r.score for r in B.score(docs, segment_tokens=5_000, filter_bytes=30_000).collect()}
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 * abs(one[i]) for i in one)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = B.score(docs).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], plain([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # pairs tell more than single tokens


def test_filter_reads_counts_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    counts = rng.geometric(0.4, len(keys))
    table = B.Filter(0, [len(B._built(keys, counts))], B._built(keys, counts), 1)
    got = table.level(keys)
    assert (got >= B.levels(counts)).all() and (got == B.levels(counts)).mean() > 0.95
    assert (table.level(rng.integers(0, 2**63, 50_000).astype(np.uint64)) > 0).mean() < 0.03
    assert B.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.score(docs).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = B.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_segments_are_packed_one_after_another():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**64, 4000, np.uint64).repeat(3))
    got = list(B._by_segment(keys, None, 7, True))
    assert [b.num_rows for b in got] == [1] * 7  # one batch of all segments is held whole on both sides
    for b in got:
        k, n = (np.frombuffer(b.column(c)[0].as_py(), t) for c, t in (("keys", "<u8"), ("counts", "<i8")))
        want = keys[B._segment(keys, 7) == b.column("seg")[0].as_py()]
        assert k.tolist() == np.unique(want).tolist() and n.sum() == len(want)


def test_building_a_segment_takes_little_beside_its_keys():
    import tracemalloc

    keys = np.random.default_rng(3).integers(0, 2**64, 1 << 19, np.uint64)
    counts = np.ones(len(keys), np.int64)
    tracemalloc.start()
    B._built(keys, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * keys.nbytes


def test_an_earlier_filter_does_not_stay_in_a_worker():
    B._HELD[:] = ["value", "filter"]
    B._let_go()
    assert B._HELD == [None, None]


def test_words_of_several_texts_are_numbered_together():
    rng = np.random.default_rng(5)
    letters = list("abAB é\t\n\x0b\x0c\r\x1c\x85 日😀")
    texts = [None, "", " ", *("".join(rng.choice(letters, n)) for n in rng.integers(0, 40, 1500)), "x" * 50]
    whole = pa.RecordBatch.from_pydict({"text": pa.array(["before", *texts, "after"], pa.string())})
    seen, slices = 0, list(B._texts(whole.slice(1, len(texts))))
    for part, words, at, sizes in slices:
        want = [(t or "").encode().lower().split() for t in texts[seen : seen + part.num_rows]]
        assert [words[i] for i in at] == [w for ws in want for w in ws] and sizes.tolist() == list(map(len, want))
        assert len(set(words)) == len(words)  # each is hashed once
        seen += part.num_rows
    assert seen == len(texts) and len(slices) > 1


def test_few_bytes_are_handled_at_once(monkeypatch):
    monkeypatch.setattr(B, "BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 60, None, "b" * 60, "c " * 500, "", "d"], pa.string())})
    assert [part.num_rows for part, *_ in B._texts(batch)] == [2, 1, 1, 2]


def test_a_pair_is_probed_once_a_slice():
    batch = pa.RecordBatch.from_pydict({"text": ["a b a b", "a b", None] * 50, "single": pa.nulls(150, pa.binary()), "pair": pa.nulls(150, pa.binary())})
    asked = []

    class Probed:
        def level(self, keys):
            asked.append(len(keys))
            return np.arange(len(keys), dtype=np.uint8)

    ((part, words, at, sizes),) = B._texts(batch)
    place, pair, first, second, singles, pairs = B._levels_of(part, words, at, sizes, Probed())
    assert asked == [3, 5]  # a, b and the end; start-a, a-b, b-a, b-end, start-end
    names = [*words, "end", "start"]
    got = [(names[first[p]], names[second[p]]) for p in pair[:9]]
    assert got == [("start", b"a"), (b"a", b"b"), (b"b", b"a"), (b"a", b"b"), (b"b", "end"), ("start", b"a"), (b"a", b"b"), (b"b", "end"), ("start", "end")]
    # a later group of the filter reads none of these: the levels of the earlier one stay
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    kept = {n: pa.array([x[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for n, x in (("single", singles[place]), ("pair", pairs[pair]))}
    later = pa.RecordBatch.from_pydict({"text": batch.column("text"), **kept})
    Probed.level = lambda self, keys: np.zeros(len(keys), np.uint8)
    *_, singles_later, pairs_later = B._levels_of(later, words, at, sizes, Probed())
    assert singles_later.tolist() == singles.tolist() and pairs_later.tolist() == pairs.tolist()
