import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import bpe_tree

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SMALL = bpe_tree.TreeCodec(RANKS, P.PATTERN, leaf=7, window=2)
TEXT = st.text(st.sampled_from(list("ab zé'st1 \n\t\u00a0\u3000世.,!") + ["🙂"]), max_size=120)


def plain(text):
    return SMALL._bpe.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_small_pieces_join_to_the_whole(text):
    ids = SMALL.encode(text)
    assert ids.tolist() == plain(text)
    assert SMALL.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, " " * 3000, "ab " * 4000, "\n" * 50 + "x", "世" * 3000, "don't " * 2000, "!?" * 3000 + "'s"])
def test_long_runs(text):
    whole = bpe_tree.TreeCodec(RANKS, P.PATTERN, leaf=64, window=8)
    assert whole.encode(text).tolist() == plain(text)
    assert whole.decode(whole.encode(text)) == text.encode()


def test_rows(spark):
    rows = [(1, "one two", 7), (None, "three", 8), (2, None, 9), (2, "", 9), (1, "one two", 7), (3, "x y " * 3000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(bpe_tree.digests(docs, RANKS, P.PATTERN).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = plain(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=str)
    back = bpe_tree.decode(bpe_tree.encode(docs, RANKS, P.PATTERN, verify=True), RANKS, P.PATTERN).collect()
    assert sorted((str(r[0]), bytes(r[1])) for r in back) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    assert bpe_tree.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_same_as_the_library_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe_tree.encode(docs, RANKS, P.PATTERN).collect()}
    assert all(got[r.doc_id] == plain(r.text or "") for r in docs.collect())
    assert isinstance(SMALL._bpe, tiktoken.Encoding)
