import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import piece_agenda as A

PATH = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="ab e▁\n<s>/", max_size=80)), max_size=6))
def test_ids_are_those_of_the_library(texts):
    assert [A.codec(PATH).encode(t) for t in texts] == [PLAIN.encode(t, add_eos=True) for t in texts]


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a\0b", "▁x▁▁y", "<s>a</s>", "👍🏽 ok", "a" * 5000, " " * 5000, "日本語" * 3000, "unbroken" * 2000])
def test_whole_text_agenda_equals_stretches(text):
    c = A.PieceCodec(PATH)
    normal = c.library.normalize(text)
    # one heap over the whole text, the list over the whole text and the stretches give the same
    assert c._as_ids(c._long(normal)) == c.encode(text, end=False) == PLAIN.encode(text)
    if len(normal) < 3000:
        assert c._as_ids(c._short(normal)) == c.encode(text, end=False)


def test_kept_table_is_bounded():
    made = []
    kept = A._Kept(lambda s: made.append(s) or [len(s)], 2)
    assert [kept[s] for s in ("a", "bb", "ccc", "a", "dddd", "a")] == [(1,), (2,), (3,), (1,), (4,), (1,)]
    assert len(kept) <= 2 and made == ["a", "bb", "ccc", "dddd"]


def test_rows(spark):
    rows = [(1, "Hello  world", 1), (1, "Hello  world", 1), (None, "x", 2), (2, None, 3), (3, "", 4), (4, "long text " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted((tuple(r) for r in A.digests(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = PLAIN.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(PLAIN.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = A.decode(A.encode(docs, PATH), PATH).collect()
    assert sorted((r.text for r in back)) == sorted((t or "") for _, t, _ in rows)
    assert A.digests(docs.limit(0), PATH).collect() == []


def test_a_difference_is_an_error():
    c = A.PieceCodec(PATH)
    c._kept["▁wrong"] = (5,)
    with pytest.raises(ValueError, match="rows \\[1\\]"):
        c.checked(["right", "wrong"])


def test_new_stretches_are_encoded_together(monkeypatch):
    c, made = A.PieceCodec(PATH), []
    one = c.agenda
    monkeypatch.setattr(c, "agenda", lambda s: made.append(s) or one(s))
    c._kept._make = c.agenda
    texts = ["Erthtionor çenou onwheaat, einä.", "", "x" * 60, "ab\U0010fff0c 12.5% (tzener) ▁▁émentvique", "日本語の言葉 aaaaaaaa", "Erthtionor again"]
    assert c.checked(texts) == [PLAIN.encode(t, add_eos=True) for t in texts]
    assert all(len(s) > A.SHORT or "\U0010fff0" in s or not s.isascii() for s in made), made  # only long or unknown ones alone


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aeinrstouh▁é0.", min_size=1, max_size=A.SHORT), min_size=1, max_size=8))
def test_together_equals_one_by_one(stretches):
    c = A.codec(PATH)
    assert c.together(stretches) == [tuple(c.agenda(s)) for s in stretches]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é▁.,1\n日😀ñ·", max_size=30), max_size=6))
def test_stretches_of_several_texts_are_numbered_together(texts):
    c = A.codec(PATH)
    normal = [c.library.normalize(t) for t in texts]
    distinct, place, bounds = A._numbered([t.encode() for t in normal], c._mark)
    assert len(set(distinct)) == len(distinct)  # each is looked up once
    got = [[distinct[i] for i in place[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert list(map("".join, got)) == normal
    for t, stretches in zip(normal, got, strict=True):
        if "日" not in t and "😀" not in t:  # others of three bytes and more stay with their neighbours
            assert stretches == [p for s in c._stretches(t) for p in c._kept._parts(s)]
    assert c.checked(texts) == [PLAIN.encode(t, add_eos=True) for t in texts]


def test_a_stretch_is_looked_up_once_a_batch():
    c, asked = A.PieceCodec(PATH), []

    class Asked(A._Kept):
        def get(self, stretch):
            asked.append(stretch)
            return super().get(stretch)

    c._kept = Asked(c.agenda, 100, c._kept._parts)
    texts = ["one two, two", "two one two"] * 3
    assert c.checked(texts) == [PLAIN.encode(t, add_eos=True) for t in texts]
    assert asked and len(asked) == len(set(asked))


def test_pairs_are_found_by_hash():
    c = A.codec(PATH)
    pieces = [p for p in list(c._cost)[:3000] if len(p) > 1]
    assert c.together(pieces) == [tuple(c.agenda(p)) for p in pieces]
    assert c.together(["▁"]) == [tuple(c.agenda("▁"))]
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 3000, (2000, 2))
    known = {k: m for k, m in zip(c._pairs.tolist(), c._made.tolist(), strict=True) if k >= 0}
    n = len(c._numbers) - 1
    assert c._pair(*pairs.T).tolist() == [known.get(int(a) * n + int(b), -1) for a, b in pairs]


def test_few_bytes_are_encoded_at_once(monkeypatch):
    monkeypatch.setattr(A, "BYTES", 100)
    texts = ["a" * 60, None, "b" * 60, "c" * 500, "", "d", "é" * 60]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": pa.array(texts, pa.string())})
    assert [p.column("id").to_pylist() for p in A._parts([batch])] == [[0, 1], [2], [3], [4, 5], [6]]
    monkeypatch.setattr(A, "ROWS", 2)
    lists = pa.RecordBatch.from_pydict({"id": [0, 1, 2], "ids": pa.array([[1], None, []], pa.list_(pa.int32()))})
    assert [p.num_rows for p in A._parts([lists])] == [2, 1]
    assert list(A._parts([batch.slice(0, 0)])) == []
