import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelcast.llm import token_store as S
from panelcast.session import scratch_path

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab 'st1.\n\té\u00a0\u3000", "<|endoftext|>", "  ", "don't", "!?"]), max_size=60).map("".join), max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    assert S.encoder(PATH).encode(texts) == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30), st.integers(1, 16), st.randoms())
def test_file_round_trip(sizes, frame, rnd):
    docs = [np.array([rnd.randrange(50_000) for _ in range(n)], "<u4").tobytes() for n in sizes]
    f = io.BytesIO()
    w = S.Writer(f, frame)
    for d in docs:
        w.add(d)
    assert w.close() == sum(sizes)
    r = S.Reader(f)
    assert len(r) == len(docs)
    order = list(range(len(docs)))
    rnd.shuffle(order)
    assert all(r.read(i) == docs[i] for i in order)
    f.seek(0)  # any decoder reads the plain stream
    assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(docs)


def test_only_the_wanted_frames_are_read_and_damage_is_seen():
    f = io.BytesIO()
    w = S.Writer(f, 100)
    for i in range(50):
        w.add(np.full(37, i, "<u4").tobytes())
    w.close()
    r = S.Reader(f)
    raw = bytearray(f.getvalue())
    raw[int(r._packed[5]) + 12] ^= 255
    damaged = S.Reader(io.BytesIO(bytes(raw)))
    assert damaged.read(0) == np.full(37, 0, "<u4").tobytes()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.read(14)


@pytest.mark.parametrize("bounds", [{}, {"file_docs": 1}, {"file_ids": 3}])
def test_rows(spark, bounds):
    rows = [(5, "five words <|endoftext|>", "a"), (None, "none", "b"), (2, None, "c"), (2, "two", "d"), (2, "two", "d"), (9, "", "e"), (7, "long " * 50_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = scratch_path(spark, "store")
    files = S.write(docs, folder, PATH, **bounds)
    assert not bounds or files.count() >= 4
    got = sorted((tuple(r) for r in S.read(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 2, 2, 2, 5, 7, 9]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    end = b"\0\0\0\0"
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((i or -1, len(x) // 4, zlib.crc32(x)) for i, t, _ in rows for x in [plain(t or "") + end])
    found = S.lookup(spark, folder, spark.createDataFrame([(7,), (2,), (2,), (100,), (None,)], "doc_id long")).collect()
    assert sorted((r[0], bytes(r[1])) for r in found) == sorted((i, plain(t or "") + end) for i, t, _ in rows if i in (7, 2))
    empty = scratch_path(spark, "store")
    S.write(docs.limit(0), empty, PATH)
    assert S.read(spark, empty).count() == 0


def test_same_as_the_library_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        x = plain(r.text or "") + b"\0\0\0\0"
        want.append((r.doc_id, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted(tuple(r) for r in S.round_trip(docs, PATH).collect()) == want
