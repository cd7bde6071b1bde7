import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.llm import simhash_ball as S


def plain_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest position reachable from each position."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("aBÉé \t\n \x1c世")), max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fp(text)


def near(seed, n, clusters):
    """Fingerprints in chains and clouds around some centres, in one block of bits and across blocks."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(clusters):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        low, high = S.BLOCKS[c % 3] if c % 2 else (0, 64)
        for _ in range(n):
            out.append(x)
            for b in rng.choice(np.arange(low, high), int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(3))
def test_components_of_all_links(spark, seed):
    fps = near(seed, 25, 9)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    edges = S.links(df)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0
    got = {r.node % 2**64: r.root % 2**64 for r in S.components(edges).collect()}
    want = plain_components(fps)
    groups = lambda label: sorted(sorted(i for i in range(len(fps)) if label[i] == k) for k in set(label))
    assert groups([got.get(x, x) for x in fps]) == groups([fps[w] for w in want])


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again " * 8
    rows = [(9, text, 1), (4, text, 2), (None, text, 3), (5, None, 4), (6, "", 5), (7, "two words", 6), (8, "x " * 60_000, 7), (4, text, 2), (3, " \t", 8), (11, text + "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted(map(str, (tuple(r) for r in S.near_duplicates(docs).collect())))
    fps = [plain_fp(t) for _, t, _ in rows]
    comp = plain_components(fps)
    smallest = [min(i for (i, _, _), c in zip(rows, comp, strict=True) if c == k and i is not None) for k in comp]
    assert got == sorted(str((i, f"{f:016x}", s)) for (i, _, _), f, s in zip(rows, fps, smallest, strict=True))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(smallest))
    alone = spark.createDataFrame([(None, "p q r"), (None, "p q r"), (None, "s t u v")], "doc_id long, text string")
    assert S.keep_one(alone).count() == 2 and S.near_duplicates(alone).where("component_id IS NULL").count() == 3
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain_fp(t) for _, t in rows]
    comp = plain_components(fps)
    assert sorted(tuple(r) for r in S.near_duplicates(docs).collect()) == [(i, f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, comp, strict=True)]
