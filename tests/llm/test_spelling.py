import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, lift=S.LIFT):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= lift * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def run(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in S.variants(df).collect())


def test_against_brute_force(spark):
    draw = random.Random(3)
    counts = {}
    for _ in range(60):
        word = "".join(draw.choices("abcàé", k=draw.randint(7, 9)))
        counts[word] = draw.choice([2, 30, 400, 5000])
        for _ in range(8):
            i, c = draw.randrange(len(word)), draw.choice("abé")
            counts.setdefault(draw.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]]), draw.choice([2, 3, 40, 50]))
    assert run(spark, counts) == brute(counts)


def test_one_letter_words_and_chains(spark):
    counts = {"aaaaaaa": 10_000, "aaaaaab": 1_000, "aaaaabb": 100, "aaaabbb": 10, "aaaaaaaa": 9, "zzzzzzz": 2}
    got = run(spark, counts)
    assert got == brute(counts)
    assert {r[0]: r[2] for r in got}["aaaabbb"] == "aaaaaaa"


@pytest.mark.parametrize("length", [63, 64, 65, 20_000])
def test_long_words(spark, length):
    word = "".join(random.Random(length).choices("abcdé", k=length))
    counts = {word: 500, word[1:]: 3, word[:-1] + "z": 4, word + "q": 5, "y" + word: 6, word[2:]: 7}
    assert run(spark, counts) == brute(counts)


def test_neighbours_reach_every_edit():
    draw = random.Random(9)
    for _ in range(300):
        a = "".join(draw.choices("abcdefgh", k=7))
        i, c = draw.randrange(7), draw.choice("abcdefgh")
        b = draw.choice([a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :]])
        keys = {}
        for w in (a, b):
            (_, matrix), = S._groups([w])
            keys[w] = set(S.neighbours(matrix)[1].tolist()), int(S._hashes(matrix)[0])
        assert keys[a][1] in keys[b][0] or keys[b][1] in keys[a][0]


def test_word_counts(spark):
    rows = [(1, "Straße straßen ÀÉÎÕÜáé Abcdefg abcdefg", 1), (2, "x" * 100_000 + " " + "abcdefg " * 500, 2), (None, "nulls are empty strings", 3), (3, None, 4), (4, "", 5), (1, "Abcdefg", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long")
    want = Counter()
    for i, t, _ in rows:
        import re

        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            w = r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r
            if len(w) >= 7:
                want[w] += 1
    assert dict(S.word_counts(docs).collect()) == dict(want)
    got = S.spelling_variants(docs).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if n >= 2}
    assert S.spelling_variants(docs.limit(0)).collect() == []


def test_hash_of_a_shorter_word():
    (_, whole), = S._groups(["abcdefgh"])
    rows, keys, same = S.neighbours(whole)
    shorter = {int(S._hashes(next(S._groups(["abcdefgh"[:i] + "abcdefgh"[i + 1 :]]))[1])[0]) for i in range(8)}
    assert shorter <= set(keys.tolist()) and same.sum() == 1 and len(np.unique(keys)) == len(keys)
