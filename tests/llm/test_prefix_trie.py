import hashlib
import random

import pytest

from panelcast.llm import prefix_trie as T

EMPTY = hashlib.sha256().hexdigest()


def brute(rows):
    """Nodes of conversations rebuilt by the rule, from (conv_id, turn, role, text) rows."""
    own = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    for c, n, r, t in rows:
        if c is not None:
            own.setdefault(c, []).append(((n is not None, n or 0), digest(r or "", t or ""), r or "", t or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = T.branch_length(c)
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), len(leaves),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r) for r in T.nodes(T.branch(T.paths(df)), **kw).collect()), key=str)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 1}, {"block_rows": 3}, {"block_turns": 5}])
def test_against_brute_force(spark, blocks):
    draw = random.Random(5)
    rows = [(c, n, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "ccc"])) for c in range(60) for n in range(draw.randint(0, 5))]
    rows += [(c, n, "user", "the same") for c in range(100, 140) for n in range(3)]
    rows += [(200, n, "user", f"turn {n}") for n in range(120)]
    assert run(spark, rows, **blocks) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", "x" * 100_000), (5, 0, "user", "x" * 100_000), (6, 1, "user", ""), (7, 1, None, "role"), (8, 3, "ro", "le")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_turnless_conversations_end_at_the_root(spark):
    c = next(i for i in range(1, 100) if i % 5 and T.branch_length(i) >= 2)
    assert run(spark, [(c, 0, "user", "cut away")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (5, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, depth long")
    assert sorted((tuple(r) for r in T.conversation_trie(df).collect()), key=str) == brute(rows)


def test_extents():
    import numpy as np

    lcp = np.array([-1, 2, 1, 1, 3, 0])
    levels = T.sparse_table(lcp)
    rows, depths = np.array([1, 3, 4, 5]), np.array([1, 1, 3, 0])
    assert T.left_extents(levels, rows, depths).tolist() == [0, 0, 3, 0]
    assert T.right_extents(levels, rows, depths).tolist() == [4, 4, 4, 5]
