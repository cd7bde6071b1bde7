import os
import tempfile

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import url_digest as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("é.net", "/é", "block"), ("a.b", "", "block")]


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = ["http://WWW.Example.com/en/x?y", "http://example.com", "http://example.com/", "https://a.example.com/en/", "ftp://x.net/es/1#/", "no url", None, "", "x://", "http://é.net/éa", "http://xcom/", "q://a.b?c",
        "http://www.example.com/en"]


def test_rows(spark):
    rows = [(i if i % 5 else None, u, "h") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(str, (tuple(r) for r in U.judge(pages, RULES).collect())))
    assert got == sorted(str((i, *plain(u, RULES))) for i, u, _ in rows)
    assert U.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in U.judge(pages, [], "block").collect()} == {"block"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["com", "a.com", "b.a.com", "net"]), st.sampled_from(["", "/", "/x", "/x/", "/xy"])), max_size=8, unique=True), st.sampled_from(["http://b.a.com/x/y", "http://a.com", "p://net/xyz"]))
def test_longest_rule(pairs, url):
    rules = [(h, p, "block" if i % 2 else "allow") for i, (h, p) in enumerate(pairs)]
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "x")
        with open(path, "wb") as f:
            f.write(U.digest_bytes(rules))
        table = U.DigestArray(path)
        host, p = U.split_url(url)
        parts = host.split(".")
        cand = [(".".join(parts[k:]).encode(), p[:n].encode()) for k in range(len(parts)) for n in table.path_lengths if n <= len(p)]
        hits = [j for j in table.find([c[0] for c in cand], [c[1] for c in cand]) if j >= 0]
        assert {table.rule(j) for j in hits} == {h + q for h, q, _ in rules if (host == h or host.endswith("." + h)) and p.startswith(q)}


def test_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "x")
        with open(path, "wb") as f:
            f.write(U.digest_bytes(RULES))
        table = U.DigestArray(path)
        found = table.find([b"com", b"example.com", b"other.com"], [b"/", b"/en/", b"/"])
        assert [table.rule(j) if j >= 0 else None for j in found] == ["com/", "example.com/en/", None]
    assert np.all(np.diff(table.hashes.astype(np.int64)) >= 0)


def test_contradiction():
    with pytest.raises(ValueError):
        U.digest_bytes([("a", "/", "allow"), ("a", "/", "block")])
