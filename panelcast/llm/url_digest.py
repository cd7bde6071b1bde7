"""URL rules in a sorted digest array.

A rule is a host and the beginning of a path. Its text (host + path) is hashed with 64-bit
xxhash; the sorted hashes, the verdicts and the full texts are three arrays in one file,
which Spark ships to every executor and each task memory-maps. A URL asks for every
(host or parent domain, path beginning) pair whose path length some rule has; a batch of
URLs is one vectorised binary search, and each hit is confirmed on the stored text, so that
a collision of hashes cannot give a wrong verdict. The longest rule that fits wins, a tie
goes to the longer host.

Null URLs and URLs without ``://`` have empty host and path and no rule; a URL with no rule
gets the default verdict. Repeated rows and null ids are kept. Repeated rules count once;
the same text both allowed and blocked is an error. Only the named columns are read.
"""

from __future__ import annotations

import mmap
import os
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from panelcast.llm.common import kind, narrow
from panelcast.session import scratch_path

_MAGIC = b"URLDIG01"
_HEAD = struct.Struct("<8sQQ")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MAPPED: dict[str, "DigestArray"] = {}


def digest_bytes(rules: list[tuple[str, str, str]]) -> bytes:
    """File content for ``(host, path, verdict)`` rules: header, sorted hashes, text ends, verdicts, host lengths, texts."""
    by_text: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict}")
        if by_text.setdefault((host, path), verdict) != verdict:
            raise ValueError(f"{host}{path} is both allowed and blocked")
    rows = sorted((xxhash.xxh64_intdigest((host + path).encode()), host, path, verdict) for (host, path), verdict in by_text.items())
    texts = [(host + path).encode() for _, host, path, _ in rows]
    n = len(rows)
    return b"".join([
        _HEAD.pack(_MAGIC, n, sum(map(len, texts))), np.array([r[0] for r in rows], "<u8").tobytes(), np.cumsum([0, *map(len, texts)]).astype("<u8").tobytes(),
        np.array([len(r[1].encode()) for r in rows], "<u4").tobytes(), np.array([r[3] == "block" for r in rows], "u1").tobytes(), *texts,
    ])


class DigestArray:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n, _ = _HEAD.unpack_from(self._map)
        if magic != _MAGIC:
            raise ValueError("not a digest file")
        at = _HEAD.size
        self.hashes = np.frombuffer(self._map, "<u8", n, at)
        self._ends = np.frombuffer(self._map, "<u8", n + 1, at + 8 * n)
        self._hosts = np.frombuffer(self._map, "<u4", n, at + 16 * n + 8)
        self._block = np.frombuffer(self._map, "u1", n, at + 20 * n + 8)
        self._texts = at + 21 * n + 8
        #: how long, in characters, the paths of the rules are
        self.path_lengths = sorted({len(self._text(i)[int(self._hosts[i]):].decode()) for i in range(n)})

    def _text(self, i: int) -> bytes:
        return self._map[self._texts + int(self._ends[i]) : self._texts + int(self._ends[i + 1])]

    def find(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """For each candidate the index of its rule, or -1."""
        out = np.full(len(hosts), -1)
        if not len(self.hashes) or not hosts:
            return out
        keys = np.array([xxhash.xxh64_intdigest(h + p) for h, p in zip(hosts, paths, strict=True)], np.uint64)
        at = np.searchsorted(self.hashes, keys)
        for i in np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == keys):
            j = int(at[i])
            while j < len(self.hashes) and self.hashes[j] == keys[i]:  # rules whose hashes collide stand together
                if int(self._hosts[j]) == len(hosts[i]) and self._text(j) == hosts[i] + paths[i]:
                    out[i] = j
                j += 1
        return out

    def verdict(self, i: int) -> str:
        return "block" if self._block[i] else "allow"

    def rule(self, i: int) -> str:
        return self._text(i).decode()


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _HOST.match(rest)[0]
    tail = rest[len(host):]
    return host.translate(_LOWER), _PATH.match(tail)[0]


def publish(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Write the digest file to the shared folder and let Spark bring it to the executors; returns its name."""
    path = scratch_path(spark, "url-digest")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    out = fs.create(target, False)
    out.write(bytearray(digest_bytes(rules)))
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(target).toString())
    return os.path.basename(path)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row."""
    base = narrow(pages, id=id_col, url=url_col)
    name = publish(pages.sparkSession, rules)

    def run(batches):
        if name not in _MAPPED:
            _MAPPED[name] = DigestArray(SparkFiles.get(name))
        table = _MAPPED[name]
        for b in batches:
            split = [split_url(u) for u in b.column("url").to_pylist()]
            owner, hosts, paths = [], [], []
            for i, (host, path) in enumerate(split):
                if not host and not path:
                    continue
                labels = host.split(".")
                for k in range(len(labels)):
                    domain = ".".join(labels[k:]).encode()
                    for n in table.path_lengths:
                        if n <= len(path):
                            owner.append(i)
                            hosts.append(domain)
                            paths.append(path[:n].encode())
            best: dict[int, tuple[int, int, int]] = {}
            for c, j in enumerate(table.find(hosts, paths)):
                if j >= 0:
                    fit = (len((hosts[c] + paths[c]).decode()), len(hosts[c]), int(j))
                    best[owner[c]] = max(best.get(owner[c], fit), fit)
            fits = [best.get(i) for i in range(len(split))]
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "host": pa.array([s[0] for s in split], pa.string()), "path": pa.array([s[1] for s in split], pa.string()),
                "rule": pa.array([f and table.rule(f[2]) for f in fits], pa.string()),
                "verdict": pa.array([table.verdict(f[2]) if f else default for f in fits], pa.string()),
            })

    schema = f"id {kind(base)}, host string, path string, rule string, verdict string"
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
