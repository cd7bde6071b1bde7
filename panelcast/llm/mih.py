"""Nearest vectors by multi-index hashing of learned binary codes.

Codes are signs of rotated vectors; the rotations are learned by iterative quantisation (the
rotation that brings the sample closest to its own signs) on a bounded sample of
``sample_rows`` vectors, several of them side by side if more bits than dimensions are
wanted. The Hamming radius is measured on the same sample: the ``cover`` quantile of the
distances between codes of true neighbours. The sample only sets the code and the radius;
every vector is indexed and every query searches all of them.

Vectors and queries are dealt into blocks of bounded size, and every pair of blocks is one
group of a co-grouped task, so that neither the driver nor one task holds either set. In a
block each code is cut into substrings of eight bits with one bucket table each. Of two
codes within the radius, some substring differs in no more than its share of it, so probing
the buckets within that share of the query's substring retrieves every code in the radius.
Codes are then compared in full and the original vectors of what is left reranked in double
precision. Where a block has fewer than ``k`` codes in the radius, the radius grows there, so
a query always gets ``k`` results if there are so many candidates.

Vectors that are null, zero, of another length or hold null or non-finite numbers take no
part, nor do null ids. A query never meets rows of its own id. Ties go to the smaller id.
Repeated rows are candidates of their own. Only id and vector are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import narrow, vectors, whole

SUB = 8  # bits of a substring
#: For each radius, what turns a substring into all those within it.
_BALLS = [np.array([sum(1 << i for i in c) for n in range(r + 1) for c in combinations(range(SUB), n)]) for r in range(SUB + 1)]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def _iterative_quantisation(x: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(x.T @ np.where(x @ rotation > 0, 1.0, -1.0))
        rotation = left @ right
    return rotation


def hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(1, dtype=np.int64)


def fit(df: DataFrame, id_col: str, vector_col: str, bits: int = 128, k: int = 20, cover: float = 0.97, sample_rows: int = 8192, seed: int = 7) -> Model | None:
    """Fit on the ``sample_rows`` rows with the smallest hashes of the id; None if no vector is usable."""
    base = narrow(df, id=id_col, v=vector_col).where("id IS NOT NULL AND v IS NOT NULL")
    sample = base.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample_rows).select("v").toArrow()
    if sample.num_rows == 0:
        return None
    column = whole(sample.column("v"))
    width = int(np.bincount(np.asarray(column.value_lengths())).argmax())
    x, usable = vectors(column, width)
    x = x[usable]
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    mean = x.mean(0) if len(x) > 1 else np.zeros(width)
    turns = -(-bits // width)
    rotation = np.hstack([_iterative_quantisation(x - mean, rng) for _ in range(turns)])[:, : bits // SUB * SUB]
    model = Model(mean, rotation, 0)
    codes, distances = model.codes(x), []
    for i in rng.permutation(len(x))[:400]:
        scores = x @ x[i]
        scores[i] = -np.inf
        near = np.argsort(-scores)[: min(k, len(x) - 1)]
        distances.append(hamming(codes[near], codes[i]))
    every = np.concatenate([*distances, np.zeros(1, np.int64)])
    return Model(mean, rotation, int(np.quantile(every, cover, method="higher")))


class Index:
    """Bucket tables over the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self._codes = codes
        self._order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self._bounds = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self._order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius."""
        m = len(code)
        share, rest = divmod(min(radius, m * SUB), m)
        seen = np.zeros(len(self._codes), bool)
        for j in range(m):
            r = share if j <= rest else share - 1  # pigeonhole: else the distance would exceed the radius
            if r < 0:
                continue
            buckets = int(code[j]) ^ _BALLS[min(r, SUB)]
            begin, end = self._bounds[j][buckets], self._bounds[j][buckets + 1]
            size = end - begin
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            seen[self._order[j][at]] = True
        found = np.flatnonzero(seen)
        return found[hamming(self._codes[found], code) <= radius]


def _search_block(model: Model, k: int):
    width, total = model.rotation.shape

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            (v, ok), (q, asked) = (vectors(t.column("v"), width) for t in (left, right))
            ids = np.asarray(whole(left.column("id")))[ok]
            v = v[ok]
            index, q_codes = Index(model.codes(v)), model.codes(q)
            q_ids = np.asarray(whole(right.column("id")))
            for i in np.flatnonzero(asked):
                others = int((ids != q_ids[i]).sum()) if len(ids) <= k else k
                radius = model.radius
                while True:
                    near = index.within(q_codes[i], radius)
                    near = near[ids[near] != q_ids[i]]
                    if len(near) >= min(k, others) or radius >= total:
                        break
                    radius += SUB
                scores = v[near] @ q[i]
                if len(near) > k:
                    best = scores >= np.partition(scores, -k)[-k]
                    near, scores = near[best], scores[best]
                top = np.lexsort((ids[near], -scores))[:k]
                out["query_id"].append(np.full(len(top), q_ids[i]))
                out["vec_id"].append(ids[near][top])
                out["score"].append(scores[top])
        return pa.table({
            n: pa.array(np.concatenate(out[n]) if out[n] else [], t) for n, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
        })

    return search


def search(
    df: DataFrame, is_query: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, model: Model | None = None,
    block_rows: int = 8192, query_rows: int = 4096, **fitting,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``df`` that ``is_query`` holds for, against all rows; ``is_query`` is an expression over ``id``."""
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    model = model or fit(df, id_col, vector_col, k=k, **fitting)
    if model is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = narrow(df, id=id_col, v=vector_col).where("id IS NOT NULL AND v IS NOT NULL").withColumn("id", F.col("id").cast("long"))
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks, n_query_blocks = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["q"] // query_rows))
    block = lambda n, salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = base.select("id", "v", block(n_blocks, 1).alias("vb"), every(n_query_blocks).alias("qb"))
    asked = base.where(is_query).select("id", "v", block(n_query_blocks, 2).alias("qb"), every(n_blocks).alias("vb"))
    found = held.groupBy("vb", "qb").cogroup(asked.groupBy("vb", "qb")).applyInArrow(_search_block(model, k), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
