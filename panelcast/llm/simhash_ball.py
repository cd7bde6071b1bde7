"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two documents are linked at ``radius`` 3 or fewer differing bits.
Two words of even distance 2t meet in the middle: each emits all its variants within t bits,
and they have one in common. For the odd radius 3 the third bit is taken out first: the 64
positions fall into three blocks, and each fingerprint is projected three times, leaving
one block out. Whichever bit two fingerprints differ in, one projection leaves it out and
has at most two others, so that variants within one bit (half of two) meet. That is 132
variants a fingerprint, where balls over all 64 bits would need 2,081.

Variants are shuffled and sorted; fingerprints under the same variant are verified on all 64
bits. A bucket is searched outwards from one member after another, and only a spanning
forest of its verified links is given out, never its pairs; any size of bucket is handled.
Links form components by repeated contraction (each node joins its smallest neighbour), one
written table a round.

Equal fingerprints are one node, however many documents carry them, so a group of copies
costs one row. Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows each get a row; null ids take part but are never the smallest of a component
(a component of null ids alone has a null id). Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import kind, narrow, unused
from panelcast.session import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text: a bit is set if over half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp long, text_hash long)`` for every row; the fingerprint as a signed number."""
    base = narrow(docs, id=id_col, text=text_col).select("id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "fp": pa.array(values.view(np.int64)), "text_hash": b.column("text_hash")})

    return base.mapInArrow(run, f"id {kind(base)}, fp long, text_hash long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(distinct: DataFrame) -> DataFrame:
    """``(key, fp)``: every projection of every fingerprint, with none or one of its bits turned over."""
    masks = []
    for number, (low, high) in enumerate(BLOCKS):
        left_out = ((1 << high) - 1) ^ ((1 << low) - 1)
        tag = (number + 1) << low  # the bits left out hold the number of the projection
        keep = _signed(~left_out & ((1 << 64) - 1))
        masks += [(keep, _signed(tag ^ flip)) for flip in [0, *(1 << i for i in range(64) if not low <= i < high)]]
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("keep"), F.lit(x).cast("long").alias("turn")) for k, x in masks])
    each = distinct.select("fp", F.explode(rows).alias("m"))
    return each.select(F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.turn")).alias("key"), "fp")


def _bucket_links(batches):
    """Sorted ``(key, fp)`` rows to ``(a, b)`` links, a spanning forest of each bucket."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        keys, fps = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if len(keys) == 0:
            continue
        if waiting and waiting[-1][0][-1] == keys[-1]:
            waiting.append((keys, fps))  # the last bucket goes on
            continue
        keys, fps = (np.concatenate([*(w[i] for w in waiting), x]) for i, x in ((0, keys), (1, fps)))
        last = int(np.searchsorted(keys, keys[-1]))
        waiting = [(keys[last:], fps[last:])]
        yield from _links(keys[:last], fps[:last])
    if waiting:
        yield from _links(*(np.concatenate([w[i] for w in waiting]) for i in (0, 1)))


def _links(keys: np.ndarray, fps: np.ndarray):
    if len(keys) < 2:
        return
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    found: set[tuple[int, int]] = set()
    for i in np.flatnonzero(np.diff(bounds) > 1):
        left = fps[bounds[i] : bounds[i + 1]].view(np.uint64)
        queue = []
        while len(left):
            if not queue:
                queue, left = [left[0]], left[1:]
                continue
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                a = int(x.view(np.int64))
                for y in left[near]:
                    c = int(y.view(np.int64))
                    found.add((min(a, c), max(a, c)))
                queue.extend(left[near])
                left = left[~near]
        if len(found) >= 1 << 16:
            yield _as_batch(found)
            found = set()
    if found:
        yield _as_batch(found)


def _as_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(sorted(found), np.int64)
    return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def links(distinct: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with a < b, enough links for the same components as all links."""
    dealt = variants(distinct).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_bucket_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)`` links.

    Each round sends every node to its smallest neighbour (or itself), then to where that
    one goes, and contracts the links; as nodes are hashes, a round leaves a fraction of
    them. The rounds end when no link is left; the maps are then composed backwards.
    """
    maps = []
    edges = materialize(edges)
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        step = materialize(step)
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = materialize(step.join(hop, "to").select("node", F.col("then").alias("to")))
        maps.append(step)
        a, b = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        edges = materialize(
            edges.join(a, "a").join(b, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].withColumnRenamed("to", "root")
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("to"), "root")
        out = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows; ``(fp, root)``; of each component the first row ``(root, first struct<no_id,id,text_hash>)``."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    row = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("text_hash"))
    distinct = prints.groupBy("fp").agg(F.min(row).alias("first"))
    roots = components(links(distinct.select("fp")))
    distinct = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    return prints, distinct.select("fp", "root"), distinct.groupBy("root").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row."""
    prints, roots, firsts = _grouped(docs, id_col, text_col, shingle)
    named = roots.join(firsts, "root").select("fp", F.col("first.id").alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with all its columns: of each component the row of the smallest id stays (null ids last, then by the hash of the text; of repeated rows one)."""
    _, _, firsts = _grouped(docs, id_col, text_col, shingle)
    k, no_id, h = unused(docs, "k", "no_id", "text_hash")
    firsts = firsts.select(F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias(k), F.col("first.no_id").alias(no_id), F.col("first.text_hash").alias(h))
    own = F.col(f"`{id_col}`")
    keyed = docs.select("*", F.coalesce(own.cast("string"), F.lit("")).alias(k), own.isNull().alias(no_id), F.xxhash64(f"`{text_col}`").alias(h))
    return keyed.join(firsts, [k, no_id, h], "left_semi").dropDuplicates([k, no_id, h]).select([f"`{c}`" for c in docs.columns])
