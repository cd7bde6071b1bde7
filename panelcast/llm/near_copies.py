"""Near copies by the exact Jaccard similarity of five-word shingles.

Two texts are linked if their sets of shingles are alike by ``SIMILARITY`` or more. Links are
found in three steps, each verified on whole sets:

* SimHash ball hashing (``simhash_ball``) over five-word fingerprints joins most copies;
* an exact prefix filter gives all other candidates: in any one order of all shingles, two
  sets alike by 0.8 share one of the first n - ceil(0.8 n) + 1 of either. The order puts the
  shingles seen rarely first, so that those of templates lie outside the prefixes of texts
  with enough of their own. Under each shared shingle every text is held against one of
  them, three times another one; the links form components;
* texts that share a shingle of their prefixes and are still in different components are held
  against each other, if their sizes, the places of the shingle and the parities of their
  sets allow the similarity. These bounds are exact: no pair is left out by them.

The order comes from counts of shingles that recur within a stretch of texts, added up in
2^20 cells (a table of at most 1 MB for any input). It changes what is compared, not what is
found. Equal texts are one node. A large group of near copies costs a few rows a member;
only texts of one shared rare shingle, in different components, that pass the bounds cost a
row a pair.

Words are those of ``simhash_ball``; a text of fewer than five is one shingle, and texts
without words are copies of each other. Repeated rows and null ids are dealt with as in
``simhash_ball.keep_one``. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import simhash_ball
from panelcast.llm.common import kind, narrow, unused
from panelcast.llm.simhash_ball import SEED, components
from panelcast.session import materialize, small_batches

SHINGLE = 5
SIMILARITY = 0.8
CELLS = 1 << 20  # of the table of counts
TURNS = 3  # times that the members of a key are held against one of them
STRETCH = 1 << 21  # shingles among which recurring ones are counted
ROWS = 256  # texts or pairs whose shingles are held at once in a task
PARITIES = 512  # bits, one a class of shingles
_NOTHING = -1  # the only key of a text without words


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def prefix(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first in the common order, as many as the filter needs."""
    n = len(found)
    if not n:
        return np.full(1, _NOTHING, np.int64)
    order = np.argsort(levels[found >> np.uint64(44)], kind="stable")  # of one level, the smaller hash first
    return found[order[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]].view(np.int64)


def parities(found: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the shingles is of class i."""
    return np.packbits(np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1, bitorder="little").tobytes()


def most_shared(size_a, size_b, parity_a: np.ndarray, parity_b: np.ndarray):
    """At least the number of shingles two sets share: each class whose parity differs holds one of only one set."""
    return (size_a + size_b - np.bitwise_count(parity_a ^ parity_b).sum(-1, dtype=np.int64)) // 2


def _recurring(batches):
    """``(cell, n)`` of the shingles that several texts of a stretch have."""
    held, n = [], 0

    def counted():
        values = np.concatenate(held)
        held.clear()
        values.sort()
        bounds = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
        counts = np.diff(bounds)
        again = counts > 1
        sums = np.bincount((values[bounds[:-1][again]] >> np.uint64(44)).astype(np.int64), counts[again], CELLS)
        cells = np.flatnonzero(sums)
        return pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "n": pa.array(sums[cells].astype(np.int64))})

    for b in batches:
        for t in b.column("text"):
            held.append(shingles(t.as_py()))
            n += len(held[-1])
            if n >= STRETCH:
                yield counted()
                n = 0
    if n:
        yield counted()


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def levels_of(texts: DataFrame) -> np.ndarray:
    """A level for each cell, twice the binary logarithm of its count: at most ``CELLS`` rows reach the driver."""
    table = texts.select("text").mapInArrow(_recurring, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(CELLS, np.uint8)
    levels[table.column("cell").to_numpy()] = 1 + 2 * np.log2(table.column("n").to_numpy())
    return levels


def _sketch(levels):
    def run(batches):
        table = levels.value
        for b in _slices(batches):
            texts = [t.as_py() for t in b.column("text")]
            found = list(map(shingles, texts))
            yield pa.RecordBatch.from_pydict({
                **{c: b.column(c) for c in ("no_id", "id", "k", "node")}, "n": pa.array(list(map(len, found)), pa.int64()), "keys": pa.array([prefix(f, table) for f in found], pa.list_(pa.int64())),
                "parity": pa.array(list(map(parities, found)), pa.binary()), "fp": pa.array(np.array([simhash_ball.fingerprint(t, SHINGLE) for t in texts], np.uint64).view(np.int64)),
            })

    return run


def _sets(batches):
    for b in _slices(batches):
        yield pa.RecordBatch.from_pydict({"node": b.column("node"), "found": pa.array([shingles(t.as_py()).tobytes() for t in b.column("text")], pa.binary())})


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verify(batches):
    for b in _slices(batches):
        sets = ([np.frombuffer(x.as_py(), np.uint64) for x in b.column(c)] for c in ("set_a", "set_b"))
        yield b.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))


def _across(batches):
    """Rows sorted by key to pairs under a key in different components that may be alike."""
    names = ("node", "root", "n", "pos")
    key, held, bits = None, None, None
    for b in batches:
        keys, *columns = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", *names))
        parity = np.frombuffer(b"".join(b.column("parity").to_pylist()), np.uint64).reshape(len(keys), PARITIES // 64)
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if held is None or keys[lo] != key:
                key, held, bits = keys[lo], [c[:0] for c in columns], parity[:0]
            at = len(bits)
            held, bits = [np.concatenate([x, c[lo:hi]]) for x, c in zip(held, columns, strict=True)], np.concatenate([bits, parity[lo:hi]])
            nodes, roots, sizes, places = held
            for i in range(at, len(nodes)):
                needed = SIMILARITY / (1 + SIMILARITY) * (sizes[:i] + sizes[i]) - 1e-9
                small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
                # if this is the first shingle they share, what follows in either order bounds the rest
                rest = np.minimum(sizes[:i] - places[:i], sizes[i] - places[i])
                open_ = np.flatnonzero((roots[:i] != roots[i]) & (small >= SIMILARITY * large - 1e-9) & (rest >= needed))
                open_ = open_[most_shared(sizes[open_], sizes[i], bits[open_], bits[i]) >= needed[open_]]
                if len(open_):
                    other = nodes[open_]
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(other, nodes[i])), "b": pa.array(np.maximum(other, nodes[i]))})


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that are alike."""
    with_b = pairs.distinct().join(sets.select(F.col("node").alias("b"), F.col("found").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("found").alias("set_a")), "a")
    return materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose SimHash fingerprints are equal or within the ball's radius (a forest of them)."""
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.join(heads, "fp").where("node <> head").select(_ordered("node", "head"))
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_node")) for c in ("a", "b"))
    near = simhash_ball.links(heads.select("fp")).join(a, "a").join(b, "b")
    return equal.union(near.select(_ordered("a_node", "b_node")))


def linked(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that is alike another one."""
    by_print = materialize(_by_fingerprint(nodes))
    buckets = nodes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    shared = materialize(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"))
    members = materialize(buckets.join(shared, "key").select("key", "node", "n", "pos"))
    # one row a node is looked up by its id too: copies of a text do not meet in one task
    asked = members.select("node").union(by_print.select(F.explode(F.array("a", "b")))).distinct()
    wanted = nodes.join(asked, "node", "left_semi").select("first.no_id", "first.k", "node")
    texts = keyed.join(wanted, ["no_id", "k", "node"], "left_semi").dropDuplicates(["no_id", "k", "node"]).select("node", "text")
    sets = materialize(texts.mapInArrow(_sets, "node long, found binary"))

    def undecided(roots: DataFrame) -> DataFrame:
        """Members of the keys under which several components meet."""
        placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "n", "pos")
        split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return placed.join(split, "key", "left_semi")

    tried, links = by_print.distinct(), _linked(by_print, sets)
    for turn in range(TURNS):
        rows = materialize(undecided(components(links)))
        heads = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "pos", "root")).alias("h"))
        needed = SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("h.n")) - 1e-9
        fits = (F.least("n", "h.n") >= SIMILARITY * F.greatest("n", "h.n") - 1e-9) & (F.least(F.col("n") - F.col("pos"), F.col("h.n") - F.col("h.pos")) >= needed)
        stars = rows.join(heads, "key").where((F.col("root") != F.col("h.root")) & fits).select(_ordered("node", "h.node")).distinct()
        stars = materialize(stars.join(tried, ["a", "b"], "left_anti"))
        tried, links = materialize(tried.union(stars)), materialize(links.union(_linked(stars, sets)))
    # written first: after a join on the same key Spark leaves the repartitioning out, and adaptive execution may then deal a key to several tasks
    rows = materialize(undecided(components(links)).join(nodes.select("node", "parity"), "node"))
    rest = rows.select("key", "node", "root", "n", "pos", "parity").repartition("key").sortWithinPartitions("key").mapInArrow(_across, "a long, b long")
    more = _linked(materialize(rest.distinct().join(tried, ["a", "b"], "left_anti")), sets)
    return materialize(components(links.union(more)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns: of each component the row of the smallest id stays (null ids last, then by the hash of the text; of repeated rows one)."""
    small_batches(docs.sparkSession)
    own = F.col("id")
    keyed = narrow(docs, id=id_col, text=text_col).select(
        own.isNull().alias("no_id"), F.col("id"), F.coalesce(own.cast("string"), F.lit("")).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text"
    )
    levels = docs.sparkSession.sparkContext.broadcast(levels_of(keyed))
    fields = f"no_id boolean, id {kind(keyed)}, k string, node long, n long, keys array<long>, parity binary, fp long"
    sketches = keyed.select("no_id", "id", "k", "node", "text").mapInArrow(_sketch(levels), fields)
    # the smallest id by its own type, carried along next to the sketch
    nodes = materialize(sketches.groupBy("node").agg(F.min(F.struct("no_id", "id", "k")).alias("first"), *[F.first(c).alias(c) for c in ("n", "keys", "parity", "fp")]))
    roots = linked(keyed, nodes)
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("first.no_id", "first.id", "first.k", "node")).alias("first"))
    no_id, k, h = unused(docs, "no_id", "k", "node")
    stay = grouped.select(F.col("first.no_id").alias(no_id), F.col("first.k").alias(k), F.col("first.node").alias(h))
    mine = F.col(f"`{id_col}`")
    marked = docs.select("*", mine.isNull().alias(no_id), F.coalesce(mine.cast("string"), F.lit("")).alias(k), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias(h))
    return marked.join(stay, [no_id, k, h], "left_semi").dropDuplicates([no_id, k, h]).select([f"`{c}`" for c in docs.columns])
