"""Prefix trie of conversations by range minima over sorted longest common prefixes.

Every conversation is a row of turn digests. Rows are sorted by their digests (Spark's range
partitioning; equal rows by id, so a very common conversation spreads over partitions) and
taken in blocks of bounded size. In a block, the longest common prefixes (LCPs) of neighbours
go into a sparse table of range minima. A candidate prefix is (row, depth) from the depth the
row shares with the row before; each candidate binary-searches its left and its right extent
over the table, independently of all others. A candidate whose left extent is its own row is
a node, with its members as an interval; the others lead to the parent of their row's first
new node. Counts over a subtree are differences of running totals over the interval.

A node that reaches the border of its block may go on in the next one. Such nodes lie on the
paths of a block's first or last row. They are given out as parts under a hash of their path,
summed by it, and put right by the LCPs of the blocks' border rows (one row a block). The
ids that end at such a node stay in chunks of one block and are hashed as a stream, in order.

Memory: 24 bytes a turn for each conversation (texts are never gathered), and a block of at
most ``BLOCK_ROWS`` conversations or ``BLOCK_TURNS`` turns, or one longer conversation.

Turns are ordered by ``turn`` (null first; equal ones by the digest of role and text).
Null role or text is empty; a conversation without an id is none and is left out. Repeated
rows are turns of their own. Turns are equal if the SHA-256 digests of role and text begin
with the same 16 bytes. An empty table has no nodes. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.llm.common import narrow
from panelcast.session import materialize

WIDTH = 16  # bytes of a turn's digest
BLOCK_ROWS, BLOCK_TURNS = 1 << 14, 1 << 18

_PART = (
    "kind string, block long, first boolean, last boolean, key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, "
    "n_leaves long, member_bytes long, distinct_bytes long, before_bytes long, ends string, low binary, high binary, low_bytes array<long>"
)


def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, path array<struct<digest, bytes>>)``: the turns of each conversation in order."""
    t = narrow(turns, conv_id=conv, turn=turn, role=role, text=text).where("conv_id IS NOT NULL")
    role_, text_ = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role keeps (role, text) apart from other splits of the same string
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)), 1, WIDTH)
    each = t.select("conv_id", F.struct("turn", digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes")).alias("t"))
    gathered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("path"))  # nulls come first
    return gathered.select("conv_id", F.transform("path", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("path"))


def branch(own: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Conversation c becomes the first h turns of conversation c - c % group, then its own turns after its first h; h = crc32(c) % spread."""
    h = (F.crc32(F.col("conv_id").cast("string")) % spread).cast("int")
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, spread - 1).alias("head"))
    rows = own.select("*", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).join(base, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["path"].dataType)), F.lit(1), F.col("h"))
    tail = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, tail).alias("path"))


def _lcp(a: bytes, b: bytes) -> int:
    """Turns that two rows of digests share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = (np.frombuffer(v, np.uint8, n) for v in (a, b))
    return int((x != y).argmax()) // WIDTH


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of the 2^k values from each place on."""
    levels = [values]
    while 2 * (half := 1 << (len(levels) - 1)) <= len(values):
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def right_extents(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Last row r from which on back to ``rows`` all neighbours share ``depths`` turns: a binary search over the levels."""
    at, n = rows.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        fits = at + (1 << k) < n
        ok = fits.copy()
        ok[fits] = levels[k][at[fits] + 1] >= depths[fits]
        at[ok] += 1 << k
    return at


def left_extents(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """First row of the interval, searched likewise; the LCP of a row is that with the row before."""
    at = rows.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = at - (1 << k) >= 0
        ok = fits.copy()
        ok[fits] = levels[k][at[fits] - (1 << k) + 1] >= depths[fits]
        at[ok] -= 1 << k
    return at


def _chain(key: bytes) -> list[bytes]:
    """Hashes of all prefixes of a row, the empty one first."""
    out = [bytes(WIDTH)]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.blake2b(out[-1] + key[at : at + WIDTH], digest_size=WIDTH).digest())
    return out


def _ids(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _block(block: int, ids: np.ndarray, keys: list[bytes], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """Nodes of one block of sorted rows: whole ones, parts of those at its borders, and one row about the borders."""
    n = len(keys)
    length = np.fromiter((len(k) // WIDTH for k in keys), np.int64, n)
    lcp = np.fromiter((_lcp(a, b) for a, b in zip(keys[:-1], keys[1:], strict=True)), np.int64, n - 1)
    lcp = np.concatenate([[-1], lcp])
    levels, least = sparse_table(lcp), sparse_table(ids)
    # running bytes of each row: upto[start[i] + d] is what its first d turns have
    start = np.concatenate([[0], np.cumsum(length + 1)])
    upto = np.concatenate([np.concatenate([[0], np.cumsum(s)]) for s in sizes]).astype(np.int64)
    from_, count = np.maximum(lcp, 0), length - np.maximum(lcp, 0) + 1
    row = np.repeat(np.arange(n), count)
    depth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + from_[row]
    left, right = left_extents(levels, row, depth), right_extents(levels, row, depth)
    node = left == row
    number = np.cumsum(node) - 1  # of the node, at its candidate
    first_node = np.zeros(n, np.int64)  # number a node of depth 0 in a row would have
    firsts = np.flatnonzero(node)[np.unique(row[node], return_index=True)[1]] if node.any() else np.zeros(0, np.int64)
    first_node[row[firsts]] = number[firsts] - depth[firsts]
    # a shared candidate is the parent of the row's first new node; further parents stand just before their child
    shared_at = np.full(n, -1)
    shared_at[row[~node]] = first_node[left[~node]] + depth[~node]
    row, depth, right = row[node], depth[node], right[node]
    parent = np.where(depth == lcp[row] + 1, shared_at[row], np.arange(len(row)) - 1)
    parent[depth == 0] = -1
    n_convs = right - row + 1
    span = np.floor(np.log2(n_convs)).astype(np.int64)
    smallest = np.empty(len(row), np.int64)
    for k in np.unique(span):
        here = span == k
        smallest[here] = np.minimum(least[k][row[here]], least[k][right[here] - (1 << k) + 1])
    n_children = np.bincount(parent[parent >= 0], minlength=len(row))
    leaf = np.concatenate([lcp[1:], [-1]]) < length
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    all_bytes = upto[start[:-1] + length]
    new_bytes = all_bytes - upto[start[:-1] + np.maximum(lcp, 0)]
    members, fresh = np.concatenate([[0], np.cumsum(all_bytes)]), np.concatenate([[0], np.cumsum(new_bytes)])
    before = upto[start[row] + np.maximum(depth - 1, 0)]
    member_bytes = members[right + 1] - members[row] - n_convs * before
    distinct_bytes = fresh[right + 1] - fresh[row + 1] + all_bytes[row] - before
    # rows equal to the one before them end where it ends
    same = np.concatenate([[False], (lcp[1:] == length[1:]) & (lcp[1:] == length[:-1])])
    runs = np.flatnonzero(~same)
    run_end = np.zeros(n, np.int64)
    run_end[runs] = np.concatenate([runs[1:], [n]])
    first, last = row == 0, right == n - 1
    open_ = first | last
    chains = _chain(keys[0]), _chain(keys[-1])
    own = [(chains[0] if f else chains[1])[d] if o else None for f, o, d in zip(first.tolist(), open_.tolist(), depth.tolist(), strict=True)]
    ends: list[str] = []
    for r, d, o in zip(row.tolist(), depth.tolist(), open_.tolist(), strict=True):
        text = _ids(ids[r : run_end[r]]) if d == length[r] else ""
        ends.append(text if o else hashlib.sha256(text.encode()).hexdigest())
    of_parent = np.maximum(parent, 0)
    parent_open = open_[of_parent] & (parent >= 0)
    parent_key = [own[p] if o else None for p, o in zip(of_parent.tolist(), parent_open.tolist(), strict=True)]
    columns = {
        "kind": ["part" if o else "node" for o in open_.tolist()], "block": np.full(len(row), block), "first": first, "last": last, "key": own, "parent_key": parent_key,
        "parent_conv_id": pa.array(smallest[of_parent], mask=(parent < 0) | parent_open), "conv_id": smallest, "depth": depth, "n_convs": n_convs, "n_children": n_children,
        "n_leaves": leaves[right + 1] - leaves[row], "member_bytes": member_bytes, "distinct_bytes": distinct_bytes, "before_bytes": before, "ends": ends,
    }
    border = {"kind": "border", "block": block, "low": keys[0], "high": keys[-1], "low_bytes": upto[: length[0] + 1].tolist()}
    out = pa.Table.from_pydict({f.name: pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(row), f.type) for f in _SCHEMA}, _SCHEMA)
    return pa.concat_tables([out, pa.Table.from_pylist([border], _SCHEMA)]).combine_chunks().to_batches()[0]


_SCHEMA = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()), ("parent_conv_id", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("member_bytes", pa.int64()),
    ("distinct_bytes", pa.int64()), ("before_bytes", pa.int64()), ("ends", pa.string()), ("low", pa.binary()), ("high", pa.binary()), ("low_bytes", pa.list_(pa.int64())),
])


def _blocks(rows: int, turns: int):
    """Sorted ``(conv_id, key, sizes)`` rows of a partition in blocks; block numbers follow the order of the partitions."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, keys, sizes, held = [], [], [], 0
        for b in batches:
            for i, k, s in zip(b.column("conv_id").to_pylist(), b.column("key").to_pylist(), b.column("sizes"), strict=True):
                size = len(k) // WIDTH
                if ids and (len(ids) >= rows or held + size > turns):
                    yield _block(number, np.array(ids, np.int64), keys, sizes)
                    number, ids, keys, sizes, held = number + 1, [], [], [], 0
                ids.append(i)
                keys.append(k)
                sizes.append(s.values.to_numpy(zero_copy_only=False) if size else np.zeros(0, np.int64))
                held += size
        if ids:
            yield _block(number, np.array(ids, np.int64), keys, sizes)

    return run


def _stream_digests(batches):
    """Rows sorted by (key, block) to ``(key, ends_sha256)``: chunks of ids are hashed one after another."""
    key, state, begun = None, None, False
    for b in batches:
        done = []
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state, begun = k, hashlib.sha256(), False
            state.update((("," if begun else "") + text).encode())
            begun = True
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.binary()), "ends_sha256": pa.array([s for _, s in done], pa.string())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def _shared_turns(batches):
    """Depth that each block's first row shares with the row before, and its last row with the row after (-1 at the ends)."""
    for b in batches:
        low, high, above, below = (b.column(c).to_pylist() for c in ("low", "high", "above", "below"))
        yield pa.RecordBatch.from_pydict({
            "block": b.column("block"), "to_above": pa.array([-1 if a is None else _lcp(a, x) for a, x in zip(above, low, strict=True)], pa.int64()),
            "to_below": pa.array([-1 if a is None else _lcp(a, x) for a, x in zip(below, high, strict=True)], pa.int64()),
            "high_length": pa.array([len(x) // WIDTH for x in high], pa.int64()), "low_bytes": b.column("low_bytes"),
        })


def nodes(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of ``(conv_id, path)`` rows, one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    digests = F.array_join(F.transform("path", lambda x: F.hex(x["digest"])), "")
    rows = materialize(conversations.select("conv_id", F.unhex(digests).alias("key"), F.col("path.bytes").alias("sizes")))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = materialize(ordered.mapInArrow(_blocks(block_rows, block_turns), _PART))
    whole, parts = found.where("kind = 'node'"), found.where("kind = 'part'")

    # one row a block: what neighbouring blocks share
    order = Window.orderBy("block")
    borders = found.where("kind = 'border'").select("block", "low", "high", "low_bytes", F.lag("high").over(order).alias("above"), F.lead("low").over(order).alias("below"))
    shared = materialize(borders.mapInArrow(_shared_turns, "block long, to_above long, to_below long, high_length long, low_bytes array<long>"))

    depth = F.col("depth")
    known = parts.select("block", "first", "last", "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "member_bytes", "distinct_bytes", "before_bytes")
    known = known.join(shared, "block")
    # the first row's nodes up to to_above are not new; the last row goes on below it
    old_child = F.when(F.col("first") & (F.col("to_above") > depth), 1).otherwise(0)
    no_leaf = F.when(F.col("last") & (F.col("to_below") >= F.col("high_length")), 1).otherwise(0)
    old_bytes = F.when(F.col("first") & (F.col("to_above") >= depth), F.element_at("low_bytes", (F.greatest("to_above", F.lit(0)) + 1).cast("int")) - F.col("before_bytes")).otherwise(0)
    summed = known.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - old_child).alias("n_children"), F.sum(F.col("n_leaves") - no_leaf).alias("n_leaves"),
        F.sum(F.col("member_bytes") - F.col("distinct_bytes") + old_bytes).alias("saved_tokens"),
    )
    chunks = parts.where("ends <> ''").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block")
    digested = chunks.mapInArrow(_stream_digests, "key binary, ends_sha256 string")
    joined = materialize(summed.join(digested, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))))
    above = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    of_parts = joined.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above_id")).select(out)
    # children of border nodes look their parent up within their block: the root is no hot key
    named = materialize(parts.select("block", "key").join(joined.select("key", "conv_id"), "key").select("block", F.col("key").alias("parent_key"), F.col("conv_id").alias("above_id")))
    under = whole.where("parent_key IS NOT NULL").join(named, ["block", "parent_key"], "left").withColumn("parent_conv_id", F.col("above_id"))
    rest = whole.where("parent_key IS NULL")
    saved = (F.col("member_bytes") - F.col("distinct_bytes")).alias("saved_tokens")
    finish = lambda df: df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.col("ends").alias("ends_sha256"))
    return of_parts.unionByName(finish(under)).unionByName(finish(rest))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the branched conversations of ``(conv_id, turn, role, text)`` rows."""
    return nodes(branch(paths(turns)))


def branch_length(conv_id: int, spread: int = 9) -> int:
    """h of ``branch`` for one id, for tests and callers outside Spark."""
    return zlib.crc32(str(conv_id).encode()) % spread
