"""Language-model scores from a log-frequency Bloom filter.

Training texts give exact token counts (a table) and counts of neighbouring token pairs.
A count c is quantised to level 1 + floor(log2 c), and the filter holds (key, 1) ... (key,
level) for every token and every pair. A count is read back by probing level after level
until one is missing. The filter consists of segments by the high bits of the key; each is
built in a task of its own from pre-aggregated counts, so hot pairs cost one row a flush.

The smoothed probability of token w after h is l q(hw)/q(h) + (1 - l) (q(w) + 1)/(N + V + 1),
with q the counts read from the filter; after an unknown h only the second part counts. l is
measured on all pairs: the share of pair occurrences whose pair occurs again.

The filter grows with the corpus. Segments are broadcast in groups of at most
``filter_bytes``; if there are several groups the texts are passed over once for each, and
the levels found so far travel with the texts in a written table. The result is the same.
The exact counts of the base score come from two sides: at most ``hot_tokens`` tokens, those
of the highest counts and of 64 bytes or fewer, are broadcast; the rest are joined by token.

Null text counts as empty and consists of the end token alone. Null ids belong to the
training side. Repeated rows count and are scored each. With no training text N and V are
zero and every token has probability one over one. Only id and text are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import kind, narrow, slices, whole
from panelcast.session import materialize, small_batches

END = b""  # words are never empty
HOT_TOKENS = 131_072
LONGEST_HOT = 64
FILTER_BYTES = 128 << 20
SEGMENT_TOKENS = 1 << 21
ROWS, BYTES = 512, 2 << 20  # texts handled at once in a task, and their bytes unless one text has more
FLUSH = 1 << 22  # pair occurrences held before they are summed and sent
PART = 1 << 15  # keys whose bits are worked out at once
BITS, HASHES, BLOCK = 10, 5, 512  # bits an entry, bits set for each, bits of a block
_START, _STOP = np.uint64(0x5D1A4B7C3E2F6981), np.uint64(0x1B5E0C9D7A3F2648)
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # constants of splitmix64

_LOWER = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)), np.uint8)  # A-Z and the six ASCII spaces only


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_token_hash = xxhash.xxh64_intdigest


def _single_keys(h: np.ndarray) -> np.ndarray:
    return _mix(h ^ _GOLD)


def _pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(before * _GOLD + _mix(h))


def _segment(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)


def quantised(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: one, or the geometric middle of its range."""
    return np.where(level <= 1, level, np.exp2(level - 0.5)).astype(np.float64)


def _bits(keys: np.ndarray, level: int | np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each (key, level), and its bits inside the block."""
    with np.errstate(over="ignore"):
        x = _mix(keys + np.asarray(level, np.uint64) * _GOLD)
        block = ((x >> np.uint64(32)) * blocks.astype(np.uint64)) >> np.uint64(32)
        y = _mix(x + _GOLD)
    return block.astype(np.int64), [((y >> np.uint64(9 * i)) & np.uint64(BLOCK - 1)).astype(np.int64) for i in range(HASHES)]


def _built(keys: np.ndarray, counts: np.ndarray) -> bytes:
    level = levels(counts).astype(np.uint8)
    blocks = max(1, -(-int(level.sum(dtype=np.int64)) * BITS // BLOCK))
    bits = np.zeros(blocks * BLOCK // 8, np.uint8)
    for at in range(0, len(keys), PART):
        part, own = keys[at : at + PART], level[at : at + PART]
        for j in range(1, int(own.max(initial=0)) + 1):
            block, inside = _bits(part[own >= j], j, np.array(blocks))
            for b in inside:
                np.bitwise_or.at(bits, block * (BLOCK // 8) + (b >> 3), (1 << (b & 7)).astype(np.uint8))
    return bits.tobytes()


class Filter:
    """Some neighbouring segments of the whole filter."""

    def __init__(self, first: int, sizes: list[int], bits: bytes, n_segments: int):
        self.first, self.n_segments, self.n = first, n_segments, len(sizes)
        self._blocks = np.array(sizes, np.int64) * 8 // BLOCK
        self._begin = np.concatenate([[0], np.cumsum(self._blocks)[:-1]]).astype(np.int64)
        self._bits = np.frombuffer(bits, np.uint8)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by probing upwards; zero for keys of other segments."""
        out = np.zeros(len(keys), np.uint8)
        for at in range(0, len(keys), PART):
            part = keys[at : at + PART]
            own = _segment(part, self.n_segments).astype(np.int64) - self.first
            alive = np.flatnonzero((own >= 0) & (own < self.n))
            level = 0
            while len(alive):
                level += 1
                block, inside = _bits(part[alive], level, self._blocks[own[alive]])
                byte = (block + self._begin[own[alive]]) * (BLOCK // 8)
                hit = np.ones(len(alive), bool)
                for b in inside:
                    hit &= (self._bits[byte + (b >> 3)] >> (b & 7).astype(np.uint8)) & 1 == 1
                alive = alive[hit]
                out[at + alive] = level
        return out


def held_out_ids(ids):
    return F.coalesce(F.pmod(F.crc32(F.col(ids).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _texts(b: pa.RecordBatch):
    """Slices of few texts: ``(slice, distinct words, number of each word in order, number of words of each text)``."""
    for part in slices(b, "text", ROWS, BYTES):
        text = whole(part.column("text")).cast(pa.large_binary()).fill_null(b"")
        first = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[first[0] : first[-1]]
        first = first - first[0]
        letters = _LOWER[data]
        inside = letters != ord(" ")
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = first[:-1][first[:-1] < first[1:]]
        begins[heads] = inside[heads]
        letters = letters[inside]
        bounds = np.append(np.flatnonzero(begins[inside]), len(letters))
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        sizes = np.diff(np.searchsorted(np.flatnonzero(begins), first))
        yield part, words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), sizes


def token_counts(texts: DataFrame) -> DataFrame:
    """``(token binary, n long)``, the end token included."""

    def run(batches):
        _let_go()
        held: dict[bytes, int] = {}
        for b in batches:
            for _, words, at, sizes in _texts(b):
                for word, n in zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True):
                    held[word] = held.get(word, 0) + n
                held[END] = held.get(END, 0) + len(sizes)
                if len(held) >= 1 << 18:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
                    held = {}
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _hashes(words: list[bytes], at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, the end and the start, number of each token with ends, number of the token before)."""
    own = np.append(np.fromiter(map(_token_hash, words), np.uint64, len(words)), [_STOP, _START])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.insert(at.astype(np.int32), np.cumsum(sizes), len(words))  # the end token stands after the distinct words
    before = np.roll(place, 1)
    before[starts] = len(words) + 1
    return own, place, before


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _by_segment(keys: np.ndarray, counts: np.ndarray | None, n_segments: int, pairs: bool):
    """Sorted keys, summed and packed segment after segment; each is a row and a batch of its own."""
    lowest = np.array([-(-(s << 32) // n_segments) << 32 for s in range(n_segments)], np.uint64)  # key of each segment
    bounds = np.append(np.searchsorted(keys, lowest), len(keys))
    for i in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[i], bounds[i + 1])
        k, n = _summed(keys[own], None if counts is None else counts[own])
        yield pa.RecordBatch.from_pydict({
            "seg": pa.array([i], pa.int32()), "pairs": pa.array([pairs]),
            "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.astype("<i8").tobytes()], pa.binary()),
        })


PACKED = "seg int, pairs boolean, keys binary, counts binary"


def _pair_rows(texts: DataFrame, n_segments: int) -> DataFrame:
    def run(batches):
        _let_go()
        held, n = np.empty(FLUSH, np.uint64), 0  # sorted in place
        for b in batches:
            for _, words, at, sizes in _texts(b):
                own, place, before = _hashes(words, at, sizes)
                keys = _pair_keys(own[before], own[place])
                while len(keys):
                    fits = keys[: FLUSH - n]
                    held[n : n + len(fits)] = fits
                    n, keys = n + len(fits), keys[len(fits) :]
                    if n == FLUSH:
                        held.sort()
                        yield from _by_segment(held, None, n_segments, True)
                        n = 0
        held[:n].sort()
        yield from _by_segment(held[:n], None, n_segments, True)

    return texts.select("text").mapInArrow(run, PACKED)


def _token_rows(counts: DataFrame, n_segments: int) -> DataFrame:
    def run(batches):
        for b in batches:
            hashes = np.array([int(_STOP) if t == END else _token_hash(t) for t in b.column("token").to_pylist()], np.uint64)
            yield from _by_segment(*_summed(_single_keys(hashes), np.asarray(b.column("n"))), n_segments, False)

    return counts.select("token", "n").mapInArrow(run, PACKED)


def _build(group: pa.Table) -> pa.Table:
    """One segment: its filter, and what its pairs say about recurrence."""
    _let_go()
    pairs = np.asarray(whole(group.column("pairs")))
    unpack = lambda name, kind_, mask: np.concatenate([np.frombuffer(x.as_buffer(), kind_) for x, m in zip(group.column(name), mask, strict=True) if m] or [np.zeros(0, kind_)])
    sums = [_summed(unpack("keys", "<u8", mask), unpack("counts", "<i8", mask)) for mask in (pairs, ~pairs)]
    n = sums[0][1]
    keys, counts = (np.concatenate([s[i] for s in sums]) for i in (0, 1))
    del sums
    return pa.table({
        "seg": pa.array([group.column("seg")[0].as_py()], pa.int32()), "filter": pa.array([_built(keys, counts)], pa.binary()),
        "occurrences": pa.array([int(n.sum())], pa.int64()), "recurring": pa.array([int(n[n > 1].sum())], pa.int64()),
    })


def filter_table(texts: DataFrame, counts: DataFrame, n_segments: int) -> DataFrame:
    """``(seg, filter binary, occurrences, recurring)``; a segment holds about ``SEGMENT_TOKENS`` pair occurrences at most."""
    rows = _pair_rows(texts, n_segments).unionByName(_token_rows(counts, n_segments))
    return rows.groupBy("seg").applyInArrow(_build, "seg int, filter binary, occurrences long, recurring long")


def _hot(counts: DataFrame, hot_tokens: int) -> dict[bytes, int]:
    """The tokens of the highest counts: as many count classes (eight to a doubling) as keep within ``hot_tokens`` tokens."""
    ranked = counts.where((F.octet_length("token") <= LONGEST_HOT) & (F.col("token") != F.lit(END))).withColumn("class", F.floor(F.log2("n") * 8))
    chosen, total = None, 0
    for row in sorted(ranked.groupBy("class").count().collect(), reverse=True):  # at most 8 x 63 rows
        total += row["count"]
        if total > hot_tokens:
            break
        chosen = row["class"]
    if chosen is None:
        return {}
    table = ranked.where(F.col("class") >= chosen).select("token", "n").toArrow()
    return dict(zip(table.column("token").to_pylist(), table.column("n").to_pylist(), strict=True))


def _groups(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    out, held = [], 0
    for seg, size in sorted(sizes):
        if not out or held + size > limit:
            out.append([])
            held = 0
        out[-1].append(seg)
        held += size
    return out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_tokens: int = HOT_TOKENS, filter_bytes: int = FILTER_BYTES, segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    base = narrow(docs, id=id_col, text=text_col).withColumn("held_out", held_out_ids("id"))
    training = base.where("NOT held_out")
    counts = materialize(token_counts(training))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("token") == F.lit(END), F.col("n"))), F.lit(0)).alias("texts")).first()
    n, v, texts = size["n"], size["v"] if size["n"] else 0, size["texts"]
    n_segments = max(1, -(-n // segment_tokens))
    table = materialize(filter_table(training, counts, n_segments))
    shares = table.agg(F.sum("occurrences").alias("all"), F.sum("recurring").alias("again")).first()
    weight = min(0.95, max(0.05, (shares["again"] or 0) / max(1, shares["all"] or 0)))
    sizes = [(r["seg"], r["size"]) for r in table.select("seg", F.octet_length("filter").alias("size")).collect()]  # one row a segment
    groups = _groups(sizes, filter_bytes) or [[]]
    hot = spark.sparkContext.broadcast(_hot(counts, hot_tokens))
    state = base.select("id", "text", "held_out", F.lit(None).cast("binary").alias("single"), F.lit(None).cast("binary").alias("pair"))
    for number, segments in enumerate(groups):
        held = {r["seg"]: bytes(r["filter"]) for r in table.where(F.col("seg").isin(segments)).collect()} if segments else {}
        span = [held.get(s, bytes(BLOCK // 8)) for s in range(min(segments, default=0), max(segments, default=-1) + 1)]
        part = spark.sparkContext.broadcast((min(segments, default=0), [len(x) for x in span], b"".join(span), n_segments))
        del held, span
        if number < len(groups) - 1:
            state = materialize(_probed(state, part))
        else:
            scored = _scored(state, part, hot, n, v, texts, weight)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("token"), F.col("r.times").alias("times"))
    known = rest.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"))
    out = scored.drop("rest", "times").join(known, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
    )


_HELD: list = [None, None]


def _let_go() -> None:
    """The filter of an earlier scoring does not stay in a worker that builds another one."""
    _HELD[:] = [None, None]


def _filter_of(broadcast) -> Filter:
    """One filter is kept in a worker process, next to the broadcast value that it reads."""
    if _HELD[0] is not broadcast.value:
        _let_go()
        _HELD[:] = [broadcast.value, Filter(*broadcast.value)]
    return _HELD[1]


def _levels_of(part, words, at, sizes, table: Filter):
    """Tokens, distinct pairs and levels of both, joined with those of earlier groups.

    (Number of each token, number of each token's pair, first and second token of each distinct pair, level of each distinct
    token with the end, level of each distinct pair.)"""
    own, place, before = _hashes(words, at, sizes)
    coded = pa.array(before.astype(np.int64) * len(own) + place).dictionary_encode()
    pair = coded.indices.to_numpy()
    first, second = np.divmod(coded.dictionary.to_numpy(), len(own))
    found = table.level(_single_keys(own[:-1])), table.level(_pair_keys(own[first], own[second]))
    for name, value, number in (("single", found[0], place), ("pair", found[1], pair)):
        old = part.column(name)
        if old.null_count < len(old):
            earlier = np.zeros_like(value)
            earlier[number] = np.frombuffer(b"".join(old.to_pylist()), np.uint8)  # the same wherever a token or pair stands
            np.maximum(value, earlier, out=value)
    return place, pair, first, second, *found


def _probed(state: DataFrame, part_of_filter) -> DataFrame:
    def run(batches):
        table = _filter_of(part_of_filter)
        for b in batches:
            for part, words, at, sizes in _texts(b):
                place, pair, _, _, singles, pairs = _levels_of(part, words, at, sizes, table)
                bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
                columns = {n: pa.array([x[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for n, x in (("single", singles[place]), ("pair", pairs[pair]))}
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text": part.column("text"), "held_out": part.column("held_out"), **columns})

    return state.mapInArrow(run, f"id {kind(state)}, text string, held_out boolean, single binary, pair binary")


def _scored(state: DataFrame, part_of_filter, hot, n: int, v: int, texts: int, weight: float) -> DataFrame:
    def run(batches):
        table, exact = _filter_of(part_of_filter), hot.value
        for b in batches:
            for part, words, at, sizes in _texts(b):
                place, pair, first, second, singles, pairs = _levels_of(part, words, at, sizes, table)
                starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
                token = quantised(singles)
                before = np.append(token, float(texts))[first]  # the start comes as often as there are texts
                alone = np.minimum((token + 1) / (n + v + 1), 1.0)[second]  # a quantised count may exceed its range's total
                both = np.log10(np.where(before > 0, weight * np.minimum(quantised(pairs), before) / np.maximum(before, 1) + (1 - weight) * alone, alone))
                exactly = np.append(np.fromiter(map(exact.get, words, repeat(0)), np.int64, len(words)), texts)
                known, base = exactly > 0, np.log10(exactly + 1.0)
                rest = np.flatnonzero(~np.append(known[:-1], True)[place])
                owner = np.repeat(np.arange(len(sizes)), sizes + 1)
                cells, times = np.unique(owner[rest] * len(words) + place[rest], return_counts=True)
                bounds = np.searchsorted(cells, np.arange(len(sizes) + 1) * max(1, len(words)))
                offsets = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "held_out": part.column("held_out"), "n_tokens": pa.array(sizes + 1),
                    "n_known": pa.array(np.add.reduceat(known.astype(np.int64)[place], starts)), "base": pa.array(np.add.reduceat(base[place], starts)),
                    "score": pa.array(np.add.reduceat(both[pair], starts)),
                    "rest": pa.ListArray.from_arrays(offsets, pa.array([words[c] for c in (cells % max(1, len(words))).tolist()], pa.binary())),
                    "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                })

    schema = f"id {kind(state)}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<binary>, times array<long>"
    return state.mapInArrow(run, schema)
