"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda, and decoding.

The normalised text is a chain of symbols, one a character. Every adjacent pair whose
concatenation is in the vocabulary stands on an agenda; the pair of the highest score is
merged first (of equal scores the leftmost), its new neighbours join the agenda, and pairs
whose symbols have changed meanwhile are passed over. Symbols outside the vocabulary become
the ids of their bytes, or the unknown id where the vocabulary has no byte pieces.

If no piece holds the space mark after another character, no merge crosses from a character
to a following space mark: such stretches are encoded by themselves and kept in a bounded
table, as most words come again. A new stretch also falls apart between marks (digits,
punctuation, line breaks) that no piece joins to other characters and those. Other
vocabularies run one agenda over the whole text.

The stretches of several texts are numbered together, so that each distinct one is looked up
once. New short ones are encoded together: each is a row of symbols, and in each round every
row merges the pair that comes first on its own agenda.

Each Arrow batch is checked against the sentencepiece library on its whole texts; ids that
differ are an error that names the rows. Vocabularies of another type fail that check.

Null text counts as empty; an empty text has the end id alone. Rows keep their multiplicity
and null ids stay null. Only id and text are read, so further columns cannot clash. Texts
of any length are encoded whole, in time n log n. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.common import kind, narrow, slices

SPACE = "▁"
KEPT = 1 << 19  # stretches kept in a worker, twice at most, each of at most KEPT_LENGTH characters: some 250 MB
KEPT_LENGTH = 64
SHORT = 48  # characters up to which the agenda is a list instead of a heap
_NEVER = float("inf")
_GOLD = np.uint64(0x9E3779B97F4A7C15)  # 2^64 by the golden ratio
ROWS, BYTES = 1024, 4 << 20  # rows encoded and checked at once, and bytes of text unless one row has more
TOGETHER = 4096  # new stretches encoded at once
_LOADED: dict[str, "PieceCodec"] = {}


class _Kept(dict):
    """Ids by stretch. A full table becomes the older one, from which stretches that come again are taken over."""

    def __init__(self, make, most: int, parts=None):
        self._make, self._most, self._older, self._parts = make, most, {}, parts

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        ids = self._older.get(stretch)
        if ids is None:
            # the garbage collector does not walk tuples of numbers again and again
            if self._parts and len(parts := self._parts(stretch)) > 1:
                ids = tuple(chain.from_iterable(map(self.__getitem__, parts)))
            else:
                ids = tuple(self._make(stretch))
        if len(stretch) <= KEPT_LENGTH:
            self.put(stretch, ids)
        return ids

    def put(self, stretch: str, ids: tuple[int, ...]) -> None:
        if len(self) >= self._most:
            self._older = dict(self)
            self.clear()
        self[stretch] = ids

    def put_all(self, stretches: list[str], ids: list[tuple[int, ...]]) -> None:
        if len(self) + len(stretches) > self._most:
            self._older = dict(self)
            self.clear()
        self.update(zip(stretches, ids, strict=True))

    def lacking(self, stretches: list[str]) -> set[str]:
        """Those, or their parts, that are in neither table."""
        older, parts = self._older, self._parts
        new = [s for s in stretches if s not in older]
        whole = {s for s in new if not parts or s.lstrip(SPACE).isalpha()}  # letters are no marks
        return whole.union(p for s in new if s not in whole for p in parts(s) if p not in self and p not in older)


def _numbered(texts: list[bytes], marks: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches of normalised texts, the number of each stretch in order, and where each text begins among them.

    Stretches begin with their space marks and fall apart between characters that are ``marks`` and others, of those below U+0800."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    a, b, c = SPACE.encode()
    at = np.flatnonzero(data[:-2] == a)
    at = at[(data[at + 1] == b) & (data[at + 2] == c)]
    begins = np.zeros(len(data) + 1, bool)
    mark = np.append(marks[:128], np.zeros(128, bool))[data]
    two = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    mark[two] = mark[two + 1] = marks[((data[two] & 31).astype(np.int64) << 6) | (data[two + 1] & 63)]
    begins[1:-1] = mark[1:] != mark[:-1]
    more = np.flatnonzero(data >= 0xE0)
    begins[more] = begins[more + 3 + (data[more] >= 0xF0)] = False
    begins[at] = True
    begins[at + len(SPACE.encode())] = False
    begins[first[:-1]] = True
    starts = np.flatnonzero(begins[:-1])
    stretches = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(joined)).dictionary_encode()
    return stretches.dictionary.to_numpy(zero_copy_only=False).tolist(), stretches.indices.to_numpy().astype(np.int64), np.searchsorted(starts, first)


class PieceCodec:
    """Agenda encoder over one model file; the library normalises, checks and decodes."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(lib.get_piece_size())]
        self._ids = {lib.id_to_piece(i): i for i, s in enumerate(special) if not s}
        # the agenda takes the smallest first
        self._cost = {piece: -lib.get_score(i) for piece, i in self._ids.items() if not lib.is_unused(i)}
        byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._bytes = byte_ids if all(map(lib.is_byte, byte_ids)) else None
        self._unknown, self.end = lib.unk_id(), lib.eos_id()
        self._apart = all(SPACE not in piece.lstrip(SPACE) for piece in self._cost)
        self._stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        marks = self._marks()
        self._mark = np.zeros(0x800, bool)
        self._mark[[ord(c) for c in marks if ord(c) < 0x800]] = True
        marks = re.escape("".join(marks))
        runs = re.compile(f"{SPACE}*[{marks}]+|[^{marks}]+").findall if marks else None
        self._kept = _Kept(self.agenda, KEPT, runs)
        self._table()
        self.names = list(map(str, range(lib.get_piece_size())))

    def _marks(self) -> list[str]:
        """Characters other than letters that no piece has next to anything but each other and the space mark."""
        marks = {c for c in chain(map(chr, range(1, 128)), *self._cost) if not c.isalpha() and c != SPACE}
        while True:
            pairs = [pair for piece in self._cost for pair in zip(piece, piece[1:], strict=False) if SPACE not in pair]
            out = {c for pair in pairs if (pair[0] in marks) != (pair[1] in marks) for c in pair if c in marks}
            if not out:
                return sorted(marks)
            marks -= out

    def _table(self) -> None:
        """Numbers of symbols; pairs of symbols and what they make, by number."""
        letters = sorted(set(chain.from_iterable(self._cost)))
        number = {symbol: i for i, symbol in enumerate(dict.fromkeys(chain(letters, self._cost)))}
        n = len(number)
        made = [(number[a] * n + number[b], number[piece]) for piece in self._cost for i in range(1, len(piece)) if (a := piece[:i]) in number and (b := piece[i:]) in number]
        self._hashed(*np.array(made, np.int64).reshape(-1, 2).T)
        costs = np.array([self._cost.get(symbol, _NEVER) for symbol in number] + [_NEVER])  # the last one: no pair
        self._costs = np.unique(costs, return_inverse=True)[1].astype(np.int32)
        self._numbers = np.array([self._ids.get(symbol, -1) for symbol in number] + [-1], np.int64)
        self._letters = np.full(0x110000, -1, np.int32)
        self._letters[list(map(ord, letters))] = np.arange(len(letters))

    def _hashed(self, pairs: np.ndarray, made: np.ndarray) -> None:
        """Pairs by hash, each in the first free slot from its own on; free ones hold -1."""
        bits = max(4, (8 * len(pairs)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._pairs, self._made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._slot(pairs)
        while len(pairs):
            free = self._pairs[at] == -1
            _, first = np.unique(at, return_index=True)  # one pair a slot
            lands = np.zeros(len(at), bool)
            lands[first] = True
            lands &= free
            self._pairs[at[lands]], self._made[at[lands]] = pairs[lands], made[lands]
            pairs, made, at = pairs[~lands], made[~lands], (at[~lands] + 1) & (len(self._pairs) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _GOLD) >> self._shift).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair makes, or -1."""
        pairs = left.astype(np.int64) * (len(self._numbers) - 1) + right
        pairs[(left < 0) | (right < 0)] = -1
        at = self._slot(pairs)
        there = self._pairs[at]
        open_ = np.flatnonzero((there != pairs) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self._pairs) - 1)
            there = self._pairs[at[open_]]
            open_ = open_[(there != pairs[open_]) & (there != -1)]
        return self._made[at]

    def together(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """Ids of stretches by one agenda a row: the first smallest entry of a row is its next pair."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        width = int(sizes.max(initial=0)) + 2  # a row's symbols stand between two columns without any
        symbols = np.full((len(stretches), width), -1, np.int32)
        column = np.arange(width)
        symbols[(column > 0) & (column <= sizes[:, None])] = self._letters[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)]
        made = np.full_like(symbols, -1)
        made[:, :-1] = self._pair(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(stretches), -1)
        cost = self._costs[made]
        # places are counted through all rows; a symbol that was merged into its left neighbour is passed over
        after = np.arange(1, symbols.size + 1)
        before = after - 2
        flat, entries, costs, never = symbols.ravel(), made.ravel(), cost.ravel(), self._costs[-1]
        row = np.arange(len(stretches))
        while len(row):
            place = cost[row].argmin(1) + row * width
            some = costs[place] != never
            row, place = row[some], place[some]
            sizes[row] -= 1
            new, right = entries[place], after[place]
            flat[place], flat[right], costs[right] = new, -1, never
            behind, ahead = after[right], before[place]
            after[place], before[behind] = behind, place
            for at, pair in ((place, self._pair(new, flat[behind])), (ahead, self._pair(flat[ahead], new))):
                entries[at], costs[at] = pair, self._costs[pair]
        ids = self._numbers[symbols]
        here = ids >= 0
        numbers = here.sum(1)
        ends = np.cumsum(numbers).tolist()
        ids, known = ids[here].tolist(), (numbers == sizes).tolist()  # others hold symbols outside the vocabulary
        return [tuple(ids[a:b]) if k else tuple(self.agenda(s)) for s, a, b, k in zip(stretches, [0, *ends], ends, known, strict=False)]

    def _learn(self, stretches: list[str]) -> None:
        new = sorted((s for s in self._kept.lacking(stretches) if len(s) <= SHORT), key=len)  # rows of similar length
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            self._kept.put_all(part, self.together(part))

    def _all(self, texts: list[str]) -> list[list[int]]:
        """``encode`` of each text with the end id."""
        if not self._apart:
            return list(map(self.encode, texts))
        kept = self._kept
        distinct, place, bounds = _numbered([self.library.normalize(t).encode() for t in texts], self._mark)
        found = list(map(kept.get, distinct))
        open_ = [i for i, ids in enumerate(found) if ids is None]
        self._learn([distinct[i] for i in open_])
        for i in open_:
            found[i] = kept[distinct[i]]
        # the end stands after the distinct stretches, and behind each text
        found.append((self.end,))
        place = np.insert(place, bounds[1:], len(distinct))
        bounds += np.arange(len(bounds))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        own = sizes[place]
        until = np.cumsum(own)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[place] - until + own, own) + np.arange(until[-1] if len(until) else 0)].tolist()
        ends = until[bounds[1:] - 1].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str, end: bool = True) -> list[int]:
        normal = self.library.normalize(text)
        if self._apart:
            out = list(chain.from_iterable(map(self._kept.__getitem__, self._stretches(normal))))
        else:
            out = self.agenda(normal)
        if end:
            out.append(self.end)
        return out

    def agenda(self, text: str) -> list[int]:
        """Ids of one normalised stretch."""
        return self._as_ids(self._short(text) if len(text) <= SHORT else self._long(text))

    def _short(self, text: str) -> list[str]:
        """The agenda of a short stretch is a list in the order of the text: its first smallest entry is the next pair."""
        symbols, cost = list(text), self._cost
        waiting = [cost.get(text[i : i + 2], _NEVER) for i in range(len(text) - 1)]
        while waiting and (best := min(waiting)) != _NEVER:
            i = waiting.index(best)
            symbols[i] += symbols.pop(i + 1)
            del waiting[i]
            if i < len(waiting):
                waiting[i] = cost.get(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                waiting[i - 1] = cost.get(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def _long(self, text: str) -> list[str]:
        """The agenda is a heap; entries whose symbols have changed meanwhile are passed over."""
        symbols: list[str] = list(text)
        n, cost = len(symbols), self._cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(cost[pair], i, i + 1, pair) for i in range(n - 1) if (pair := text[i : i + 2]) in cost]
        heapq.heapify(waiting)
        while waiting:
            _, left, right, pair = heapq.heappop(waiting)
            # a symbol that was merged into its left neighbour is empty, one that grew is longer
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = behind = after[right]
            if behind < n:
                before[behind] = left
                if (new := pair + symbols[behind]) in cost:
                    heapq.heappush(waiting, (cost[new], left, behind, new))
            if (ahead := before[left]) >= 0 and (new := symbols[ahead] + pair) in cost:
                heapq.heappush(waiting, (cost[new], ahead, left, new))
        return list(filter(None, symbols))

    def _as_ids(self, symbols: list[str]) -> list[int]:
        out = list(map(self._ids.get, symbols))
        if None not in out:
            return out
        out = []
        for symbol in symbols:
            if (i := self._ids.get(symbol)) is not None:
                out.append(i)
            elif self._bytes is not None:
                out += [self._bytes[b] for b in symbol.encode()]
            elif not out or out[-1] != self._unknown:  # a run of unknown symbols is one id
                out.append(self._unknown)
        return out

    def checked(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts with the end id, equal to the library's."""
        got = self._all(texts)
        want = self.library.encode(texts, add_eos=True, num_threads=1)
        if got != want:
            raise ValueError(f"the agenda differs from the library in rows {[i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b][:10]} of a batch")
        return got

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def codec(model_path: str) -> PieceCodec:
    """Loaded once in each worker process."""
    if model_path not in _LOADED:
        _LOADED[model_path] = PieceCodec(model_path)
    return _LOADED[model_path]


def _parts(batches):
    for b in batches:
        yield from slices(b, b.schema.names[1], ROWS, BYTES)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row, the end id last."""
    base = narrow(docs, id=id_col, text=text_col)

    def run(batches):
        c = codec(model_path)
        for part in _parts(batches):
            ids = c.checked([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return base.mapInArrow(run, f"id {kind(base)}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)``; null ids decode to an empty text."""
    base = narrow(encoded, id=id_col, ids=ids_col)

    def run(batches):
        c = codec(model_path)
        for part in _parts(batches):
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text": pa.array([c.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())})

    return base.mapInArrow(run, f"id {kind(base)}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding again, row by row: ``(id, n_tokens, ids_sha256, decoded_sha256)``."""
    base = narrow(docs, id=id_col, text=text_col)

    def run(batches):
        c = codec(model_path)
        sha = hashlib.sha256
        for part in _parts(batches):
            ids = c.checked([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"),
                "n_tokens": pa.array(np.fromiter(map(len, ids), np.int64, len(ids))),
                "ids_sha256": pa.array([sha(" ".join(map(c.names.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([sha(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            })

    return base.mapInArrow(run, f"id {kind(base)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
