"""Byte-level BPE as a tree reduction over the text.

Encoded pieces of text form a monoid: a long text is halved until a piece is short,
the pieces are encoded, and neighbours are joined. A join re-encodes a window around
the seam, growing on either side until it begins and ends at a *stable point*; tokens
outside the window cannot change.

Why a stable point is stable: a white-space character after a character that is not
white space always begins a new match of the splitting pattern. No alternative of the
pattern holds white space after other characters, and the look-ahead of the pattern
only follows white space, so what stands before the point is matched the same with
and without what follows. Merges never cross matches.

Null text counts as empty; an empty text has no tokens. Rows keep their multiplicity;
a null id stays null. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.common import kind, narrow

LEAF = 4096  # characters of a piece that is encoded at once, ids of one that is decoded at once
WINDOW = 64  # characters on either side of a seam that are tried first
_SPACES = " \n\t\r"
_LOADED: dict[tuple[str, str], "TreeCodec"] = {}


class TreeCodec:
    """Tree encoder and decoder over one rank file."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._size = np.array([len(token) for token in self._bytes])
        self._leaf, self._window = max(1, leaf), max(1, window)

    def _piece(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)

    def encode(self, text: str) -> np.ndarray:
        return self._span(text, 0, len(text))

    def _span(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self._leaf:
            return self._piece(text[start:end])
        seam = (start + end) // 2
        return self._join(text, start, seam, end, self._span(text, start, seam), self._span(text, seam, end))

    def _join(self, text: str, start: int, seam: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        first = self._stable_before(text, start, seam)
        last = self._stable_after(text, seam, end)
        kept = self._cut(left[::-1], len(text[first:seam].encode()))
        dropped = self._cut(right, len(text[seam:last].encode()))
        return np.concatenate([left[: len(left) - kept], self._piece(text[first:last]), right[dropped:]])

    def _stable_before(self, text: str, start: int, seam: int) -> int:
        reach = self._window
        while seam - reach > start:
            for at in range(seam - 1, seam - reach, -1):
                if _stable(text, at):
                    return at
            reach *= 2
        for at in range(min(seam - 1, seam - reach // 2), start, -1):
            if _stable(text, at):
                return at
        return start

    def _stable_after(self, text: str, seam: int, end: int) -> int:
        reach = self._window
        low = seam + 1
        while low < end:
            high = min(end, seam + reach)
            for at in range(low, high):
                if _stable(text, at):
                    return at
            low, reach = max(low, high), reach * 2
        return end

    def _cut(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading ids make up exactly ``n_bytes``."""
        n, done, reach = 0, 0, 64
        while done < n_bytes:
            sizes = np.cumsum(self._size[ids[n : n + reach]])
            inside = int(np.searchsorted(sizes, n_bytes - done, side="right"))
            if inside == 0:
                raise AssertionError("a token crosses a stable point")
            done, n, reach = done + int(sizes[inside - 1]), n + inside, reach * 2
        return n

    def decode(self, ids: np.ndarray) -> bytes:
        """Leaves are looked up and concatenated up the tree."""
        if len(ids) <= self._leaf:
            return b"".join(map(self._bytes.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _stable(text: str, at: int) -> bool:
    return text[at] in _SPACES and not text[at - 1].isspace()


def codec(ranks_path: str, pattern: str) -> TreeCodec:
    """Loaded once in each worker process."""
    key = (ranks_path, pattern)
    if key not in _LOADED:
        _LOADED[key] = TreeCodec(ranks_path, pattern)
    return _LOADED[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` for every row; with ``verify`` ids that do not decode to their text are an error."""
    base = narrow(docs, id=id_col, text=text_col)

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            for part in _slices(b):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [c.encode(t) for t in texts]
                if verify and any(c.decode(i) != t.encode() for i, t in zip(ids, texts, strict=True)):
                    raise ValueError("ids do not decode to their text")
                sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "ids": pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))})

    return base.mapInArrow(run, f"id {kind(base)}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text_bytes)``; null ids decode to no bytes."""
    base = narrow(encoded, id=id_col, ids=ids_col)

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            values = [c.decode(np.asarray(x or [], dtype="<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "text_bytes": pa.array(values, pa.binary())})

    return base.mapInArrow(run, f"id {kind(base)}, text_bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding again, row by row: ``(id, n_tokens, ids_sha256, decoded_sha256)``; no shuffle."""
    base = narrow(docs, id=id_col, text=text_col)

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string()),
            })

    return base.mapInArrow(run, f"id {kind(base)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _slices(b: pa.RecordBatch, rows: int = 256):
    """Short slices, so that the ids of few texts are held at once."""
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)
