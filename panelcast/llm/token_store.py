"""Token ids of documents in files from which single documents can be read.

One file holds, one after the other:

* independent zstandard frames, each with the content checksum of the format, of 65,536
  little-endian unsigned 32-bit ids (the last one fewer);
* a skippable frame with the document index: zstandard-compressed n_tokens and ids of the documents;
* a skippable frame with the seek table: for each data frame its compressed size, its plain
  size and the low 32 bits of the xxhash64 of its plain bytes, then a fixed footer.

Any zstandard decoder reads the plain stream; a reader of this module reads the seek table
and the index from the end and decompresses only the frames that hold the wanted documents.

Documents are dealt out in ranges of ascending id (null ids first; rows of the same id in
the order of a hash of their text), so the files in order are the whole corpus in order. Each task
attempt writes files of its own names, each of at most ``FILE_DOCS`` documents and about
``FILE_IDS`` ids, and reports them; only reported files are in the manifest, a small table in
the same folder, so that lost executors and repeated attempts leave the set intact. Null texts count as empty and hold the end id alone. Repeated rows are
kept. Only id and text are read.

Words are encoded by the tokenizers library. White space after a character that is not white
space always starts a new match of the library's splitting pattern, and so does what follows
a line break, if it is not white space. Texts are cut there, and the pieces, most of which
recur, are encoded once each and remembered. In a text of lines with single spaces between
words, that is each word; other texts are cut less finely. A text that holds the string of an
added token goes to the library whole, which gives that token's id for it.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelcast.llm.common import narrow
from panelcast.session import scratch_path

FRAME = 1 << 16  # ids in a frame
FILE_DOCS, FILE_IDS = 1 << 18, 1 << 26  # a file is closed when it holds as many
REMEMBERED = 400_000  # pieces of text kept with their ids in a worker, twice at most
LONGEST_REMEMBERED = 64  # characters of such a piece
_SKIP_INDEX, _SKIP_SEEK, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_HEAD = struct.Struct("<II")
_FOOT = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_LOADED: dict[str, "PieceEncoder"] = {}


#: The byte alphabet of the vocabulary: printable Latin-1 characters stand for themselves, the other bytes for 256 and on, in order.
_BYTES = dict(zip([b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)], range(256, 512)))


class _Pieces(dict):
    """Ids of pieces, each after ``before``; encoded by the library when first asked for. A full table becomes the older one, from which pieces that come again are taken over."""

    def __init__(self, library, before: str, room: int):
        super().__init__()
        self._library, self._model, self._before, self._room, self._older = library, library.model, before, room, {}
        self._marks: dict[str, bytes] = {}
        self._mark = before.encode().decode("latin-1").translate(_BYTES)

    def __missing__(self, piece: str) -> bytes:
        ids = self._older.get(piece)
        if ids is None:
            ids = self._new(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self._room:
                self._older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _new(self, piece: str) -> bytes:
        stem = piece.rstrip(_MARKS)
        if piece.isalpha() and max(piece) < "\u0250":  # letters are one match: straight to the library's model
            return array("I", [t.id for t in self._model.tokenize(self._mark + piece.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        if stem and len(stem) < len(piece) and stem[-1] < "\u0250" and stem[-1].isalpha():
            marks = piece[len(stem) :]  # marks after a letter always start a match
            return self[stem] + (self._marks.get(marks) or self._marks.setdefault(marks, self._plain(marks)) if len(marks) < 3 else self._plain(marks))
        return self._plain(self._before + piece)

    def _plain(self, text: str) -> bytes:
        return array("I", self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


class PieceEncoder:
    """Ids of whole texts as little-endian bytes."""

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_path)
        added = sorted((re.escape(t.content) for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._added = re.compile("|".join(added)).search if added else lambda text: None
        self._after_space, self._bare = _Pieces(library, " ", remembered), _Pieces(library, "", remembered // 4)
        self._break = self._bare["\n"]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        if self._added(text):
            return self._bare._plain(text)
        out: list[bytes] = []
        lines = text.split("\n")
        for line in lines:
            if not line.isprintable() or "  " in line or not line or line[0] == " " or line[-1] == " ":
                return b"".join([self._bare[p] for p in _cut(text)])
            first, *rest = line.split(" ")
            out.append(self._bare[first])
            out += map(self._after_space.__getitem__, rest)
            out.append(self._break)
        out.pop()
        return b"".join(out)


_MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))


def _cut(text: str) -> list[str]:
    """A text with other white space than single spaces and line breaks, cut only before spaces and breaks that follow another character."""
    parts = re.split(r"([ \n])", text)
    out = [parts[0]]
    for white, part in zip(parts[1::2], parts[2::2], strict=True):
        if out[-1] and not out[-1][-1].isspace():
            out.append(white + part)
        else:
            out[-1] += white + part
    return out if out[0] else out[1:]


def encoder(path: str) -> PieceEncoder:
    """Loaded once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


class Writer:
    """Writes one file; documents are added in order."""

    def __init__(self, out, frame: int = FRAME, level: int = 1):
        self._out, self._frame = out, frame * 4
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._waiting: list[bytes] = []
        self._held = 0
        self._entries: list[tuple[int, int, int]] = []
        self._sizes: list[int] = []
        self._ids: list[int | None] = []
        self.n_tokens = 0

    def __len__(self) -> int:
        return len(self._sizes)

    def add(self, ids: bytes, document: int | None = None) -> None:
        self._sizes.append(len(ids) // 4)
        self._ids.append(document)
        self.n_tokens += len(ids) // 4
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= self._frame:
            plain = memoryview(b"".join(self._waiting))
            whole = len(plain) // self._frame * self._frame
            for at in range(0, whole, self._frame):
                self._write_frame(plain[at : at + self._frame])
            self._waiting, self._held = [bytes(plain[whole:])], len(plain) - whole

    def _write_frame(self, plain) -> None:
        packed = self._zstd.compress(plain)
        self._out.write(packed)
        self._entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> int:
        """Writes what is left, the index and the seek table; returns the number of ids."""
        if self._held:
            self._write_frame(b"".join(self._waiting))
        known = np.array([i is not None for i in self._ids], np.uint8).tobytes()
        index = self._zstd.compress(np.array([self._sizes, [i or 0 for i in self._ids]], "<i8").tobytes() + known)
        self._out.write(_HEAD.pack(_SKIP_INDEX, len(index) + 8) + index + struct.pack("<Q", len(index)))
        table = np.array(self._entries, _ENTRY).tobytes()
        self._out.write(_HEAD.pack(_SKIP_SEEK, len(table) + _FOOT.size) + table + _FOOT.pack(len(self._entries), 0x80, _SEEKABLE))
        return self.n_tokens


class Reader:
    """Random access to the documents of one file (an object with ``seek``, ``tell`` and ``read``)."""

    def __init__(self, file):
        self._file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - _FOOT.size)
        n, flags, magic = _FOOT.unpack(file.read(_FOOT.size))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        at = end - _FOOT.size - n * _ENTRY.itemsize
        file.seek(at)
        self._entries = np.frombuffer(file.read(n * _ENTRY.itemsize), _ENTRY)
        file.seek(at - _HEAD.size - 8)
        size = struct.unpack("<Q", file.read(8))[0]
        file.seek(at - _HEAD.size - 8 - size)
        self._zstd = zstandard.ZstdDecompressor()
        index = self._zstd.decompress(file.read(size))
        documents = len(index) // 17
        self.n_tokens, self.ids = np.frombuffer(index, "<i8", 2 * documents).reshape(2, documents).astype(np.int64)
        self.known = np.frombuffer(index, np.uint8, documents, 16 * documents).astype(bool)
        self._begin = np.concatenate([[0], np.cumsum(self.n_tokens)]) * 4
        self._packed = np.concatenate([[0], np.cumsum(self._entries["packed"], dtype=np.int64)])
        self._plain = np.concatenate([[0], np.cumsum(self._entries["plain"], dtype=np.int64)])
        self._last: tuple[int, bytes] = (-1, b"")

    def __len__(self) -> int:
        return len(self.n_tokens)

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self._file.seek(int(self._packed[k]))
            plain = self._zstd.decompress(self._file.read(int(self._entries["packed"][k])), max_output_size=int(self._entries["plain"][k]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self._entries["check"][k]):
                raise ValueError(f"frame {k} does not have the checksum of the seek table")
            self._last = (k, plain)
        return self._last[1]

    def read(self, document: int) -> bytes:
        """Ids of one document, as bytes; only its frames are decompressed."""
        begin, end = int(self._begin[document]), int(self._begin[document + 1])
        parts = []
        k = int(np.searchsorted(self._plain, begin, side="right")) - 1
        while begin < end:
            stop = min(end, int(self._plain[k + 1]))
            parts.append(self._frame(k)[begin - int(self._plain[k]) : stop - int(self._plain[k])])
            begin, k = stop, k + 1
        return b"".join(parts)


def _store(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs.LocalFileSystem(), folder


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME, file_docs: int = FILE_DOCS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write; returns the manifest ``(file, part, name, n_docs, n_tokens, start)`` in file order."""
    spark = docs.sparkSession
    base = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("tie"))
    dealt = base.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches):
        codes, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        store, root = _store(folder)
        task, part, writer, stream, name = TaskContext.get().partitionId(), 0, None, None, ""

        def closed():
            n = writer.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"file": pa.array([task], pa.int32()), "part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([len(writer)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for i, x in zip(some.column("id").to_pylist(), codes.encode([t or "" for t in some.column("text").to_pylist()]), strict=True):
                    if writer is not None and (len(writer) >= file_docs or writer.n_tokens >= file_ids):
                        yield closed()
                        writer, part = None, part + 1
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        name = f"ids-{task:06d}-{part:04d}-{uuid.uuid4().hex}.zst"
                        stream = store.open_output_stream(f"{root}/{name}", compression=None)
                        writer = Writer(stream, frame)
                    writer.add(x + end, i)
        if writer is not None:
            yield closed()

    path = f"{folder}/manifest"
    dealt.mapInArrow(run, "file int, part int, name string, n_docs long, n_tokens long").write.parquet(path)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files in order with the ids before each; one row a file, so the running total is over few rows."""
    rows = spark.read.parquet(f"{folder}/manifest")
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document as read back from the files: ``(id, start, n_tokens, ids_crc32)``."""
    return _read(manifest(spark, folder), folder, id_col, "start long, n_tokens long, ids_crc32 long", lambda start, ids: (start, len(ids) // 4, zlib.crc32(ids)))


def _tasks(spark: SparkSession) -> int:
    """Rows that name files are small, their files are not: they are dealt out in a fixed number, which is not merged again."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _read(files: DataFrame, folder: str, id_col: str, fields: str, row) -> DataFrame:
    names = [f.split()[0] for f in fields.split(",")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in fields.split(",")]

    def run(batches):
        store, root = _store(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    reader = Reader(f)
                    starts = (start + np.concatenate([[0], np.cumsum(reader.n_tokens)])).tolist()
                    for at in range(0, len(reader), 1024):
                        many = range(at, min(at + 1024, len(reader)))
                        rows = [row(starts[i], reader.read(i)) for i in many]
                        columns = {"id": pa.array(reader.ids[many.start : many.stop], mask=~reader.known[many.start : many.stop])}
                        columns |= {n: pa.array(v, t) for n, t, v in zip(names, types, zip(*rows, strict=True), strict=True)}
                        yield pa.RecordBatch.from_pydict(columns)

    spread = files.select("name", "start").repartition(_tasks(files.sparkSession), "name")
    return spread.mapInArrow(run, f"id long, {fields}").withColumnRenamed("id", id_col)


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, ids binary)`` of the wanted ids only; other frames are not decompressed.

    Wanted ids are joined to the indexes of the files; unknown and null ids give no row, an
    id that stands on several rows gives one row for each.
    """
    index = spark.read.parquet(f"{folder}/manifest").select("name").repartition(_tasks(spark), "name").mapInArrow(_positions(folder), "name string, at long, id long")
    asked = narrow(wanted, id=id_col).select(F.col("id").cast("long").alias("id")).distinct()
    found = index.join(asked, "id").repartition(_tasks(spark), "name").sortWithinPartitions("name", "at")

    def run(batches):
        store, root = _store(folder)
        held = ("", None, None)
        for b in batches:
            out = []
            for name, at in zip(b.column("name").to_pylist(), b.column("at").to_pylist(), strict=True):
                if held[0] != name:
                    f = store.open_input_file(f"{root}/{name}")
                    held = (name, f, Reader(f))
                out.append(held[2].read(at))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "ids": pa.array(out, pa.binary())})

    return found.select("id", "name", "at").mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def _positions(folder: str):
    def run(batches):
        store, root = _store(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    reader = Reader(f)
                at = np.flatnonzero(reader.known)
                yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(at), pa.string()), "at": pa.array(at), "id": pa.array(reader.ids[at])})

    return run


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to the shared folder and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    write(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read(spark, folder, id_col)
