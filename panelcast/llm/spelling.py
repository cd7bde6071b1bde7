"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Words at one edit have reduced words that are
equal or at one edit, so every reduced word's neighbourhood is generated and joined with the
reduced vocabulary; what meets is verified on the original words. A pair is generated once:
an insertion into one word is a deletion from the other, and a replaced symbol is generated
from the larger to the smaller one, so both words together cover the whole neighbourhood.

Reduced words and their neighbours are 64-bit polynomial hashes (a deletion or replacement
is a shift of prefix and suffix sums), so a word of L letters costs time and rows in
proportion to L, not L x L; collisions only add candidates. Rows carry the word itself; words
over ``LONG`` letters travel as a hash and are looked up again for the verification.

Counting pre-aggregates in each batch. Words of n occurrences, their near words and the
near word of the largest count come from one grouping. Roots follow forms step by step;
counts grow tenfold each time, so the steps are at most the digits of the largest count.

Null text has no words; a null id counts as an empty string in the rule that damages words.
Repeated rows are counted as often as they come. Only id and text are read. An empty table
gives no rows. Texts and words of any length are handled whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import narrow
from panelcast.session import materialize

SYMBOLS = 5
LONG = 64
LEAST_LENGTH, LEAST_COUNT, LIFT, DAMAGE = 7, 2, 10, 31
_HELD = 1 << 18  # distinct words, or 64 times as many letters, counted in a task before they are given out
_CELLS = 1 << 17  # symbols whose neighbourhoods are made at once
_RANDOM = np.random.default_rng(12)
_VALUES = _RANDOM.integers(0, 1 << 64, SYMBOLS, np.uint64)
_BASE, _LENGTH = (_RANDOM.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)).tolist()
_BACK = pow(_BASE, -1, 1 << 64)


def damaged(word: str, crc: int) -> str:
    """The rule of the query: where ``DAMAGE`` divides the number, one letter is missing."""
    at = crc % len(word)
    return word if crc % DAMAGE else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule=damaged) -> DataFrame:
    """``(word, n)`` of all words of at least ``LEAST_LENGTH`` letters; ``rule`` turns a run and its crc32 into a word."""
    base = narrow(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    # a shorter run cannot become a long enough word
    runs = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}").findall

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches):
        counts, letters = Counter(), 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                start = zlib.crc32(f"{i}:".encode())
                for word, n in Counter(runs((text.as_py() or "").encode().lower().decode())).items():  # bytes: A-Z only
                    word = rule(word, zlib.crc32(word.encode(), start))
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                        letters += len(word)
                if len(counts) >= _HELD or letters >= 64 * _HELD:
                    yield batch(counts)
                    counts, letters = Counter(), 0
        yield batch(counts)

    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def reduce_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in a row, and where each word begins."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    symbols = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(SYMBOLS)
    return symbols.astype(np.int64), np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def _groups(words: list[str]):
    """``(places, symbols)``: words of one length as a matrix of bounded size."""
    symbols, starts = reduce_words(words)
    lengths = np.diff(starts)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, _CELLS // max(1, int(length)))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, symbols[starts[some][:, None] + np.arange(length)]


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _BASE, np.uint64))])[:n]


def _hashes(matrix: np.ndarray) -> np.ndarray:
    return (_VALUES[matrix] * _powers(matrix.shape[1])).sum(1, dtype=np.uint64) + np.uint64(matrix.shape[1] * _LENGTH & (1 << 64) - 1)


def neighbours(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, same)``: hashes of each reduced word itself, of it less one symbol, and with one symbol made smaller."""
    m, length = matrix.shape
    powers = _powers(length)
    terms = _VALUES[matrix] * powers
    upto = np.cumsum(terms, 1, dtype=np.uint64)
    whole = _hashes(matrix)
    rows, keys = [np.arange(m)], [whole]
    # of a run of equal symbols, any one less is the same word
    first = np.hstack([np.ones((m, 1), bool), matrix[:, 1:] != matrix[:, :-1]]) if length else np.zeros((m, 0), bool)
    total = upto[:, -1:] if length else np.zeros((m, 1), np.uint64)
    shorter = (upto - terms) + (total - upto) * np.uint64(_BACK) + np.uint64((length - 1) * _LENGTH & (1 << 64) - 1)
    rows.append(np.nonzero(first)[0])
    keys.append(shorter[first])
    for s in range(SYMBOLS - 1):
        larger = matrix > s
        replaced = whole[:, None] + (_VALUES[s] - _VALUES[matrix]) * powers
        rows.append(np.nonzero(larger)[0])
        keys.append(replaced[larger])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    same = np.zeros(len(rows), bool)
    same[:m] = True
    return rows, keys, same


def _codes(batches):
    for b in batches:
        words = b.column("word").to_pylist()
        key = np.zeros(len(words), np.uint64)
        for places, matrix in _groups(words):
            key[places] = _hashes(matrix)
        yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "other": b.column("word"), "other_n": b.column("n")})


def _spread(batches):
    """``(key, same, name, n)``: the neighbourhood of each word under the name it travels by."""
    for b in batches:
        for places, matrix in _groups(b.column("word").to_pylist()):
            for at in range(0, len(places), step := max(1, _CELLS // max(1, matrix.shape[1]))):
                rows, keys, same = neighbours(matrix[at : at + step])
                back = pa.array(places[at : at + step][rows])
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "same": pa.array(same), "name": b.column("name").take(back), "n": b.column("n").take(back)})


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``, once for each pair of ``(word, n)`` rows that is one edit apart; words must be distinct."""
    codes = words.mapInArrow(_codes, "key long, other string, other_n long")
    once = ~F.col("same") | (F.col("word") < F.col("other"))
    one_edit = F.levenshtein("word", "other", 1) == 1
    short = words.where(F.length("word") <= LONG).select("word", "n", F.col("word").alias("name"))
    met = short.mapInArrow(_spread, "key long, same boolean, name string, n long").withColumnRenamed("name", "word").join(codes, "key")
    found = met.where(once & one_edit).select("word", "n", "other", "other_n")
    long = words.where(F.length("word") > LONG).withColumn("name", F.xxhash64("word"))
    ids = long.mapInArrow(_spread, "key long, same boolean, name long, n long")
    long_codes = codes.where(F.length("other") >= LONG).select("key", F.xxhash64("other").alias("other_name"))
    pairs = ids.join(long_codes, "key").select("name", "other_name", "same").distinct()
    others = words.where(F.length("word") >= LONG).select(F.xxhash64("word").alias("other_name"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    back = pairs.join(long.select("name", "word", "n"), "name").join(others, "other_name")
    return found.unionByName(back.where(once & one_edit).select("word", "n", "other", "other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: from ``(word, form)`` rows, forms followed to the last."""
    out = forms.select("word", F.col("form").alias("root"))
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        going = out.join(step, "root", "left")
        if going.where("next IS NOT NULL").isEmpty():
            return out
        out = materialize(going.select("word", F.coalesce("next", "root").alias("root")))


def variants(words: DataFrame, lift: int = LIFT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``(word, n)``."""
    words = materialize(words)
    pairs = near_pairs(words)
    both = pairs.select("word", "n", F.explode(F.array(F.struct(F.lit(True).alias("as_is")), F.struct(F.lit(False).alias("as_is")))).alias("way"), "other", "other_n")
    pick = lambda a, b: F.when(F.col("way.as_is"), F.col(a)).otherwise(F.col(b))
    near = both.select(pick("word", "other").alias("word"), pick("n", "other_n").alias("n"), F.struct((-pick("other_n", "n")).alias("less"), pick("other", "word").alias("form")).alias("near"))
    alone = words.select("word", "n", F.lit(None).cast(near.schema["near"].dataType).alias("near"))
    each = near.unionByName(alone).groupBy("word").agg(F.first("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("best"))
    lifted = -F.col("best.less") >= lift * F.col("n")
    named = materialize(each.select("word", "n", "n_near", F.when(lifted, F.col("best.form")).alias("form"), F.when(lifted, -F.col("best.less")).alias("form_n")))
    followed = roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants among the words of a table of texts."""
    return variants(word_counts(docs, id_col, text_col).where(F.col("n") >= LEAST_COUNT))
