"""Benchmark decontamination with DataFrame functions only.

Benchmark items are normalised into words and cut into windows; the distinct windows form
a hash table that is broadcast if its measured size is within ``broadcast_bytes`` (else it
is joined by shuffling, with the same result). Each document is cut into words once, every
word starts one window per window length that the benchmark has (at most ``n`` of them),
the 64-bit hash of the window probes the table, and a hit is verified word by word.

Rows survive as they are: null or empty texts have no words and no hits; repeated rows each
get the result; a null id is kept. Items with no words (or null) give no window; a null
item id counts as an item but has no name in the list. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import lower_ascii, narrow

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
BROADCAST_BYTES = 256 << 20


def words(text: Column) -> Column:
    """Words of a text: runs of letters and digits, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows ``(gram array<string>, len, items array<string>)``."""
    items = narrow(benchmark, item=id_col, text=text_col).select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    grams = items.select(
        "item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at")
    ).select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(
    docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, text_hash, n_words, copies, spans array<struct<at,len>>, items array<string>)`` for each distinct (id, text)."""
    grams = windows(benchmark, n, item_col, item_text)
    table = grams.groupBy(F.xxhash64("gram").alias("hash")).agg(F.collect_list(F.struct("gram", "items")).alias("entries"))
    size = grams.agg(
        F.sum(F.length(F.concat_ws(" ", "gram")) * 4 + F.length(F.concat_ws(" ", "items")) + 64 + 16 * F.size("gram")).alias("bytes"),
        F.collect_set("len").alias("lengths"),
    ).first()
    lengths = sorted(size["lengths"]) or [n]
    if (size["bytes"] or 0) <= broadcast_bytes:
        table = F.broadcast(table)
    base = narrow(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    probe = base.select("id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("at", "_word"))
    probe = probe.withColumn("l", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    at = F.coalesce("at", F.lit(0))
    probe = probe.select(
        "id", "text_hash", "n_words", at.alias("at"), "l", F.when(at + F.col("l") <= F.col("n_words"), F.slice("w", at + 1, F.col("l"))).alias("g"),
        ((at == 0) & (F.col("l") == lengths[0])).alias("carry"),  # this row brings its document through, hit or not
    ).withColumn("h", F.when(F.col("g").isNotNull(), F.xxhash64("g")))
    found = probe.join(table, probe.h == table["hash"], "left").where(F.col("entries").isNotNull() | F.col("carry"))
    found = found.withColumn("entries", F.filter("entries", lambda e: e["gram"] == F.col("g"))).select(
        "id", "text_hash", "n_words", "carry", F.when(F.size("entries") > 0, F.struct("at", F.col("l").alias("len"))).alias("span"),
        F.when(F.size("entries") > 0, F.col("entries")[0]["items"]).alias("items"),
    )
    return found.groupBy("id", "text_hash", "n_words").agg(
        F.sum(F.col("carry").cast("long")).alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def n_covered(spans: Column) -> Column:
    """Words inside at least one of the sorted spans."""
    def step(acc, s):
        end = s["at"] + s["len"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).cast("long").alias("n"), F.greatest(acc["end"], end).cast("int").alias("end")
        )

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, text_hash, copies, n_words, n_hit, items, spans)`` for each distinct (id, text)."""
    found = hits(docs, benchmark, n, id_col, text_col, **options)
    return found.select("id", "text_hash", "copies", F.col("n_words").cast("long").alias("n_words"), n_covered(F.col("spans")).alias("n_hit"), "items", "spans")


def flags(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for every row of ``docs``: ``(id, n_words, n_hit, n_items, items_sha256, contaminated)``."""
    found = report(docs, benchmark, n, id_col, text_col, **options)
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = N, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, without contaminated rows (``documents``) or without the hit words (``spans``).

    In span mode a hit word goes together with the separator in front of it.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action}")
    found = report(docs, benchmark, n, id_col, text_col, **options).where("n_hit > 0").select(
        F.col("id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("spans").alias("_hit_spans")
    )
    same = docs[f"`{id_col}`"].eqNullSafe(found["_hit_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == found["_hit_hash"])
    if action == "documents":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    return joined.withColumn(text_col, F.when(F.col("_hit_id").isNull() & F.col("_hit_hash").isNull(), F.col(f"`{text_col}`")).otherwise(
        _without(F.col(f"`{text_col}`"), F.col("_hit_spans")))).drop("_hit_id", "_hit_hash", "_hit_spans")


#: Words in their own case: the same runs as WORD finds after lower-casing.
_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _without(text: Column, spans: Column) -> Column:
    words_ = F.regexp_extract_all(text, F.lit(_CASED), F.lit(0))
    between = F.split(text, _CASED, -1)
    # each word with the separator before it; the last separator stays (the padding of the zip has no word)
    pairs = F.arrays_zip(between.alias("sep"), words_.alias("word"))
    inside = lambda i: F.exists(spans, lambda s: (i >= s["at"]) & (i < s["at"] + s["len"]))
    kept = F.filter(pairs, lambda p, i: p["word"].isNull() | ~inside(i))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["sep"], F.coalesce(p["word"], F.lit("")))), "")
