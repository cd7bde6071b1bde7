"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, folder of the tables) and gives a DataFrame, which is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe_tree, cotrain, decontam, near_copies, secret_ledger
from panelcast.session import materialize


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go."""
    return cotrain.keep(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, Jaccard similarity of 0.8 or more)."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are replaced by a mark; the length follows the text."""
    return secret_ledger.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids, each checked by decoding it again."""
    ids = bpe_tree.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, verify=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secret scan", secrets), ("byte-level BPE", tokens),
]

#: SQL cannot express the classifier; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, folder)
        if number < len(STAGES):
            docs = materialize(docs)
    return docs
