"""Reading parquet tables with the library's time and missing-value rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise(df: DataFrame) -> DataFrame:
    """TIMESTAMP_NTZ -> TIMESTAMP (UTC session) and NaN -> NULL, as one projection."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(out)


def read_table(spark: SparkSession, folder: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return normalise(df.select(*columns) if columns else df)


def read_split(df: DataFrame, split: str) -> DataFrame:
    """One named split; on a table partitioned by ``split`` this prunes directories."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split!r}")
    return df.where(F.col("split") == split)


def with_mask_indicators(df: DataFrame, mask: DataFrame, keys, columns) -> DataFrame:
    """Join ``<col>_was_missing`` 0/1 flags; timestamps absent from the mask count as observed."""
    flags = mask.select(*keys, *[F.col(c).cast("int").alias(f"{c}_was_missing") for c in columns])
    names = [f"{c}_was_missing" for c in columns]
    return df.join(flags, list(keys), "left").fillna(0, subset=names)


def masked_columns(mask: DataFrame, candidates) -> list[str]:
    """Columns with at least one masked cell: one aggregate row, whatever the table size."""
    row = mask.agg(*[F.max(F.col(c).cast("int")).alias(c) for c in candidates]).first()
    return [c for c in candidates if row[c]]
