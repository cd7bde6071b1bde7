"""Duplicates and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.buckets import ROWS_PER_RUN, running
from panelcast.schemas import HOUR, KEY, TS


def keep_one(df: DataFrame, keys, sequence: str, *, last: bool) -> DataFrame:
    """One row per key: the last or first by ``sequence``.

    ``max_by`` on whole rows combines on the map side, so a key with very many
    copies never meets in one window partition.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(sequence)).alias("_row"))
    return one.select(*keys, "_row.*").select(*df.columns)


def duplicate_counts(df: DataFrame, by, keys) -> DataFrame:
    """Rows, distinct keys and surplus rows per source: two combining aggregations."""
    per = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(*by).agg(
        F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("_c") - 1).alias("n_duplicates")
    )


def stamp_gaps(df: DataFrame, *, keys=(KEY,), rows: int = ROWS_PER_RUN) -> DataFrame:
    """Distinct stamps with ``gap_seconds`` to the previous one (NULL for the first), over buckets of ``rows`` rows."""
    d = df.select(*keys, TS).distinct()
    pos = F.unix_micros(TS)
    out = running(d, {"_p": ("last", F.col(TS))}, pos=pos, keys=keys, inclusive=False, size=None, rows=rows)
    return out.withColumn("gap_seconds", ((pos - F.unix_micros("_p")) / 1_000_000).cast("bigint")).drop("_p")


def missing_runs(df: DataFrame, column: str, *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    """Runs of missing values on a gridded series: one row per run with start and length.

    A run is the hole between two consecutive observed slots, so only the
    previous observation is needed; the open runs at both ends come from the
    series bounds.
    """
    ends = df.groupBy(*keys).agg(F.min(TS).alias("_a"), F.max(TS).alias("_z"))
    us = step * 1_000_000
    seen = df.where(F.col(column).isNotNull()).select(*keys, TS)
    after = ends.select(*keys, F.timestamp_micros(F.unix_micros("_z") + us).alias(TS))
    line = seen.unionByName(after)
    prev = running(
        line, {"_p": ("last", F.col(TS))}, pos=F.unix_micros(TS), keys=keys, inclusive=False, size=ROWS_PER_RUN * us
    )
    start = F.coalesce(F.unix_micros("_p") + us, F.unix_micros("_a"))
    return (
        prev.join(ends, list(keys))
        .select(*keys, F.timestamp_micros(start).alias("run_start"), ((F.unix_micros(TS) - start) / us).cast("bigint").alias("run_length"))
        .where("run_length > 0")
    )
