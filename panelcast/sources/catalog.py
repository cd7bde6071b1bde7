"""Writing results, and describing what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.schemas import TS


def write_splits(df: DataFrame, path: str, *, split: str = "split", mode: str = "errorifexists") -> None:
    """Parquet partitioned by split, so that a split load prunes directories."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def split_catalogue(df: DataFrame, split: str = "split", ts: str = TS) -> DataFrame:
    n_columns = len([c for c in df.columns if c != split])
    return df.groupBy(split).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("n_columns", F.lit(n_columns))


def _null_rates(df: DataFrame, columns):
    return [F.avg(F.col(c).isNull().cast("double")).alias(f"_null_{c}") for c in columns]


def validate(df: DataFrame, name: str, columns, *, min_rows: int, start: str, end: str, ts: str = TS) -> DataFrame:
    """One row: pass flag, counts and reasons. Start may be 2 days late; no column over half empty."""
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *_null_rates(df, columns))
    late = F.lit(start).cast("timestamp") + F.make_dt_interval(days=F.lit(2))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_rows") < min_rows, "too few rows"),
        F.when(F.col("first_ts") > late, "starts late"),
        F.when(F.col("last_ts") < F.lit(end).cast("timestamp"), "ends early"),
        *[F.when(F.col(f"_null_{c}") > 0.5, f"{c} over half null") for c in columns],
    ))
    return a.select(
        F.lit(name).alias("dataset"), "n_rows", "first_ts", "last_ts", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons")
    )


def inventory(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """One row per dataset: rows, time range, worst null rate. Each table is scanned once."""
    out = None
    for name, (df, ts, columns) in tables.items():
        a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *_null_rates(df, columns))
        rates = F.array(*[F.col(f"_null_{c}") for c in columns])
        row = a.select(F.lit(name).alias("dataset"), "n_rows", "first_ts", "last_ts", F.array_max(rates).alias("max_null_rate"))
        out = row if out is None else out.unionByName(row)
    return out
