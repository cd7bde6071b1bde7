"""Supervised (origin, horizon) layout and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.schemas import HOUR, KEY, TS


def _fold_table(df: DataFrame, n_folds: int, train_start, train_end, gap: Column, val: Column, needed_days, message: str, ts: str) -> DataFrame:
    """Folds from the first and last stamp; one row per fold, later ones dropped past the end."""
    ends = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    span = F.unix_micros("_z") - F.unix_micros("_a")
    checked = ends.where(F.when(span < needed_days * 86_400_000_000, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
    k = checked.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    out = k.withColumn("train_start", train_start).withColumn("train_end", train_end)
    out = out.withColumn("val_start", F.col("train_end") + gap).withColumn("val_end", F.col("val_start") + val)
    return out.where(F.col("val_end") <= F.col("_z")).select("fold_id", "train_start", "train_end", "val_start", "val_end")


def _days(c) -> Column:
    return F.make_dt_interval(days=c if isinstance(c, Column) else F.lit(c))


def rolling_origin_folds(df: DataFrame, *, n_folds=5, train_days=730, val_days=90, gap_hours=24, ts: str = TS) -> DataFrame:
    """Fixed-length train windows sliding by one validation length."""
    start = F.col("_a") + _days(F.col("fold_id") * val_days)
    return _fold_table(
        df, n_folds, start, F.col("train_start") + _days(train_days), F.make_dt_interval(hours=F.lit(gap_hours)), _days(val_days),
        train_days + gap_hours / 24 + n_folds * val_days, "span too short for the rolling folds", ts,
    )


def expanding_window_folds(df: DataFrame, *, n_folds=5, val_days=90, gap_hours=24, initial_days=None, ts: str = TS) -> DataFrame:
    """Train windows that grow by one validation length; initial train defaults to what is left."""
    gap = F.make_dt_interval(hours=F.lit(gap_hours))
    if initial_days is None:
        first_end = F.col("_z") - _days(n_folds * val_days) - gap
        needed = n_folds * val_days + gap_hours / 24 + 1e-9
    else:
        first_end, needed = F.col("_a") + _days(initial_days), 0
    return _fold_table(
        df, n_folds, F.col("_a"), first_end + _days(F.col("fold_id") * val_days), gap, _days(val_days),
        needed, "span too short for the expanding folds", ts,
    )


def supervised(
    df: DataFrame, past_cols, future_cols, target: str, *, horizons=range(1, 25), keys=(KEY,), step: int = HOUR,
    end: str | None = None, drop_null: bool = True,
) -> DataFrame:
    """Past columns at the origin, ``fut_*`` and ``y`` at origin + horizon.

    The horizon side is the narrow one: only future columns and the target are
    repeated per horizon, keyed by target stamp. ``end`` keeps targets inside a split.
    """
    keys = list(keys)
    origins = df.select(*keys, F.col(TS).alias("origin_ts"), *past_cols)
    micros = step * 1_000_000
    targets = df.select(
        *keys, F.col(TS).alias("target_ts"), *[F.col(c).alias(f"fut_{c}") for c in future_cols], F.col(target).alias("y"),
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_h"),
    )
    if end is not None:
        targets = targets.where(F.col("target_ts") <= F.lit(end).cast("timestamp"))
    if drop_null:
        targets = targets.dropna(subset=[*[f"fut_{c}" for c in future_cols], "y"])
        origins = origins.dropna(subset=list(past_cols))
    targets = targets.withColumn(
        "origin_ts", F.timestamp_micros(F.unix_micros("target_ts") - F.col("horizon_h").cast("bigint") * micros)
    )
    return origins.join(targets, [*keys, "origin_ts"])
