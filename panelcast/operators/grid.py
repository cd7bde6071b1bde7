"""Regular clocks, resampling, pivots, fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.buckets import ROWS_PER_RUN, over_buckets, slot
from panelcast.schemas import HOUR, KEY, TS


def at_slot(c: Column, step: int = HOUR) -> Column:
    return F.timestamp_micros(c * (step * 1_000_000))


def spine(df: DataFrame, *, keys=(KEY,), step: int = HOUR, start=None, end=None) -> DataFrame:
    """Every slot of every series between its first and last stamp (or fixed bounds).

    The slots of one long series are generated by many tasks: its bucket numbers
    are laid out first, spread, and each expanded on its own.
    """
    first = slot(F.lit(start).cast("timestamp"), step) if start else F.min(slot(TS, step))
    last = slot(F.lit(end).cast("timestamp"), step) if end else F.max(slot(TS, step))
    ends = df.groupBy(*keys).agg(F.min(slot(TS, step)).alias("_x"), first.alias("_a"), last.alias("_z")).drop("_x")
    size = ROWS_PER_RUN
    buckets = ends.select(
        *keys, "_a", "_z", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_z") / size))).alias("_b")
    ).repartition(*keys, "_b")
    slots = F.sequence(
        F.greatest(F.col("_a"), F.col("_b") * size), F.least(F.col("_z"), F.col("_b") * size + size - 1)
    )
    return buckets.select(*keys, F.explode(slots).alias("_s")).select(*keys, at_slot(F.col("_s"), step).alias(TS))


def reindex(df: DataFrame, *, keys=(KEY,), step: int = HOUR, start=None, end=None) -> DataFrame:
    """Left join onto the spine: missing slots become rows of NULLs."""
    return spine(df, keys=keys, step=step, start=start, end=end).join(df, [*keys, TS], "left")


def resample(df: DataFrame, unit: str, aggs: dict[str, Column], *, keys=(KEY,)) -> DataFrame:
    """Aggregate per calendar period; the label is the period start (weeks start on Monday).

    SQL sums over no values are NULL, which is the "at least one value" rule.
    """
    return df.groupBy(*keys, F.date_trunc(unit, TS).alias(TS)).agg(*[c.alias(n) for n, c in aggs.items()])


def pivot_wide(df: DataFrame, keys, column: str, values, agg: Column, rename=None) -> DataFrame:
    """Long -> wide with a fixed value list, so no extra job looks for the values."""
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(agg)
    for v in values:
        if rename:
            wide = wide.withColumnRenamed(str(v), rename(v))
    return wide


def locations_wide(df: DataFrame, keys, location: str, locations, variables, prefix=str.lower) -> DataFrame:
    """Location-long measurements -> ``<location>_<variable>`` columns in one aggregation."""
    return df.groupBy(*keys).agg(*[
        F.first(F.when(F.col(location) == loc, F.col(v)), ignorenulls=True).alias(f"{prefix(loc)}_{v}")
        for loc in locations
        for v in variables
    ])


def forecast_wide(df: DataFrame, *, keys=(KEY,), horizons=range(1, 25), quantiles=("q10", "q50", "q90"), prefix="load") -> DataFrame:
    """Forecast rows -> one row per origin with ``<prefix>_<q>_h<h>`` columns."""
    name = (prefix + "_") if prefix else ""
    return df.groupBy(*keys, "origin_ts").agg(*[
        F.max(F.when(F.col("horizon_h") == h, F.col(q))).alias(f"{name}{q}_h{h}")
        for q in quantiles
        for h in horizons
    ])


def forecast_long(df: DataFrame, *, keys=(KEY,), horizons=range(1, 25), quantiles=("q10", "q50", "q90"), prefix="load") -> DataFrame:
    """Inverse of :func:`forecast_wide`: an array of structs exploded, no shuffle."""
    name = (prefix + "_") if prefix else ""
    rows = F.array(*[
        F.struct(F.lit(h).alias("horizon_h"), *[F.col(f"{name}{q}_h{h}").alias(q) for q in quantiles])
        for h in horizons
    ])
    return df.select(*keys, "origin_ts", F.inline(rows))


def window_rows(df: DataFrame, length: int, stride: int, *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    """Fixed windows: one row per (window, row) for starts 0, stride, ... <= n - length.

    Position is clock arithmetic on the gridded series, so no row numbering.
    """
    ends = df.groupBy(*keys).agg(F.min(slot(TS, step)).alias("_a"), F.count(F.lit(1)).alias("_n"))
    p = df.join(ends, list(keys)).withColumn("_p", slot(TS, step) - F.col("_a"))
    first = F.greatest(F.ceil((F.col("_p") - length + 1) / stride), F.lit(0))
    last = F.least(F.floor(F.col("_p") / stride), F.floor((F.col("_n") - length) / stride))
    return (
        p.where((first <= last) & (F.col("_n") >= length))
        .withColumn("window_id", F.explode(F.sequence(first, last)))
        .withColumn("offset", (F.col("_p") - F.col("window_id") * stride).cast("int"))
        .drop("_a", "_n", "_p")
    )


def overlap_average(spine_df: DataFrame, windows: DataFrame, value: str, *, keys=(KEY,)) -> DataFrame:
    """Mean of overlapping window values per slot; uncovered slots are 0."""
    mean = windows.groupBy(*keys, TS).agg(F.avg(value).alias(value))
    return spine_df.select(*keys, TS).join(mean, [*keys, TS], "left").fillna(0.0, subset=[value])


def origin_windows(
    df: DataFrame, past_cols, future_cols, *, lookback: int, horizon: int, stride: int = 1, keys=(KEY,), step: int = HOUR
) -> DataFrame:
    """Dense lookback/horizon arrays per origin (only complete ones).

    Project to the needed columns first: each row is repeated ``lookback`` times.
    """
    def grab(cols, lo, hi):
        return lambda w: F.collect_list(F.struct(*[F.col(c) for c in cols])).over(w.rowsBetween(lo, hi))

    narrow = df.select(*keys, TS, *dict.fromkeys([*past_cols, *future_cols]))
    out = over_buckets(
        narrow,
        {"past": grab(past_cols, -(lookback - 1), 0), "future": grab(future_cols, 1, horizon)},
        keys=keys, back=lookback - 1, ahead=horizon, step=step,
    )
    out = out.where((F.size("past") == lookback) & (F.size("future") == horizon))
    if stride > 1:
        ends = df.groupBy(*keys).agg(F.min(slot(TS, step)).alias("_a"))
        out = out.join(ends, list(keys)).where(
            (slot(TS, step) - F.col("_a") - (lookback - 1)) % stride == 0
        ).drop("_a")
    return out.select(*keys, F.col(TS).alias("origin_ts"), "past", "future")
