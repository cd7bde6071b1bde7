"""Lag, rolling and risk features; every builder takes the shared WindowSpec."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.buckets import over_buckets
from panelcast.schemas import HOUR, KEY


def lag_exprs(column: str | Column, lags, name: str, suffix: str = "h") -> dict[str, Callable]:
    c = F.col(column) if isinstance(column, str) else column
    return {f"{name}_lag{k}{suffix}": (lambda w, k=k: F.lag(c, k).over(w)) for k in lags}


def guarded(agg: Column, count: Column, least: int) -> Column:
    return F.when(count >= least, agg)


def rolling_exprs(column: str, windows, name: str, stats=("mean", "std", "min", "max")) -> dict[str, Callable]:
    """Statistics of the ``w`` rows before the current one, at least ``max(2, w // 4)`` known."""
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = {}
    for n in windows:
        for s in stats:
            def build(w, n=n, s=s):
                frame = w.rowsBetween(-n, -1)
                return guarded(fn[s](column).over(frame), F.count(column).over(frame), max(2, n // 4))

            out[f"{name}_roll{n}_{s}"] = build
    return out


def interval_mean(column: str, seconds: int) -> Callable:
    """Gap-safe variant of a rolling mean: a RANGE frame over time instead of rows. Window must order by seconds."""
    return lambda w: F.avg(column).over(w.rangeBetween(-seconds, -1))


def centred(agg, column: str, n: int, least: int | None = None) -> Callable:
    """Centred frame of ``n`` rows (even n: one more row behind than ahead)."""
    lo, hi = -(n // 2), (n - 1) // 2

    def build(w):
        f = w.rowsBetween(lo, hi)
        return guarded(agg(column).over(f), F.count(column).over(f), n if least is None else least)

    return build


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Compute columns once: a one-row generator keeps the optimiser from copying
    them into the lambdas that use them, where they would run per array element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def linear_quantile(sorted_array: Column, q: float) -> Column:
    at = (F.size(sorted_array) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    hi = F.least(lo + 1, F.size(sorted_array) - 1)
    a, b = F.element_at(sorted_array, lo + 1), F.element_at(sorted_array, hi + 1)
    return a + (b - a) * (at - lo)


def tail_mean(df: DataFrame, values: str, out: str, alpha: float) -> DataFrame:
    """Add the mean of the values at or below the linear ``alpha`` quantile of a short array (0 if empty)."""
    p = pinned(pinned(df, _sorted=F.array_sort(values)), _cut=F.when(F.size(values) > 0, linear_quantile(F.col("_sorted"), alpha)))
    p = pinned(p, _tail=F.filter("_sorted", lambda x: x <= F.col("_cut")))
    mean = F.aggregate("_tail", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_tail"), F.lit(0))
    mean = F.coalesce(mean, F.col("_cut"))  # an empty tail is its own threshold
    return p.withColumn(out, F.when(F.size(values) > 0, mean).otherwise(F.lit(0.0))).drop("_sorted", "_cut", "_tail")


def shaped_profit(
    df: DataFrame, column: str, *, window: int = 168, alpha: float = 0.05, least: int = 4, risk: float = 0.1, keys=(KEY,), step: int = HOUR
) -> DataFrame:
    """Add ``rolling_cvar`` of the last profits (from ``least`` on) and ``shaped_profit`` less its penalty."""
    hist = {"_hist": lambda w: F.collect_list(column).over(w.rowsBetween(-(window - 1), 0))}
    out = tail_mean(over_buckets(df, hist, keys=keys, back=window - 1, step=step), "_hist", "_c", alpha)
    cvar = F.when(F.size("_hist") >= least, F.col("_c"))
    return out.select(
        *df.columns, cvar.alias("rolling_cvar"),
        (F.col(column) - F.coalesce(risk * F.greatest(F.lit(0.0), -cvar), F.lit(0.0))).alias("shaped_profit"),
    )
