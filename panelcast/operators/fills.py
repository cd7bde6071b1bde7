"""Gap filling along a series; every series is filled on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.buckets import running, slot
from panelcast.schemas import HOUR, KEY, TS


def ffill(df: DataFrame, columns, *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    filled = running(df, {f"_f_{c}": ("last", F.col(c)) for c in columns}, keys=keys, step=step)
    return _replace(df, filled, {c: F.col(f"_f_{c}") for c in columns})


def bfill(df: DataFrame, columns, *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    filled = running(df, {f"_f_{c}": ("next", F.col(c)) for c in columns}, keys=keys, step=step)
    return _replace(df, filled, {c: F.col(f"_f_{c}") for c in columns})


def ffill_bfill(df: DataFrame, columns, *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    """Forward fill, then the leading gap from the first observed value; both in one pass."""
    specs = {f"_f_{c}": ("last", F.col(c)) for c in columns} | {f"_n_{c}": ("next", F.col(c)) for c in columns}
    filled = running(df, specs, keys=keys, step=step)
    return _replace(df, filled, {c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_n_{c}")) for c in columns})


def _replace(df: DataFrame, filled: DataFrame, values: dict[str, Column]) -> DataFrame:
    return filled.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def neighbours(df: DataFrame, column: str, *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    """Add ``_prev``/``_next``: the nearest observed (slot, value) at or before / at or after each row."""
    seen = F.when(F.col(column).isNotNull(), F.struct(slot(TS, step).alias("p"), F.col(column).alias("v")))
    return running(df, {"_prev": ("last", seen), "_next": ("next", seen)}, keys=keys, step=step)


def interpolate(df: DataFrame, column: str, *, out: str | None = None, keys=(KEY,), step: int = HOUR) -> DataFrame:
    """Linear in time between observed values; the ends take the nearest observation."""
    n = neighbours(df, column, keys=keys, step=step)
    a, b = F.col("_prev"), F.col("_next")
    frac = (slot(TS, step) - a["p"]) / (b["p"] - a["p"])
    value = (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(a.isNull(), b["v"])
        .when(b.isNull(), a["v"])
        .otherwise(a["v"] + (b["v"] - a["v"]) * frac)
    )
    return n.withColumn(out or column, value).drop("_prev", "_next")


def keep_observed(observed: Column, imputed: Column) -> Column:
    """Fill policy: an imputed value never replaces an observed one."""
    return F.coalesce(observed, imputed)
