"""Conformal calibration of forecast intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.order_stats import attach, grouped_quantiles
from panelcast.schemas import KEY
from panelcast.session import materialize


def score(y="y", lo="q10", hi="q90") -> Column:
    return F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))


def level(alpha: float) -> Column:
    """Finite-sample level ``ceil((n + 1)(1 - alpha)) / n``, at most 1."""
    return F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0))


def deltas(calibration: DataFrame, keys, alpha: float = 0.2, method: str = "linear") -> DataFrame:
    """Interval correction per key: an order statistic of the scores whose level depends on ``n``.

    ``linear`` interpolates (pooled split conformal), ``higher`` takes the next
    order statistic (per-horizon conformal).
    """
    s = calibration.withColumn("_s", score())
    return grouped_quantiles(s, keys, "_s", {"delta": level(alpha)}, method=method).withColumn("alpha", F.lit(alpha))


def apply_deltas(forecasts: DataFrame, table: DataFrame, keys) -> DataFrame:
    """Widen q10/q90 by the key's delta; keys without one stay as they are, q50 is untouched."""
    d = table.select(*keys, F.col("delta").alias("_d"))
    joined = attach(forecasts, d, keys, "left")
    by = F.coalesce(F.col("_d"), F.lit(0.0))
    return joined.withColumns({"q10": F.col("q10") - by, "q90": F.col("q90") + by}).drop("_d")


def _fold(alpha: float, gamma: float, keys):
    """Sequential update over one (series, horizon, time slice), carrying the running level in and out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin_ts", kind="stable")
        a = pdf["_a"].iloc[0]
        lo, hi = pdf["q10"].to_numpy().copy(), pdf["q90"].to_numpy().copy()
        y, base = pdf["y"].to_numpy(), pdf["_base"].iloc[0]
        for i in range(len(pdf)):
            d = base * (1.0 + (alpha - a) / max(alpha, 1e-6))
            lo[i] -= d
            hi[i] += d
            a += gamma * (alpha - (0.0 if lo[i] <= y[i] <= hi[i] else 1.0))
        out = pdf.drop(columns=["_a", "_base"])
        out["q10"], out["q90"], out["level_after"] = lo, hi, a
        for k in keys:
            if out[k].dtype != "int32":
                out[k] = pd.Series(list(out[k]), index=out.index, dtype=object)
        return out

    return run


def adaptive(
    forecasts: DataFrame, table: DataFrame, keys=(KEY, "horizon_h"), *, alpha: float = 0.2, gamma: float = 0.01, slice_days: int = 366,
) -> DataFrame:
    """Adaptive conformal intervals: the level moves with every hit or miss, in origin order.

    The recurrence is sequential per key, so time is cut into slices: within one
    slice all keys run in parallel with a bounded number of rows each, and the
    level at the end of a slice (one row per key) is written and joined to the
    next. The number of slices depends on the time span, not on the data volume.
    """
    keys = list(keys)
    cols = [*keys, "origin_ts", "q10", "q50", "q90", "y"]
    rows = forecasts.select(*cols, F.floor(F.unix_seconds("origin_ts") / (slice_days * 86400)).alias("_slice"))
    base = table.select(*keys, F.col("delta").alias("_base"))
    rows = rows.join(base, keys, "left").fillna(0.0, subset=["_base"])
    ends = rows.agg(F.min("_slice").alias("a"), F.max("_slice").alias("z")).first()
    if ends["a"] is None:
        return forecasts.select(*cols).withColumn("level_after", F.lit(None).cast("double"))
    out_schema = T.StructType([*[f for f in forecasts.select(*cols).schema.fields], T.StructField("level_after", T.DoubleType())])
    if ends["z"] > ends["a"]:
        rows = materialize(rows)  # every slice reads it; its slice filter reaches the scan
    done, state = None, None
    for s in range(ends["a"], ends["z"] + 1):
        part = rows.where(F.col("_slice") == s).drop("_slice")
        if state is None:
            part = part.withColumn("_a", F.lit(alpha))
        else:
            part = part.join(state, keys, "left").fillna(alpha, subset=["_a"])
        result = part.groupBy(*keys).applyInPandas(_fold(alpha, gamma, keys), out_schema)
        if s < ends["z"]:
            result = materialize(result)
            last = result.groupBy(*keys).agg(F.first("level_after").alias("_a"))
            state = last if state is None else last.unionByName(state.join(last, keys, "left_anti"))
        done = result if done is None else done.unionByName(result)
    return done


def before_after(scored_raw: DataFrame, scored_calibrated: DataFrame, keys, metrics: dict[str, Column]) -> DataFrame:
    """Leaderboards of both tables side by side."""
    from panelcast.operators.metrics import leaderboard

    both = scored_raw.withColumn("stage", F.lit("raw")).unionByName(scored_calibrated.withColumn("stage", F.lit("calibrated")))
    return leaderboard(both, [*keys, "stage"], metrics)
