"""Forecast comparison tests and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.probability import normal_two_sided, student_cdf, student_two_sided
from panelcast.operators.buckets import over_buckets, row_position, slot
from panelcast.operators.order_stats import attach, grouped_quantiles
from panelcast.schemas import HOUR, KEY


def p_student(stat: Column, df: Column, one_sided: bool = False) -> Column:
    return student_cdf(stat, df) if one_sided else student_two_sided(stat, df)


def forecast_order(step: int = HOUR) -> Column:
    """Rows by horizon, then origin, as one integer."""
    return F.col("horizon_h").cast("bigint") * (1 << 40) + slot("origin_ts", step)


def squared(e: Column) -> Column:
    return e * e


def diebold_mariano(
    df: DataFrame, keys, e1: str, e2: str, *, order: Column | None = None, horizon: int = 1,
    loss: Callable[[Column], Column] = squared, weights: str = "flat",
) -> DataFrame:
    """Loss-difference test per key.

    ``flat``: unweighted autocovariances with the small-sample correction (Student p).
    ``bartlett``: triangular weights on sample autocovariances (normal p); a
    non-positive variance gives 0 and p 1. Input errors go through ``loss``.
    """
    keys = list(keys)
    d = df.select(*keys, (loss(F.col(e1)) - loss(F.col(e2))).alias("d"), (forecast_order() if order is None else order).alias("_o"))
    mean = d.groupBy(*keys).agg(F.avg("d").alias("m"))
    lags = {}
    if horizon > 1:
        d = row_position(d, "_rp", pos="_o", keys=keys)
        d = over_buckets(
            d, {f"_l{k}": (lambda w, k=k: F.lag("d", k).over(w)) for k in range(1, horizon)}, pos="_rp", keys=keys, back=horizon - 1
        )
    j = attach(d, mean, keys)
    x = F.col("d") - F.col("m")
    for k in range(1, horizon):
        lags[f"_g{k}"] = F.covar_samp("d", f"_l{k}") if weights == "bartlett" else F.avg(x * (F.col(f"_l{k}") - F.col("m")))
    a = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("m").alias("loss_diff_mean"), F.avg(x * x).alias("_g0"), *[c.alias(n) for n, c in lags.items()]
    )
    auto = F.lit(0.0)
    for k in range(1, horizon):
        auto = auto + F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) * (1 - k / horizon if weights == "bartlett" else 1.0)
    var = (F.col("_g0") + 2 * auto) / F.col("n")
    raw = F.col("loss_diff_mean") / F.sqrt(var)
    n, h = F.col("n"), horizon
    if weights == "bartlett":
        stat = F.when(var > 0, raw).otherwise(F.lit(0.0))
    else:
        stat = F.when(var > 0, raw * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))
    return a.select(*keys, "n", "loss_diff_mean", stat.alias("statistic"))


def with_p_value(tested: DataFrame, *, weights: str = "flat", one_sided: bool = False) -> DataFrame:
    if weights == "bartlett":
        return tested.withColumn("p_value", normal_two_sided(F.col("statistic")))
    return tested.withColumn("p_value", p_student(F.col("statistic"), F.col("n") - 1, one_sided))


def detectable_difference(n: Column, sd: Column, z: float = 1.959964 + 0.8416212) -> Column:
    """Smallest mean loss difference seen with 80 % power at the 5 % level."""
    return z * sd / F.sqrt(F.greatest(n, F.lit(1)))


def _poisson_cdf() -> np.ndarray:
    """Cumulative probabilities of a Poisson variable with mean 1, up to where doubles reach 1."""
    out, term, k = [], math.exp(-1.0), 0
    while not out or out[-1] < 1.0 and out[-1] + term > out[-1]:
        out.append((out[-1] if out else 0.0) + term)
        k += 1
        term /= k
    return np.array(out)


_CDF = _poisson_cdf()


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (its published constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bootstrap_weights(row_hash: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson weight of every row in every replicate (rows x replicates), drawn from the hash of the row."""
    with np.errstate(over="ignore"):
        salt = _scrambled(np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        u = _scrambled(row_hash[:, None] ^ salt[None, :])
    return np.searchsorted(_CDF, (u >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


def _replicates(keys: list[str], resamples: int, held_groups: int = 1024):
    """Per partition: sums of weights and of weighted values for each key and replicate."""

    def rows(held):
        for key, (w, wx) in held.items():
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "_w": [w], "_wx": [wx]})

    def run(batches):
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                w, wx = held.setdefault(tuple(key), (np.zeros(resamples), np.zeros(resamples)))
                for at in range(0, len(part), 512):
                    some = part.iloc[at : at + 512]
                    draws = bootstrap_weights(some["_k"].to_numpy(np.int64).view(np.uint64), resamples)
                    w += draws.sum(0)
                    wx += some["_x"].to_numpy(float) @ draws
            if len(held) > held_groups:
                yield from rows(held)
                held = {}
        yield from rows(held)

    return run


def bootstrap_mean(df: DataFrame, value: Column, row_key, *, keys=(), resamples: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Point, lower and upper bound of a mean by Poisson bootstrap.

    Every row draws its weight per replicate from a hash of its key, so the
    result does not depend on partitioning. Each task sums all replicates of its
    rows at once; one row per key and task travels, with two arrays.
    """
    keys = list(keys)
    draws = df.select(*keys, value.cast("double").alias("_x"), F.xxhash64(*row_key, F.lit(seed)).alias("_k")).where("_x IS NOT NULL")
    types = ", ".join([*[f"`{k}` {draws.schema[k].dataType.simpleString()}" for k in keys], "_w array<double>", "_wx array<double>"])
    parts = draws.mapInPandas(_replicates(keys, resamples), types)
    sums = parts.select(*keys, F.posexplode(F.arrays_zip("_w", "_wx")).alias("_r", "_s")).groupBy(*keys, "_r").agg(
        F.sum("_s._w").alias("_w"), F.sum("_s._wx").alias("_wx")
    )
    per = sums.select(*keys, "_r", (F.col("_wx") / F.nullif(F.col("_w"), F.lit(0.0))).alias("_m"))
    tail = (1 - confidence) / 2
    ci = grouped_quantiles(per, keys, "_m", {"lower": tail, "upper": 1 - tail}).drop("n")
    point = draws.groupBy(*keys).agg(F.avg("_x").alias("point"), F.count(F.lit(1)).alias("n"))
    return attach(point, ci, keys)
