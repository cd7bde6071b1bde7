"""Storage dispatch backtests: one ordered fold per episode of bounded length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.order_stats import attach, grouped_quantiles
from panelcast.schemas import KEY, TS

# Capacity (MWh), power limit (MW), round-trip efficiency, step length (h).
CAPACITY, POWER, EFFICIENCY, HOURS = 100.0, 50.0, 0.90, 1.0
ROOT = math.sqrt(EFFICIENCY)


def episodes(df: DataFrame, keys=(KEY,), ts: str = TS) -> DataFrame:
    """Whole days as episodes: ``episode`` day stamp and ``step`` 0..23; only complete days."""
    e = df.withColumn("episode", F.date_trunc("day", ts)).withColumn("step", F.hour(ts))
    n = Window.partitionBy(*keys, "episode")
    return e.withColumn("_n", F.count(F.lit(1)).over(n)).where("_n = 24").drop("_n")


def rank_actions(df: DataFrame, by: str, keys=(KEY,), k: int = 2, spread: Column | None = None) -> DataFrame:
    """``action`` -1 (charge) in the ``k`` cheapest and +1 (discharge) in the ``k`` dearest steps of an episode.

    Charging wins where both apply. Steps where the ``spread`` condition fails are not traded.
    """
    lo = Window.partitionBy(*keys, "episode").orderBy(by, "step")
    hi = Window.partitionBy(*keys, "episode").orderBy(F.desc(by), F.desc("step"))
    a = F.when(F.row_number().over(lo) <= k, -1).when(F.row_number().over(hi) <= k, 1).otherwise(0)
    return df.withColumn("action", a if spread is None else F.when(spread, a).otherwise(0))


def where_bands_part(df: DataFrame, keys=(KEY,), low: str = "q10", high: str = "q90") -> DataFrame:
    """Trade an episode only if the bands of its hours to buy and to sell are apart: every ``high`` of the first below every ``low`` of the second."""
    w = Window.partitionBy(*keys, "episode")
    dear = F.min(F.when(F.col("action") > 0, F.col(low))).over(w)
    cheap = F.max(F.when(F.col("action") < 0, F.col(high))).over(w)
    return df.withColumn("action", F.when(cheap < dear, F.col("action")).otherwise(0))


def hourly_actions(df: DataFrame, charge=range(0, 6), discharge=range(8, 14)) -> DataFrame:
    """A fixed daily schedule by hour; empty ranges give the idle policy."""
    a = F.when(F.col("step").isin(list(charge)), -1) if len(charge) else F.when(F.lit(False), -1)
    a = a.when(F.col("step").isin(list(discharge)), 1) if len(discharge) else a
    return df.withColumn("action", a.otherwise(0))


def _state(soc: Column, power: Column, profit: Column, price: Column, ts: Column, step: Column) -> Column:
    return F.struct(
        soc.alias("soc"), power.alias("power"), profit.alias("profit"), price.alias("price"), ts.alias("ts"), step.alias("step")
    )


def _limits(x, soc, capacity: float, power_max: float) -> Column:
    """Actual grid power of a wanted step, positive when selling, inside power and state limits."""
    want = F.least(F.greatest(x["mw"], F.lit(-power_max)), F.lit(power_max))
    sell = F.least(want, soc * ROOT / HOURS)
    buy = F.greatest(want, -(F.lit(capacity) - soc) / (HOURS * ROOT))
    return F.when(want >= 0, sell).otherwise(buy)


def simulate(df: DataFrame, mw: Column, keys=(KEY,), *, capacity: float = CAPACITY, power: float = POWER, start: float = 0.5, price: str = "price") -> DataFrame:
    """Run requested megawatts through the battery: one row per step with state, power and profit.

    Efficiency is split over both directions; a request beyond the limits is cut
    and its actual power settled. The fold runs over the 24 ordered steps of one
    episode inside generated array code; episodes spread over the cluster.
    """
    keys = list(keys)
    row = F.struct(F.col("step").alias("step"), F.col(TS).alias("ts"), F.col(price).cast("double").alias("price"), mw.cast("double").alias("mw"))
    ep = df.groupBy(*keys, "episode").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    zero = F.lit(0.0)

    def advance(acc, x):
        soc = acc["soc"]
        p = _limits(x, soc, capacity, power)
        after = F.when(p >= 0, soc - p * HOURS / ROOT).otherwise(soc - p * HOURS * ROOT)
        after = F.greatest(F.least(after, F.lit(capacity)), zero)
        done = _state(after, p, x["price"] * p * HOURS, x["price"], x["ts"], x["step"])
        return F.struct(after.alias("soc"), F.concat(acc["steps"], F.array(done)).alias("steps"))

    none = F.array().cast("array<struct<soc:double,power:double,profit:double,price:double,ts:timestamp,step:int>>")
    init = F.struct(F.lit(capacity * start).alias("soc"), none.alias("steps"))
    run = ep.select(*keys, "episode", F.aggregate("_rows", init, advance, lambda a: a["steps"]).alias("_steps"))
    return run.select(*keys, "episode", F.inline("_steps"))


def episode_profits(steps: DataFrame, keys=(KEY,)) -> DataFrame:
    return steps.groupBy(*keys, "episode").agg(F.sum("profit").alias("profit"))


def tail_means(df: DataFrame, keys, value: str, levels=(0.01, 0.05, 0.10, 0.20)) -> DataFrame:
    """Mean of the values at or below each tail quantile, one row per level."""
    names = {f"_t{i}": a for i, a in enumerate(levels)}
    cut = grouped_quantiles(df, keys, value, names).drop("n")
    j = attach(df, cut, keys)
    wide = j.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(F.col(value) <= F.col(t), F.col(value))), F.max(t)).alias(t) for t in names])
    rows = F.array(*[F.struct(F.lit(a).alias("level"), F.col(t).alias("cvar")) for t, a in names.items()])
    return wide.select(*keys, F.inline(rows))


def summary(profits: DataFrame, keys, value: str = "profit") -> DataFrame:
    """Mean, population std, median, tail mean at 5 %, Sharpe, p10, p90, count and loss rate."""
    sharpe = F.coalesce(F.avg(value) / F.nullif(F.stddev_pop(value), F.lit(0.0)), F.lit(0.0))
    q = grouped_quantiles(
        profits, keys, value, {"median": 0.5, "p10": 0.1, "p90": 0.9},
        extra=(
            F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), sharpe.alias("sharpe"),
            F.avg((F.col(value) < 0).cast("int")).alias("loss_rate"), F.count(F.lit(1)).alias("n_episodes"),
        ),
    ).drop("n")
    tail = tail_means(profits, keys, value, (0.05,)).select(*keys, F.col("cvar").alias("cvar_5pct"))
    return attach(q, tail, keys)


def hourly_profile(steps: DataFrame, keys=()) -> DataFrame:
    return steps.groupBy(*keys, F.col("step").alias("hour")).agg(
        F.avg("power").alias("mean_power"), F.avg("soc").alias("mean_soc"), F.avg("profit").alias("mean_profit")
    )


def capture_ratio(summaries: DataFrame, policy: str = "policy", best: str = "greedy") -> DataFrame:
    """Each policy's mean profit, its difference to the best policy and the share captured."""
    top = summaries.where(F.col(policy) == best).agg(F.first("mean").alias("_best"))
    return attach(summaries, top, ()).select(
        policy, "mean", (F.col("mean") - F.col("_best")).alias("delta"), (F.col("mean") / F.nullif(F.col("_best"), F.lit(0.0))).alias("capture")
    )


def decision_states(df: DataFrame, forecast_columns, stats: DataFrame, keys=(KEY,), extras: DataFrame | None = None, extra_columns=()) -> DataFrame:
    """Observation per hour: calendar cycles, scaled price, scaled forecasts (absent ones are 0 before scaling).

    ``stats`` holds ``mean`` and ``scale`` per key, from the training split only.
    """
    from panelcast.functions.timefeatures import calendar

    cal = {k: v for k, v in calendar().items() if k.startswith(("hour", "dow"))}
    j = df.join(stats, list(keys))
    z = lambda c: (c - F.col("mean")) / F.col("scale")
    cols = [c.alias(n) for n, c in cal.items()] + [z(F.col("price")).alias("price_z")]
    for c in forecast_columns:
        raw = F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        cols.append(z(raw).alias(f"{c}_z"))
    return j.select(*keys, TS, *cols)
