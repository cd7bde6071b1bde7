"""Forecast metrics as aggregate expressions, so any grouping of a scored table is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.predicates import horizon_group
from panelcast.operators.order_stats import attach, grouped_quantiles
from panelcast.schemas import QUANTILES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mae(y="y", p="q50") -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def rmse(y="y", p="q50") -> Column:
    return F.sqrt(F.avg((_c(y) - _c(p)) * (_c(y) - _c(p))))


def smape(y="y", p="q50", floor: float = 1e-9) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)) / F.greatest((F.abs(_c(y)) + F.abs(_c(p))) / 2, F.lit(floor)))


def mape(y="y", p="q50", floor: float = 1.0) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)) / F.greatest(F.abs(_c(y)), F.lit(floor)))


def nmae(y="y", p="q50") -> Column:
    return F.avg(F.abs(_c(y) - _c(p))) / F.nullif(F.avg(F.abs(_c(y))), F.lit(0.0))


def corr(a, b) -> Column:
    """Pearson correlation over complete pairs; NULL where a side does not vary (the built-in fails there)."""
    a, b = _c(a), _c(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def bias(y="y", p="q50") -> Column:
    return F.avg(_c(p) - _c(y))


def directional_accuracy(anchor, y="y", p="q50") -> Column:
    return F.avg((F.signum(_c(y) - _c(anchor)) == F.signum(_c(p) - _c(anchor))).cast("int"))


def pinball_row(q: float, p, y="y") -> Column:
    e = _c(y) - _c(p)
    return F.greatest(q * e, (q - 1) * e)


def pinball(q: float, p, y="y", weight: Column | None = None) -> Column:
    row = pinball_row(q, p, y)
    return F.avg(row if weight is None else row * weight)


def mean_pinball(y="y", weight: Column | None = None, quantiles=QUANTILES) -> Column:
    total = None
    for name, q in quantiles.items():
        one = pinball(q, name, y, weight)
        total = one if total is None else total + one
    return total / len(quantiles)


def covered(y="y", lo="q10", hi="q90") -> Column:
    return ((_c(y) >= _c(lo)) & (_c(y) <= _c(hi))).cast("int")


def coverage(y="y", lo="q10", hi="q90") -> Column:
    return F.avg(covered(y, lo, hi))


def width(lo="q10", hi="q90") -> Column:
    return F.avg(_c(hi) - _c(lo))


def winkler(y="y", lo="q10", hi="q90", alpha: float = 0.2) -> Column:
    y, lo, hi = _c(y), _c(lo), _c(hi)
    zero = F.lit(0.0)
    return F.avg((hi - lo) + (2 / alpha) * (F.greatest(lo - y, zero) + F.greatest(y - hi, zero)))


def below(p, y="y") -> Column:
    return F.avg((_c(y) < _c(p)).cast("int"))


def standard(y="y") -> dict[str, Column]:
    """The leaderboard set."""
    return {
        "mae": mae(y), "rmse": rmse(y), "pinball": mean_pinball(y), "coverage": coverage(y), "winkler": winkler(y), "n": F.count(F.lit(1)),
    }


def by_groups(scored: DataFrame, keys, metrics: dict[str, Column]) -> DataFrame:
    return scored.groupBy(*keys).agg(*[c.alias(n) for n, c in metrics.items()])


def leaderboard(scored: DataFrame, keys, metrics: dict[str, Column] | None = None, segment: Column | None = None) -> DataFrame:
    """Overall and per horizon group in one pass with grouping sets; the overall rows say ``overall``."""
    metrics = metrics or standard()
    s = scored.withColumn("segment", horizon_group() if segment is None else segment)
    cols = [F.col(k) for k in keys]
    g = s.groupingSets([cols, [*cols, F.col("segment")]], *cols, F.col("segment"))
    out = g.agg(F.grouping("segment").alias("_g"), *[c.alias(n) for n, c in metrics.items()])
    label = F.when(F.col("_g") == 1, "overall").otherwise(F.col("segment"))
    return out.withColumn("segment", label).drop("_g")


def segment_metrics(scored: DataFrame, flags: dict[str, Column], metrics: dict[str, Column], keys=()) -> DataFrame:
    """One row per key and segment; a segment without rows is kept with NULL metrics.

    Segments overlap, so a row counts once in each of its (at most nine) segments;
    the copies are combined per segment before anything is shuffled.
    """
    marked = scored.withColumn("_seg", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))
    per = marked.withColumn("segment", F.explode("_seg")).groupBy(*keys, "segment").agg(*[c.alias(n) for n, c in metrics.items()])
    wanted = F.explode(F.array(*[F.lit(n) for n in flags])).alias("segment")
    names = scored.select(*keys).distinct().select(*keys, wanted) if keys else scored.sparkSession.range(1).select(wanted)
    return names.join(per, [*keys, "segment"], "left")


def with_threshold(scored: DataFrame, keys, y: str = "y", q: float = 0.9, out: str = "threshold") -> DataFrame:
    """Attach the group's exact ``q`` quantile of the truth."""
    t = grouped_quantiles(scored, keys, y, {out: q}).drop("n")
    return attach(scored, t, keys)


def spike_mae(scored: DataFrame, keys, q: float = 0.9) -> DataFrame:
    s = with_threshold(scored, keys, q=q).where(F.col("y") >= F.col("threshold"))
    return s.groupBy(*keys).agg(mae().alias("spike_mae"), F.count(F.lit(1)).alias("n"))


def reliability(scored: DataFrame, keys, levels: int = 49) -> DataFrame:
    """Coverage of ``q50 +- W(1 - a) * half / mean(half)`` for nominal levels ``a``.

    Whether a row is covered at a level is one comparison of its own ratio with
    the level's half width, so the levels are aggregates of one pass, not row copies.
    """
    step = 0.96 / (levels - 1)
    nominal = [0.02 + step * i for i in range(levels)]
    s = scored.withColumn("_half", (F.col("q90") - F.col("q10")) / 2)
    stats = grouped_quantiles(
        s, keys, "_half", {f"_w{i}": 1 - a for i, a in enumerate(nominal)}, extra=(F.avg("_half").alias("_mean"),)
    ).drop("n")
    j = attach(s, stats, keys)
    scale = F.col("_half") / F.nullif(F.col("_mean"), F.lit(0.0))
    hits = [
        F.avg(((F.col("y") >= F.col("q50") - F.col(f"_w{i}") * scale) & (F.col("y") <= F.col("q50") + F.col(f"_w{i}") * scale)).cast("int")).alias(f"c{i}")
        for i in range(levels)
    ]
    wide = j.groupBy(*keys).agg(*hits)
    rows = F.array(*[F.struct(F.lit(round(a, 4)).alias("nominal"), F.col(f"c{i}").alias("covered")) for i, a in enumerate(nominal)])
    return wide.select(*keys, F.inline(rows))
