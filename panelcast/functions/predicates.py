"""Split labels, horizon groups, bounds and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.schemas import KEY, TS, existing

# Horizon groups.
HORIZON_GROUPS = {"h1_6": (1, 6), "h7_18": (7, 18), "h19_24": (19, 24)}


def _at(text) -> Column:
    return F.lit(text).cast("timestamp")


def split_label(bounds: dict[str, tuple], ts: str = TS) -> Column:
    """Split name by half-open ``[start, end)`` bounds; None leaves a side open."""
    label = None
    for name, (lo, hi) in bounds.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col(ts) >= _at(lo))
        if hi is not None:
            inside = inside & (F.col(ts) < _at(hi))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


def horizon_group(h: str = "horizon_h") -> Column:
    out = None
    for name, (lo, hi) in HORIZON_GROUPS.items():
        cond = F.col(h).between(lo, hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def filter_horizons(df: DataFrame, *, groups=(), horizons=(), h: str = "horizon_h") -> DataFrame:
    wanted = set(horizons)
    for g in groups:
        lo, hi = HORIZON_GROUPS[g]
        wanted |= set(range(lo, hi + 1))
    return df.where(F.col(h).isin(sorted(wanted)))


def select_prefixed(df: DataFrame, always, *, prefixes=(), names=()) -> DataFrame:
    """Key columns, then the listed names that exist, then columns by prefix."""
    chosen = [*always, *existing(df, names), *[c for c in df.columns if c.startswith(tuple(prefixes))]]
    return df.select(*dict.fromkeys(chosen))


def outside_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]], keys=(KEY, TS)) -> DataFrame:
    """Cells outside hard bounds, long. The few bounds ride along as literals: one narrow pass."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for c, (lo, hi) in bounds.items() if c in df.columns
    ])
    bad = F.filter(cells, lambda s: (s["value"] < s["lo"]) | (s["value"] > s["hi"]))
    return df.select(*keys, F.inline(bad))


def check_rules(df: DataFrame, rules: dict[str, Column], keys=()) -> DataFrame:
    """One aggregate over all rules, then one row per rule; unknown (NULL) cells do not fail a rule."""
    agg = df.groupBy(*keys).agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("passed")) for n in rules])
    return agg.select(*keys, F.inline(rows))


def split_overlaps(df: DataFrame, split: str = "split", ts: str = TS) -> DataFrame:
    """Pairs of splits and whether their time ranges are disjoint (one row per split is compared)."""
    b = df.groupBy(split).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    a, c = b.alias("a"), b.alias("c")
    return a.join(c, F.col(f"a.{split}") < F.col(f"c.{split}")).select(
        F.col(f"a.{split}").alias("split_a"), F.col(f"c.{split}").alias("split_b"),
        ((F.col("a.hi") < F.col("c.lo")) | (F.col("c.hi") < F.col("a.lo"))).alias("is_disjoint"),
    )


def with_context(df: DataFrame, start: str, hours_before: int, ts: str = TS) -> DataFrame:
    """Rows from ``start`` on plus the lookback needed before it; a pushable range predicate."""
    return df.where(F.col(ts) >= _at(start) - F.make_dt_interval(hours=F.lit(hours_before)))
