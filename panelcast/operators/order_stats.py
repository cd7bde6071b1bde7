"""Exact order statistics and two-sample ECDF comparisons for groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory, so it
is used only where a group is small by construction (a day, a fixed frame). For
open groups the values are first counted per distinct value (map-side combine),
cut into value bins at approximate quantiles, and only the bins that hold a
wanted rank are ordered. No task sees more than one bin of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_VALUES = 1 << 16  # distinct values a bin should hold
GRID = 512  # approximate quantiles taken of a group, of which as many become edges as its count asks for


def attach(df: DataFrame, table: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join a table with one row per key. Without keys it is a single aggregate row, added to every row."""
    return df.join(table, list(keys), how) if keys else df.crossJoin(table)


def value_bins(counts: DataFrame, keys, value: str, bins: int | None = None, bin_values: int = BIN_VALUES) -> DataFrame:
    """Add ``_bin``: index of the value bin within the group. ``counts`` has one row per (keys, value).

    A group gets a bin for every ``bin_values`` of its values (``GRID`` bins at most, so above
    33 million distinct values bins grow), or ``bins`` if given; small groups are one bin.
    """
    grid = bins or GRID
    probs = [i / grid for i in range(1, grid)]
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, 20 * grid).alias("_edges"), F.count(F.lit(1)).alias("_n"))
    stride = F.lit(1) if bins else F.greatest(F.lit(1), F.floor(F.lit(grid) * bin_values / F.col("_n")).cast("int"))
    edges = edges.withColumn("_stride", stride).withColumn("_edges", F.filter("_edges", lambda e, i: (i + 1) % F.col("_stride") == 0)).drop("_n", "_stride")
    joined = attach(counts, edges, keys)
    binned = joined.withColumn("_bin", edges_below(F.col(value), F.col("_edges"))).drop("_edges")
    return binned.repartition(*keys, "_bin")  # a bin, not a group, is the unit of a task


def edges_below(v: Column, edges: Column) -> Column:
    """Number of sorted edges below ``v``, by binary search."""
    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & F.coalesce(F.get(edges, mid) < v, F.lit(False))
        return F.struct(
            F.when(right, mid + 1).otherwise(acc["lo"]).cast("int").alias("lo"), F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).cast("int").alias("hi")
        )

    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(edges) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(edges).cast("int").alias("hi"))
    return F.aggregate(steps, start, halve, lambda acc: acc["lo"])


def grouped_quantiles(
    df: DataFrame,
    keys,
    value: str,
    probs: dict[str, float | Column],
    *,
    method: str = "linear",
    bins: int | None = None,
    extra=(),
) -> DataFrame:
    """Exact quantiles per group: one row per key with one column per entry of ``probs`` and ``n``.

    A probability may be a Column of ``n`` (the group's count), which the built-in
    ``percentile`` cannot take. ``method`` is ``linear`` or ``higher``. ``extra``
    are further aggregate columns over the rows (sums and the like are not
    affected by the binning).
    """
    keys = list(keys)
    v = df.where(F.col(value).isNotNull())
    counts = v.groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    binned = value_bins(counts, keys, "_x", bins)
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"))
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    levels = [p if isinstance(p, Column) else F.lit(float(p)) for p in probs.values()]
    at = [((F.col("n") - 1) * lv) for lv in levels]
    lo = [F.ceil(a) if method == "higher" else F.floor(a) for a in at]
    per_bin = per_bin.select(
        *keys, "_bin", "_bc",
        F.coalesce(F.sum("_bc").over(order), F.lit(0)).alias("_start"),
        F.sum("_bc").over(whole).alias("n"),
    ).withColumn("_lo", F.array(*[x.cast("bigint") for x in lo])).withColumn(
        "_hi", F.array(*[F.ceil(a).cast("bigint") for a in at])
    )
    hit = F.exists(
        F.concat("_lo", "_hi"),
        lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_bc")),
    )
    wanted = per_bin.where(hit)
    on = [*keys, "_bin"]
    inside = Window.partitionBy(*on).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(wanted, on).withColumn("_end", F.col("_start") + F.sum("_c").over(inside))

    def pick(ranks: str, i: int) -> Column:
        r = F.col(ranks)[i]
        return F.max(F.when((r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")), F.col("_x")))

    picked = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[pick("_lo", i).alias(f"_l{i}") for i in range(len(levels))],
        *[pick("_hi", i).alias(f"_h{i}") for i in range(len(levels))],
    )
    cols = []
    for i, name in enumerate(probs):
        a, b = F.col(f"_l{i}"), F.col(f"_h{i}")
        frac = at[i] - F.floor(at[i])
        cols.append((a if method == "higher" else a + (b - a) * frac).alias(name))
    result = picked.select(*keys, "n", *cols)
    if extra:
        sums = df.groupBy(*keys).agg(*extra)
        result = attach(sums, result, keys, "left")
    return result


def ecdf(df: DataFrame, keys, value: str, second: str, bins: int | None = None) -> DataFrame:
    """Cumulative counts of two samples at every distinct value.

    ``second`` is a boolean column telling the samples apart. Output per
    (keys, value): ``c1, c2`` counts here, ``cum1, cum2`` cumulative counts,
    ``n1, n2`` sample sizes and ``next_value``.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(
        F.count_if(~F.col(second)).alias("c1"), F.count_if(F.col(second)).alias("c2")
    )
    binned = value_bins(counts, keys, "value", bins)
    w = Window.partitionBy(*keys).orderBy("_bin")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per_bin = binned.groupBy(*keys, "_bin").agg(
        F.sum("c1").alias("_b1"), F.sum("c2").alias("_b2"), F.min("value").alias("_first")
    ).select(
        *keys, "_bin",
        F.coalesce(F.sum("_b1").over(before), F.lit(0)).alias("_s1"),
        F.coalesce(F.sum("_b2").over(before), F.lit(0)).alias("_s2"),
        F.sum("_b1").over(whole).alias("n1"),
        F.sum("_b2").over(whole).alias("n2"),
        F.lead("_first").over(w).alias("_next_first"),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("value")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    return binned.join(per_bin, [*keys, "_bin"]).select(
        *keys, "value", "c1", "c2",
        (F.col("_s1") + F.sum("c1").over(run)).alias("cum1"),
        (F.col("_s2") + F.sum("c2").over(run)).alias("cum2"),
        "n1", "n2",
        F.coalesce(F.lead("value").over(inside), F.col("_next_first")).alias("next_value"),
    )


def two_sample(df: DataFrame, keys, value: str, second: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic, Wasserstein-1 distance and Mann-Whitney U per key.

    U is that of the second sample with average ranks for ties, with its normal
    approximation ``z`` (tie-corrected, no continuity correction).
    """
    e = ecdf(df, keys, value, second)
    n1, n2 = F.col("n1"), F.col("n2")
    gap = F.abs(F.col("cum1") / F.nullif(n1, F.lit(0)) - F.col("cum2") / F.nullif(n2, F.lit(0)))
    t = F.col("c1") + F.col("c2")
    below = F.col("cum1") + F.col("cum2") - t
    agg = e.groupBy(*keys).agg(
        F.max("n1").alias("n1"),
        F.max("n2").alias("n2"),
        F.max(gap).alias("ks"),
        F.sum(gap * (F.col("next_value") - F.col("value"))).alias("wasserstein"),
        F.sum(F.col("c2") * (below + (t + 1) / 2.0)).alias("_ranks"),
        F.sum(t.cast("double") * t * t - t).alias("_ties"),
    )
    n = n1 + n2
    u = F.col("_ranks") - n2 * (n2 + 1) / 2.0
    var = n1.cast("double") * n2 / 12.0 * ((n + 1) - F.col("_ties") / F.nullif(n.cast("double") * (n - 1), F.lit(0.0)))
    return agg.select(
        *keys, "n1", "n2", "ks", "wasserstein", u.alias("u"),
        F.when(var > 0, (u - n1 * n2 / 2.0) / F.sqrt(var)).alias("z"),
    )


def rank_sums(df: DataFrame, keys, value: str, flags) -> DataFrame:
    """Per key: ``n`` values, ``ties`` (sum of t^3 - t) and, for every boolean column of ``flags``, how many rows hold and the sum of their average ranks.

    The values are counted and ordered once for all flags: one row per distinct value with a count per flag.
    """
    keys, flags = list(keys), list(flags)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_t"), *[F.count_if(F.col(f)).alias(f"_c{f}") for f in flags])
    binned = value_bins(counts, keys, "_x")
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(*keys, "_bin").agg(F.sum("_t").alias("_bt")).withColumn("_start", F.coalesce(F.sum("_bt").over(before), F.lit(0))).drop("_bt")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("_t").cast("double")
    rank = F.col("_start") + F.coalesce(F.sum("_t").over(inside), F.lit(0)) + (t + 1) / 2
    ranked = binned.join(starts, [*keys, "_bin"]).withColumn("_rank", rank)
    return ranked.groupBy(*keys).agg(
        F.sum("_t").alias("n"), F.sum(t * t * t - t).alias("ties"), *[F.sum(f"_c{f}").alias(f"n_{f}") for f in flags], *[F.sum(F.col(f"_c{f}") * F.col("_rank")).alias(f"ranks_{f}") for f in flags]
    )
