"""Time buckets: window work that never puts a whole series into one task.

A panel may have few and very long series, so ``partitionBy(series)`` alone
does not spread. Two exact schemes are used instead.

* Bounded frames (lags, rolling statistics): rows go to (series, bucket), and
  the rows a frame can reach in a neighbouring bucket are copied there ("halo").
* Unbounded frames (fills, running totals, row numbers): one summary row per
  (series, bucket), an exclusive prefix over the summaries, then a window inside
  each bucket that starts from the carried value. One summary row stands for
  65,536 slots, so the prefix of even a series of 10^11 rows is small. Rows on no
  regular clock (ticks) are cut by their number instead: a range partitioning by
  (series, position) puts them in order, and 65,536 neighbours are a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.schemas import HOUR, KEY, TS
from panelcast.session import materialize

ROWS_PER_BUCKET = 8192
ROWS_PER_RUN = 65536


def slot(ts="ts", step: int = HOUR) -> Column:
    """Integer position of a timestamp on the regular clock."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c) / (step * 1_000_000)).cast("bigint")


def over_buckets(
    df: DataFrame,
    exprs: dict[str, Callable],
    *,
    pos: str | Column | None = None,
    keys=(KEY,),
    back: int = 0,
    ahead: int = 0,
    step: int = HOUR,
    size: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``back``/``ahead`` slots.

    Each value of ``exprs`` takes the WindowSpec and returns a Column. All of
    them share one exchange and one sort.
    """
    size = size or max(ROWS_PER_BUCKET, 4 * (back + ahead))
    p = slot(TS, step) if pos is None else (F.col(pos) if isinstance(pos, str) else pos)
    spread = df.withColumn("_pos", p).withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor((F.col("_pos") - ahead) / size), F.floor((F.col("_pos") + back) / size))),
    )
    # spread by both, else a table partitioned by series would leave a long series in one task
    spread = spread.repartition(*keys, "_bucket")
    w = Window.partitionBy(*keys, "_bucket").orderBy("_pos")
    out = spread.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
    return out.where(F.col("_bucket") == F.floor(F.col("_pos") / size)).drop("_pos", "_bucket")


def _merge(kind: str, carried: Column, own: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
    if kind == "max":
        return F.greatest(carried, own)
    return F.coalesce(own, carried)


def _reduce(kind: str, c: str) -> Column:
    if kind == "sum":
        return F.sum(c)
    if kind == "max":
        return F.max(c)
    pick = F.min_by if kind == "next" else F.max_by
    return pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("_run_pos")))


def _over(kind: str, c: str, by, order: str, edge: int) -> Column:
    """Running reduction up to ``edge`` rows away.

    ``next`` runs over the reversed order: a frame that ends at the partition's
    end would be evaluated anew for every row.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(order) if kind == "next" else order)
    frame = w.rowsBetween(Window.unboundedPreceding, -edge)
    if kind == "sum":
        return F.sum(c).over(frame)
    if kind == "max":
        return F.max(c).over(frame)
    return F.last(c, ignorenulls=True).over(frame)


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    *,
    pos: str | Column | None = None,
    keys=(KEY,),
    inclusive: bool = True,
    step: int = HOUR,
    size: int | None = ROWS_PER_RUN,
    rows: int = ROWS_PER_RUN,
) -> DataFrame:
    """Add unbounded running columns: ``{name: (kind, column)}``.

    Kinds: ``sum`` and ``max`` of the rows so far, ``last`` known value so far,
    ``next`` known value from here on. ``pos`` must be unique per row within the
    keys. All columns share the same two exchanges: one for the bucket summaries
    (combined map-side) and one for the rows. A bucket spans ``size`` positions;
    without a ``size`` it is ``rows`` rows, whatever positions they have, and ``pos``
    may be of any type with an order.
    """
    p = slot(TS, step) if pos is None else (F.col(pos) if isinstance(pos, str) else pos)
    kinds = {name: kind for name, (kind, _) in specs.items()}
    base = df.select("*", p.alias("_run_pos"), *[c.alias(f"_v_{n}") for n, (_, c) in specs.items()])
    base = counted_buckets(base, keys, rows) if size is None else base.withColumn("_run_b", F.floor(F.col("_run_pos") / size))
    summary = base.groupBy(*keys, "_run_b").agg(*[_reduce(k, f"_v_{n}").alias(n) for n, k in kinds.items()])
    carried = summary.select(*keys, "_run_b", *[_over(k, n, keys, "_run_b", 1).alias(f"_c_{n}") for n, k in kinds.items()])
    inside, edge = [*keys, "_run_b"], 0 if inclusive else 1
    own = base.repartition(*inside).select("*", *[_over(k, f"_v_{n}", inside, "_run_pos", edge).alias(f"_o_{n}") for n, k in kinds.items()])
    return own.join(carried, [*keys, "_run_b"]).select(
        *df.columns, *[_merge(k, F.col(f"_c_{n}"), F.col(f"_o_{n}")).alias(n) for n, k in kinds.items()]
    )


def counted_buckets(base: DataFrame, keys, rows: int) -> DataFrame:
    """Add ``_run_b``: numbers that rise along (keys, ``_run_pos``) and change after ``rows`` rows at most.

    Written, as the numbers of a second evaluation could differ: the ranges come from a sample.
    """
    ordered = base.repartitionByRange(*keys, "_run_pos").sortWithinPartitions(*keys, "_run_pos")
    number = F.monotonically_increasing_id()  # the partition in the high digits, then the place in it
    return materialize(ordered.withColumn("_run_b", F.floor(number / rows).cast("bigint")))


def row_position(df: DataFrame, name: str, *, pos, keys=(KEY,), size: int | None = ROWS_PER_RUN, rows: int = ROWS_PER_RUN) -> DataFrame:
    """0-based row number along ``pos`` without a whole-series window."""
    out = running(df, {name: ("sum", F.lit(1))}, pos=pos, keys=keys, inclusive=False, size=size, rows=rows)
    return out.withColumn(name, F.col(name).cast("bigint"))
