"""Joins on time: as-of, shifted, event-aligned, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.buckets import ROWS_PER_RUN, running
from panelcast.schemas import HOUR, KEY, TS


def hours(n) -> Column:
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.make_dt_interval(hours=n.cast("int"))


def seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def asof_backward(left: DataFrame, right: DataFrame, columns, *, keys=(KEY,), step: int | None = None, rows: int = ROWS_PER_RUN) -> DataFrame:
    """Latest right values stamped at or before each left row, carried per column.

    Both sides are laid on one time line and the right values carried forward over
    buckets of ``rows`` rows, so neither a range join nor a whole-series sort is needed
    and ticks of any density spread over tasks. With a ``step`` (rows on a regular clock)
    a bucket is that many steps instead, which saves the ordering.
    """
    keys = list(keys)
    l = left.select("*", F.lit(1).alias("_side"))
    r = right.select(*keys, TS, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    line = F.unix_micros(TS) * 2 + F.col("_side")
    out = running(
        both, {c: ("last", F.col(f"_r_{c}")) for c in columns},
        pos=line, keys=keys, size=rows * step * 2_000_000 if step else None, rows=rows,
    )
    return out.where(F.col("_side") == 1).select(*left.columns, *columns)


def shifted(df: DataFrame, columns: dict[str, str], seconds_later: int, *, keys=(KEY,), ts: str = TS) -> DataFrame:
    """``{new name: column}`` re-stamped ``seconds_later``, ready for an equi-join: a gap-safe lag."""
    return df.select(
        *keys, (F.col(TS) + seconds(seconds_later)).alias(ts), *[F.col(c).alias(n) for n, c in columns.items()]
    )


def truth_for(forecasts: DataFrame, actuals: DataFrame, value: str, *, keys=(KEY,), out: str = "y", step: int = HOUR) -> DataFrame:
    """Actual value at ``origin + horizon``; rows without one are dropped."""
    stamp = F.timestamp_micros(F.unix_micros("origin_ts") + F.col("horizon_h").cast("bigint") * (step * 1_000_000))
    f = forecasts.withColumn("target_ts", stamp)
    a = actuals.where(F.col(value).isNotNull()).select(*keys, F.col(TS).alias("target_ts"), F.col(value).alias(out))
    return f.join(a, [*keys, "target_ts"])


def folds_join(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows x folds with a ``part`` of train or val. The fold table has one row per fold."""
    t, f = F.col(TS), folds
    in_train = (t >= F.col("train_start")) & (t <= F.col("train_end"))
    in_val = (t >= F.col("val_start")) & (t <= F.col("val_end"))
    joined = df.join(F.broadcast(f), in_train | in_val)
    return joined.withColumn("part", F.when(in_train, "train").otherwise("val"))


def around_anchor(df: DataFrame, month: int, day: int, within_hours: int) -> DataFrame:
    """Rows near a yearly anchor date with ``anchor_year`` and ``hours_from_anchor``.

    The candidate anchors of a row are the three neighbouring years, so this
    needs no join at all.
    """
    year = F.year(TS)
    anchors = F.transform(
        F.array(year - 1, year, year + 1), lambda y: F.make_timestamp(y, F.lit(month), F.lit(day), F.lit(0), F.lit(0), F.lit(0))
    )
    out = df.withColumn("_anchor", F.explode(anchors)).withColumn(
        "hours_from_anchor", ((F.unix_micros(TS) - F.unix_micros("_anchor")) / 3_600_000_000).cast("double")
    )
    return (
        out.where(F.abs("hours_from_anchor") <= within_hours)
        .withColumn("anchor_year", F.year("_anchor"))
        .drop("_anchor")
    )
