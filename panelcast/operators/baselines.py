"""Baseline forecasters as joins and grouped quantiles; their state is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.buckets import over_buckets, running, slot
from panelcast.operators.joins import shifted
from panelcast.operators.order_stats import grouped_quantiles
from panelcast.schemas import HOUR, KEY, QUANTILES, TS


def seasonal_point(rows: DataFrame, df: DataFrame, value: str, season: int, *, keys=(KEY,), step: int = HOUR, out: str = "point") -> DataFrame:
    """Value one season before the target stamp (NULL where unknown)."""
    past = shifted(df, {out: value}, season * step, keys=keys, ts="target_ts")
    return rows.join(past, [*keys, "target_ts"], "left")


def fill_points(rows: DataFrame, column: str = "point", *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    """Missing anchors take the neighbouring origin's, forward first, per series and horizon."""
    by = [*keys, "horizon_h"]
    pos = slot("origin_ts", step)
    f = running(rows, {"_f": ("last", F.col(column)), "_n": ("next", F.col(column))}, pos=pos, keys=by)
    return f.withColumn(column, F.coalesce("_f", "_n")).drop("_f", "_n")


def residual_quantiles(train: DataFrame, point: str, y: str, *, keys=(KEY,), by_horizon: bool = True) -> DataFrame:
    """Residual quantiles per key and horizon, with the pooled ones as fallback (``horizon_h`` NULL)."""
    e = train.withColumn("_e", F.col(y) - F.col(point))
    pooled = grouped_quantiles(e, keys, "_e", QUANTILES).withColumn("horizon_h", F.lit(None).cast("int"))
    if not by_horizon:
        return pooled
    return grouped_quantiles(e, [*keys, "horizon_h"], "_e", QUANTILES).unionByName(pooled)


def add_residual_quantiles(rows: DataFrame, point: str, table: DataFrame, *, keys=(KEY,)) -> DataFrame:
    """``point`` plus the residual quantiles of the row's horizon, or the pooled ones."""
    keys = list(keys)
    h = table.where("horizon_h IS NOT NULL").select(*keys, "horizon_h", *[F.col(q).alias(f"_h_{q}") for q in QUANTILES])
    p = table.where("horizon_h IS NULL").select(*keys, *[F.col(q).alias(f"_p_{q}") for q in QUANTILES])
    joined = rows.join(h, [*keys, "horizon_h"], "left").join(p, keys, "left")
    return joined.select(
        *rows.columns, *[(F.col(point) + F.coalesce(F.col(f"_h_{q}"), F.col(f"_p_{q}"))).alias(q) for q in QUANTILES]
    )


class ResidualForecaster:
    """``fit`` / ``predict_quantiles`` / ``predict_point`` / ``save`` / ``load`` around a point column.

    ``point`` names the anchor column of the rows, or maps rows to rows with that column.
    """

    def __init__(self, name: str, point, *, keys=(KEY,), fill: bool = False, step: int = HOUR):
        self.name, self.point, self.keys, self.fill, self.step = name, point, keys, fill, step
        self.table: DataFrame | None = None

    def _rows(self, rows: DataFrame) -> DataFrame:
        if callable(self.point):
            return self.point(rows)
        if self.point not in rows.columns:
            raise KeyError(f"{self.name} needs the column {self.point!r}")
        return rows.withColumn("point", F.col(self.point))

    def fit(self, rows: DataFrame, y: str = "y") -> ResidualForecaster:
        self.table = residual_quantiles(self._rows(rows), "point", y, keys=self.keys)
        return self

    def predict_quantiles(self, rows: DataFrame) -> DataFrame:
        if self.table is None:
            raise RuntimeError("fit or load first")
        r = self._rows(rows)
        if self.fill:
            r = fill_points(r, keys=self.keys, step=self.step)
        return add_residual_quantiles(r, "point", self.table, keys=self.keys).drop("point").withColumn("model", F.lit(self.name))

    def predict_point(self, rows: DataFrame) -> DataFrame:
        return self.predict_quantiles(rows).select(*rows.columns, F.col("q50").alias("point"))

    def save(self, path: str) -> None:
        self.table.write.mode("errorifexists").parquet(path)

    def load(self, spark, path: str) -> ResidualForecaster:
        self.table = spark.read.parquet(path)
        return self


def weekly_naive(
    df: DataFrame, value: str, *, train_end: str, first_origin: str | None = None, lag: int = 168, horizon: int = 24,
    keys=(KEY,), step: int = HOUR,
) -> DataFrame:
    """Value ``lag`` slots before the target plus the median residual, with a band around it.

    Forecasts come straight from the shifted series: nothing is looked up per origin.
    """
    keys = list(keys)
    narrow = df.select(*keys, TS, F.col(value).alias("v"))
    train = narrow.where(F.col(TS) < F.lit(train_end).cast("timestamp"))
    resid = over_buckets(train, {"e": lambda w: F.col("v") - F.lag("v", lag).over(w)}, keys=keys, back=lag, step=step)
    bands = grouped_quantiles(resid, keys, "e", QUANTILES).drop("n")
    ends = df.groupBy(*keys).agg(F.min(slot(TS, step)).alias("_a"), F.max(slot(TS, step)).alias("_z"))
    state = bands.join(ends, keys)
    rows = shifted(narrow, {"v": "v"}, lag * step, keys=keys, ts="target_ts").withColumn(
        "horizon_h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    origin = slot("target_ts", step) - F.col("horizon_h")
    rows = rows.withColumn("origin_ts", F.timestamp_micros(origin * (step * 1_000_000)))
    if first_origin is not None:
        rows = rows.where(F.col("origin_ts") >= F.lit(first_origin).cast("timestamp"))
    rows = rows.join(state, keys).where((origin >= F.col("_a") + lag - 1) & (origin <= F.col("_z") - horizon))
    mid = F.col("v") + F.col("q50")
    return rows.select(
        *keys, "origin_ts", "horizon_h", "target_ts",
        (mid + (F.col("q10") - F.col("q50"))).alias("q10"), mid.alias("_m"), (mid + (F.col("q90") - F.col("q50"))).alias("q90"),
    ).withColumnRenamed("_m", "q50")


def ensemble(members: list[DataFrame], keys=(KEY, "origin_ts", "horizon_h")) -> DataFrame:
    """Mean quantile per forecast key over the members."""
    rows = members[0]
    for m in members[1:]:
        rows = rows.unionByName(m, allowMissingColumns=True)
    return rows.groupBy(*keys).agg(*[F.avg(q).alias(q) for q in QUANTILES])


def lag_baselines(forecasts: DataFrame, df: DataFrame, value: str, lags: dict[str, int], *, keys=(KEY,), step: int = HOUR) -> DataFrame:
    """Add the value ``lag`` slots before each target, one column per named baseline."""
    out = forecasts
    for name, lag in lags.items():
        out = seasonal_point(out, df, value, lag, keys=keys, step=step, out=name)
    return out
