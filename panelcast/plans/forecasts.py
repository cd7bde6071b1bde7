"""Forecast tables used by the metric, calibration and dispatch queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import baselines as B
from panelcast.operators.joins import truth_for
from panelcast.operators.supervised import supervised
from panelcast.plans import panels as pn
from panelcast.schemas import KEY, TS
from panelcast.session import materialize

TRAIN_END, TEST_START = "2024-01-21", "2024-01-26"
NARROW = [KEY, "origin_ts", "horizon_h", "target_ts", "q10", "q50", "q90", "y"]


def rows(spark: SparkSession, folder: str, h: DataFrame | None = None) -> DataFrame:
    """Supervised rows with the price of the origin and of the slot before it as anchors."""
    h = h if h is not None else pn.hourly_filled(spark, folder)
    return supervised(h.withColumn("price_now", F.col("price")), ["price_now"], [], "price")


def weekly(h: DataFrame) -> DataFrame:
    f = B.weekly_naive(h, "price", train_end=TRAIN_END, first_origin=TRAIN_END)
    return truth_for(f.drop("target_ts"), h, "price").select(NARROW)


def seasonal(h: DataFrame, season: int = 24) -> DataFrame:
    """Seasonal naive with per-horizon residual bands, fitted before TRAIN_END."""
    x = supervised(h, [], [], "price")
    cut = F.lit(TRAIN_END).cast("timestamp")
    model = B.ResidualForecaster(f"sn{season}", lambda r: B.seasonal_point(r, h, "price", season), fill=True)
    model.fit(x.where(F.col("target_ts") < cut))
    return model.predict_quantiles(x.where(F.col("origin_ts") >= cut)).select(NARROW)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Both models scored on the rows after TRAIN_END; written once, as every report reads it several times."""
    h = materialize(pn.hourly_filled(spark, folder))
    w = weekly(h).withColumn("model", F.lit("weekly"))
    s = seasonal(h).withColumn("model", F.lit("daily"))
    return materialize(w.unionByName(s))


FC = pn.HF + f""",
ks AS (SELECT unnest(generate_series(1, 24))::INTEGER AS k),
ends AS (SELECT series_key, min(ts) AS t0, max(ts) AS t1 FROM hf GROUP BY 1),
resid AS (SELECT series_key, price - lag(price, 168) OVER (PARTITION BY series_key ORDER BY ts) AS e FROM hf WHERE ts < TIMESTAMP '{TRAIN_END}'),
dq AS (SELECT series_key, quantile_cont(e, 0.1) AS a, quantile_cont(e, 0.5) AS m, quantile_cont(e, 0.9) AS b FROM resid GROUP BY 1),
fw AS (SELECT h.series_key, h.ts + INTERVAL 168 HOUR - k * INTERVAL 1 HOUR AS origin_ts, k AS horizon_h, h.ts + INTERVAL 168 HOUR AS target_ts,
  price + m + (a - m) AS q10, price + m AS q50, price + m + (b - m) AS q90 FROM hf h, ks, dq, ends
  WHERE h.series_key = dq.series_key AND h.series_key = ends.series_key AND h.ts + INTERVAL 168 HOUR - k * INTERVAL 1 HOUR >= TIMESTAMP '{TRAIN_END}'
  AND h.ts + INTERVAL 168 HOUR - k * INTERVAL 1 HOUR >= t0 + INTERVAL 167 HOUR AND h.ts + INTERVAL 168 HOUR - k * INTERVAL 1 HOUR + INTERVAL 24 HOUR <= t1),
weekly AS (SELECT f.*, h.price AS y FROM fw f JOIN hf h ON f.series_key = h.series_key AND f.target_ts = h.ts),
xs AS (SELECT o.series_key, o.ts AS origin_ts, k AS horizon_h, t.ts AS target_ts, t.price AS y, o.price AS price_now, s.price AS point FROM hf o CROSS JOIN ks
  JOIN hf t ON t.series_key = o.series_key AND t.ts = o.ts + k * INTERVAL 1 HOUR
  LEFT JOIN hf s ON s.series_key = o.series_key AND s.ts = t.ts - INTERVAL 24 HOUR),
sq AS (SELECT series_key, horizon_h, quantile_cont(y - point, 0.1) AS a, quantile_cont(y - point, 0.5) AS m, quantile_cont(y - point, 0.9) AS b FROM xs WHERE target_ts < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2),
daily AS (SELECT x.series_key, x.origin_ts, x.horizon_h, x.target_ts, point + a AS q10, point + m AS q50, point + b AS q90, y FROM xs x JOIN sq ON x.series_key = sq.series_key AND x.horizon_h = sq.horizon_h
  WHERE x.origin_ts >= TIMESTAMP '{TRAIN_END}'),
sc AS (SELECT 'weekly' AS model, series_key, origin_ts, horizon_h, target_ts, q10, q50, q90, y FROM weekly UNION ALL
  SELECT 'daily', series_key, origin_ts, horizon_h, target_ts, q10, q50, q90, y FROM daily)"""
SEG = "CASE WHEN horizon_h <= 6 THEN 'h1_6' WHEN horizon_h <= 18 THEN 'h7_18' ELSE 'h19_24' END"
