"""Supervised layout, folds and baseline forecasts (P), wide forecasts (G8, G9)."""

from pyspark.sql import functions as F

from panelcast.operators import baselines as B
from panelcast.operators import grid, joins
from panelcast.operators import metrics as M
from panelcast.operators.quantreg import LinearQuantiles
from panelcast.operators.supervised import expanding_window_folds, rolling_origin_folds, supervised
from panelcast.plans import forecasts as fc
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import KEY, TS
from panelcast.session import materialize


@query(
    "p1_supervised_layout",
    with_ctes(pn.H) + f"""SELECT o.series_key, o.ts AS origin_ts, k::INTEGER AS horizon_h, t.ts AS target_ts, {r('o.price')} AS price, {r('o.load')} AS load, {r('t.activity')} AS fut_activity, {r('t.price')} AS y
    FROM h o CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS k) JOIN h t ON t.series_key = o.series_key AND t.ts = o.ts + k * INTERVAL 1 HOUR
    WHERE o.price IS NOT NULL AND o.load IS NOT NULL AND t.activity IS NOT NULL AND t.price IS NOT NULL AND t.ts <= TIMESTAMP '2024-01-20 23:00:00'""",
)
def _(spark, d):
    h = pn.hourly(spark, d).withColumn("activity", F.col("activity").cast("double"))
    return supervised(h, ["price", "load"], ["activity"], "price", end="2024-01-20 23:00:00")


_F = """SELECT k::INTEGER AS fold_id, {a} AS train_start, {b} AS train_end, {b} + INTERVAL 24 HOUR AS val_start, {b} + INTERVAL 24 HOUR + INTERVAL {v} DAY AS val_end
FROM (SELECT min(ts) AS a, max(ts) AS z FROM d), (SELECT unnest(generate_series(0, 4)) AS k) WHERE {b} + INTERVAL 24 HOUR + INTERVAL {v} DAY <= z"""


@query("p2_rolling_origin_folds", with_ctes(pn.D) + _F.format(a="a + k * INTERVAL 90 DAY", b="a + k * INTERVAL 90 DAY + INTERVAL 730 DAY", v=90))
def _(spark, d):
    return rolling_origin_folds(pn.daily_raw(spark, d))


@query("p3_expanding_folds", with_ctes(pn.D) + _F.format(a="a", b="z - INTERVAL 450 DAY - INTERVAL 24 HOUR + k * INTERVAL 90 DAY", v=90))
def _(spark, d):
    return expanding_window_folds(pn.daily_raw(spark, d))


_CUT = f"TIMESTAMP '{fc.TRAIN_END}'"


@query(
    "p4_p6_naive_residual_bands",
    with_ctes(fc.FC) + f""", nx AS (SELECT x.*, a.price AS anchor FROM xs x JOIN hf a ON a.series_key = x.series_key AND a.ts = x.origin_ts - INTERVAL 1 HOUR),
    nq AS (SELECT series_key, horizon_h, quantile_cont(y - anchor, 0.1) AS a, quantile_cont(y - anchor, 0.5) AS m, quantile_cont(y - anchor, 0.9) AS b FROM nx WHERE target_ts < {_CUT} GROUP BY 1, 2)
    SELECT x.series_key, x.origin_ts, x.horizon_h, {r('anchor + a')} AS q10, {r('anchor + m')} AS q50, {r('anchor + b')} AS q90 FROM nx x JOIN nq ON x.series_key = nq.series_key AND x.horizon_h = nq.horizon_h WHERE x.origin_ts >= {_CUT}""",
)
def _(spark, d):
    h = materialize(pn.hourly_filled(spark, d))
    lagged = h.join(joins.shifted(h, {"price_lag1h": "price"}, 3600), [KEY, TS])
    x = supervised(lagged, ["price_lag1h"], [], "price")
    cut = F.lit(fc.TRAIN_END).cast("timestamp")
    model = B.ResidualForecaster("naive", "price_lag1h").fit(x.where(F.col("target_ts") < cut))
    return model.predict_quantiles(x.where(F.col("origin_ts") >= cut)).select(KEY, "origin_ts", "horizon_h", "q10", "q50", "q90")


@query("p5_seasonal_naive_daily", with_ctes(fc.FC) + f"SELECT series_key, origin_ts, horizon_h, {r('q10')} AS q10, {r('q50')} AS q50, {r('q90')} AS q90 FROM daily")
def _(spark, d):
    return fc.seasonal(materialize(pn.hourly_filled(spark, d))).select(KEY, "origin_ts", "horizon_h", "q10", "q50", "q90")


@query("p7_p11_weekly_naive_with_truth", with_ctes(fc.FC) + f"SELECT series_key, origin_ts, horizon_h, target_ts, {r('q10')} AS q10, {r('q50')} AS q50, {r('q90')} AS q90, {r('y')} AS y FROM weekly")
def _(spark, d):
    return fc.weekly(pn.hourly_filled(spark, d))


@query(
    "p8_lag_baselines_at_target",
    with_ctes(fc.FC) + f"""SELECT x.series_key, x.origin_ts, x.horizon_h, {r('a.load')} AS lag24, {r('b.load')} AS lag168 FROM xs x
    LEFT JOIN hf a ON a.series_key = x.series_key AND a.ts = x.target_ts - INTERVAL 24 HOUR LEFT JOIN hf b ON b.series_key = x.series_key AND b.ts = x.target_ts - INTERVAL 168 HOUR""",
)
def _(spark, d):
    h = pn.hourly_filled(spark, d)
    x = supervised(h, [], [], "price").select(KEY, "origin_ts", "horizon_h", "target_ts")
    return B.lag_baselines(x, h, "load", {"lag24": 24, "lag168": 168}).drop("target_ts")


@query(
    "p9_ensemble_mean",
    with_ctes(fc.FC) + f"SELECT series_key, origin_ts, horizon_h, {r('avg(q10)')} AS q10, {r('avg(q50)')} AS q50, {r('avg(q90)')} AS q90 FROM sc GROUP BY 1, 2, 3",
)
def _(spark, d):
    h = materialize(pn.hourly_filled(spark, d))
    return B.ensemble([fc.weekly(h), fc.seasonal(h)])


@query("p10_linear_quantile_regression")
def _(spark, d):
    """Pooled quantile regression of the next day's price on current and last-day values."""
    h = pn.hourly_filled(spark, d)
    back = joins.shifted(h, {"price_lag24h": "price"}, 24 * 3600)
    x = supervised(h.join(back, [KEY, TS]), ["price", "price_lag24h"], [], "price")
    x = x.withColumn("horizon", F.col("horizon_h") / 24.0)
    cut = F.lit(fc.TRAIN_END).cast("timestamp")
    model = LinearQuantiles(["price", "price_lag24h", "horizon"]).fit(x.where(F.col("target_ts") < cut))
    return model.predict_quantiles(x.where(F.col("origin_ts") >= cut)).select(KEY, "origin_ts", "horizon_h", "q10", "q50", "q90", "y")


_CV_FOLDS = """ends2 AS (SELECT min(ts) AS a, max(ts) AS z FROM hf),
folds AS (SELECT k::INTEGER AS fold_id, a + k * INTERVAL 5 DAY AS train_start, a + k * INTERVAL 5 DAY + INTERVAL 10 DAY AS train_end,
  a + k * INTERVAL 5 DAY + INTERVAL 11 DAY AS val_start, a + k * INTERVAL 5 DAY + INTERVAL 16 DAY AS val_end FROM ends2, (SELECT unnest(generate_series(0, 2)) AS k)
  WHERE a + k * INTERVAL 5 DAY + INTERVAL 16 DAY <= z)"""


@query(
    "p12_cross_validation",
    with_ctes(fc.FC, _CV_FOLDS) + f""", lx AS (SELECT 'naive' AS model, series_key, origin_ts, horizon_h, y, price_now AS anchor FROM xs UNION ALL SELECT 'sn24', series_key, origin_ts, horizon_h, y, point FROM xs),
    tr AS (SELECT fold_id, model, series_key, horizon_h, quantile_cont(y - anchor, 0.1) AS a, quantile_cont(y - anchor, 0.5) AS m, quantile_cont(y - anchor, 0.9) AS b FROM lx JOIN folds ON origin_ts BETWEEN train_start AND train_end GROUP BY ALL),
    va AS (SELECT tr.fold_id, tr.model, {fc.SEG.replace('horizon_h', 'lx.horizon_h')} AS segment, y, anchor + a AS q10, anchor + m AS q50, anchor + b AS q90 FROM lx JOIN folds ON origin_ts BETWEEN val_start AND val_end
      JOIN tr ON tr.fold_id = folds.fold_id AND tr.model = lx.model AND tr.series_key = lx.series_key AND tr.horizon_h = lx.horizon_h),
    per AS (SELECT model, fold_id, segment, avg(abs(y - q50)) AS mae, avg((y BETWEEN q10 AND q90)::INTEGER) AS coverage FROM va WHERE q50 IS NOT NULL GROUP BY ALL)
    SELECT model, segment, count(*) AS n_folds, {r('avg(mae)')} AS mae_mean, {r('stddev_samp(mae)')} AS mae_std, {r('avg(coverage)')} AS coverage_mean FROM per GROUP BY ALL""",
)
def _(spark, d):
    """All folds and both models as one grouped plan: fold is just another key."""
    h = materialize(pn.hourly_filled(spark, d))
    x = B.seasonal_point(fc.rows(spark, d, h), h, "price", 24, out="sn24")
    folds = rolling_origin_folds(h, n_folds=3, train_days=10, val_days=5, gap_hours=24)
    long = x.withColumn(TS, F.col("origin_ts")).unpivot(
        [KEY, TS, "origin_ts", "target_ts", "horizon_h", "y"], ["price_now", "sn24"], "model", "anchor"
    ).withColumn("model", F.when(F.col("model") == "price_now", "naive").otherwise(F.col("model")))
    f = joins.folds_join(long, folds)
    keys = ["fold_id", "model", KEY]
    table = B.residual_quantiles(f.where("part = 'train'"), "anchor", "y", keys=keys)
    pred = B.add_residual_quantiles(f.where("part = 'val'"), "anchor", table, keys=keys).where("q50 IS NOT NULL")
    from panelcast.functions.predicates import horizon_group

    per = M.by_groups(pred.withColumn("segment", horizon_group()), ["model", "fold_id", "segment"], {"mae": M.mae(), "coverage": M.coverage()})
    return per.groupBy("model", "segment").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"), F.avg("coverage").alias("coverage_mean")
    )


@query(
    "g8_forecast_wide",
    with_ctes(fc.FC) + "SELECT series_key, origin_ts, " + ", ".join(
        f"{r(f'max({q}) FILTER (horizon_h = {k})')} AS load_{q}_h{k}" for q in ("q10", "q50", "q90") for k in range(1, 25)
    ) + " FROM weekly GROUP BY 1, 2",
)
def _(spark, d):
    return grid.forecast_wide(fc.weekly(pn.hourly_filled(spark, d)))


@query("g9_forecast_long", with_ctes(fc.FC) + f"SELECT series_key, origin_ts, horizon_h, {r('q10')} AS q10, {r('q50')} AS q50, {r('q90')} AS q90 FROM weekly")
def _(spark, d):
    return grid.forecast_long(grid.forecast_wide(fc.weekly(pn.hourly_filled(spark, d))))
