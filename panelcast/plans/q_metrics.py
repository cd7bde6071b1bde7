"""Forecast metrics, segmentation and significance (M)."""

from pyspark.sql import functions as F

from panelcast.functions import timefeatures as tf
from panelcast.operators import metrics as M
from panelcast.operators import significance as S
from panelcast.operators.buckets import over_buckets
from panelcast.operators.joins import shifted
from panelcast.plans import forecasts as fc
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import KEY, TS
from panelcast.session import materialize

MAE = "avg(abs(y - q50))"
RMSE = "sqrt(avg((y - q50) * (y - q50)))"


def pin(q, p):
    return f"greatest({q}::DOUBLE * (y - {p}), ({q}::DOUBLE - 1) * (y - {p}))"


PINBALL = f"(avg({pin(0.1, 'q10')}) + avg({pin(0.5, 'q50')}) + avg({pin(0.9, 'q90')})) / 3"
COVER = "avg((y >= q10 AND y <= q90)::INTEGER)"
WIDTH = "avg(q90 - q10)"
WINKLER = "avg((q90 - q10) + 10 * (greatest(q10 - y, 0) + greatest(y - q90, 0)))"
STANDARD = f"{r(MAE)} AS mae, {r(RMSE)} AS rmse, {r(PINBALL)} AS pinball, {r(COVER)} AS coverage, {r(WINKLER)} AS winkler, count(*) AS n"


@query(
    "m1_m3_m6_m7_all_metrics",
    with_ctes(fc.FC) + f"""SELECT model, series_key, {r(MAE)} AS mae, {r(RMSE)} AS rmse, {r('avg(abs(y - q50) / greatest((abs(y) + abs(q50)) / 2, 1e-9))')} AS smape,
    {r('avg(abs(y - q50) / greatest(abs(y), 1.0))')} AS mape, {r('avg(abs(y - q50)) / avg(abs(y))')} AS nmae, {r(PINBALL)} AS pinball, {r(f"avg({pin(0.1, 'q10')})")} AS pinball_q10,
    {r(f"(avg({pin(0.1, 'q10')} * w) + avg({pin(0.5, 'q50')} * w) + avg({pin(0.9, 'q90')} * w)) / 3")} AS weighted_pinball, {r(COVER)} AS coverage, {r(WIDTH)} AS width, {r(WINKLER)} AS winkler
    FROM (SELECT *, CASE WHEN horizon_h <= 6 THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM sc) GROUP BY 1, 2""",
)
def _(spark, d):
    m = {
        "mae": M.mae(), "rmse": M.rmse(), "smape": M.smape(), "mape": M.mape(), "nmae": M.nmae(), "pinball": M.mean_pinball(),
        "pinball_q10": M.pinball(0.1, "q10"), "weighted_pinball": M.mean_pinball(weight=tf.horizon_weight()),
        "coverage": M.coverage(), "width": M.width(), "winkler": M.winkler(),
    }
    return M.by_groups(fc.scored(spark, d), ["model", KEY], m)


_ANCHORED = "sa AS (SELECT s.*, h.price AS anchor FROM sc s JOIN hf h ON s.series_key = h.series_key AND s.origin_ts = h.ts)"


def _anchored(spark, d):
    s = fc.scored(spark, d)
    now = pn.hourly_filled(spark, d).select(KEY, F.col(TS).alias("origin_ts"), F.col("price").alias("anchor"))
    return s.join(now, [KEY, "origin_ts"])


@query(
    "m4_directional_accuracy",
    with_ctes(fc.FC, _ANCHORED) + f"SELECT model, horizon_h, {r('avg((sign(y - anchor) = sign(q50 - anchor))::INTEGER)')} AS accuracy, count(*) AS n FROM sa GROUP BY 1, 2",
)
def _(spark, d):
    return M.by_groups(_anchored(spark, d), ["model", "horizon_h"], {"accuracy": M.directional_accuracy("anchor"), "n": F.count(F.lit(1))})


@query(
    "m5_spike_mae",
    with_ctes(fc.FC) + f"""SELECT s.model, {r(MAE)} AS spike_mae, count(*) AS n FROM sc s JOIN (SELECT model, quantile_cont(y, 0.9) AS t FROM sc GROUP BY 1) q ON s.model = q.model WHERE y >= t GROUP BY 1""",
)
def _(spark, d):
    return M.spike_mae(fc.scored(spark, d), ["model"])


@query(
    "m8_quantile_bias",
    with_ctes(fc.FC) + f"""SELECT model, {r('avg((y < q10)::INTEGER)')} AS below_q10, {r('avg((y < q50)::INTEGER)')} AS below_q50, {r('avg((y < q90)::INTEGER)')} AS below_q90,
    {r('avg((y > q90)::INTEGER)')} AS above_q90, {r('corr(y, q90 - q10)')} AS corr_y_width FROM sc GROUP BY 1""",
)
def _(spark, d):
    return M.by_groups(fc.scored(spark, d), ["model"], {
        "below_q10": M.below("q10"), "below_q50": M.below("q50"), "below_q90": M.below("q90"),
        "above_q90": F.avg((F.col("y") > F.col("q90")).cast("int")), "corr_y_width": M.corr("y", F.col("q90") - F.col("q10")),
    })


_FLAGS = {
    "all": "true", "peak": "hour(t) BETWEEN 8 AND 20", "off_peak": "NOT (hour(t) BETWEEN 8 AND 20)", "weekend": "isodow(t) >= 6", "weekday": "isodow(t) < 6",
    "crisis_2022": "t >= TIMESTAMP '2022-03-01' AND t < TIMESTAMP '2023-03-01'", "post_crisis": "t >= TIMESTAMP '2023-03-01'", "negative_price": "y < 0", "spike_top10pct": "y >= thr",
}

for _by in ("target_ts", "origin_ts"):
    @query(
        f"m9_segments_by_{_by[:6]}",
        with_ctes(fc.FC) + f""", st AS (SELECT s.*, s.{_by} AS t, q.thr FROM sc s JOIN (SELECT model, quantile_cont(y, 0.9) AS thr FROM sc GROUP BY 1) q ON s.model = q.model)
        SELECT n.model, n.segment, p.mae, p.coverage, p.n FROM (SELECT DISTINCT model, unnest({list(_FLAGS)}) AS segment FROM sc) n LEFT JOIN (
        """ + " UNION ALL ".join(f"SELECT model, '{k}' AS segment, {r(MAE)} AS mae, {r(COVER)} AS coverage, count(*) AS n FROM st WHERE {v} GROUP BY 1" for k, v in _FLAGS.items())
        + ") p ON n.model = p.model AND n.segment = p.segment",
    )
    def _(spark, d, by=_by):
        s = M.with_threshold(fc.scored(spark, d), ["model"])
        flags = tf.segments(by, F.col("y"), F.col("threshold"))
        return M.segment_metrics(s, flags, {"mae": M.mae(), "coverage": M.coverage(), "n": F.count(F.lit(1))}, ["model"])


@query(
    "m9_seasonal_labels",
    with_ctes(fc.FC) + f"""SELECT model, CASE WHEN isodow(target_ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
    CASE WHEN hour(target_ts) BETWEEN 6 AND 9 THEN 'morning_peak' WHEN hour(target_ts) BETWEEN 10 AND 16 THEN 'midday' WHEN hour(target_ts) BETWEEN 17 AND 20 THEN 'evening_peak' ELSE 'night' END AS hour_group,
    {STANDARD} FROM sc GROUP BY 1, 2, 3""",
)
def _(spark, d):
    s = fc.scored(spark, d).withColumns({"day_type": tf.day_type("target_ts"), "hour_group": tf.hour_group("target_ts")})
    return M.by_groups(s, ["model", "day_type", "hour_group"], M.standard())


@query(
    "m10_leaderboard",
    with_ctes(fc.FC) + f"SELECT model, 'overall' AS segment, {STANDARD} FROM sc GROUP BY 1 UNION ALL SELECT model, {fc.SEG} AS segment, {STANDARD} FROM sc GROUP BY 1, 2",
)
def _(spark, d):
    return M.leaderboard(fc.scored(spark, d), ["model"])


@query("m11_per_horizon_curve", with_ctes(fc.FC) + f"SELECT model, horizon_h, {r(MAE)} AS mae, {r(COVER)} AS coverage, {r(WIDTH)} AS width, {r(PINBALL)} AS pinball FROM sc GROUP BY 1, 2")
def _(spark, d):
    return M.by_groups(fc.scored(spark, d), ["model", "horizon_h"], {"mae": M.mae(), "coverage": M.coverage(), "width": M.width(), "pinball": M.mean_pinball()})


@query(
    "m12_against_baselines_on_common_rows",
    with_ctes(fc.FC) + f"""SELECT w.series_key, {r('avg(abs(w.y - w.q50))')} AS mae_model, {r('avg(abs(w.y - a.price))')} AS mae_lag24, {r('avg(abs(w.y - b.price))')} AS mae_lag168,
    {r('1 - avg(abs(w.y - w.q50)) / avg(abs(w.y - b.price))')} AS skill, count(*) AS n FROM weekly w JOIN hf a ON a.series_key = w.series_key AND a.ts = w.target_ts - INTERVAL 24 HOUR
    JOIN hf b ON b.series_key = w.series_key AND b.ts = w.target_ts - INTERVAL 168 HOUR GROUP BY 1""",
)
def _(spark, d):
    h = materialize(pn.hourly_filled(spark, d))
    w = fc.weekly(h)
    for name, lag in (("lag24", 24), ("lag168", 168)):
        w = w.join(shifted(h, {name: "price"}, lag * 3600, ts="target_ts"), [KEY, "target_ts"])
    w = w.dropna(subset=["lag24", "lag168"])
    return M.by_groups(w, [KEY], {
        "mae_model": M.mae(), "mae_lag24": M.mae(p="lag24"), "mae_lag168": M.mae(p="lag168"), "skill": 1 - M.mae() / M.mae(p="lag168"), "n": F.count(F.lit(1)),
    })


_PAIR = """pr AS (SELECT w.series_key, w.horizon_h, w.origin_ts, w.y - w.q50 AS e1, dl.y - dl.q50 AS e2, {seg} AS segment FROM weekly w JOIN daily dl
  ON w.series_key = dl.series_key AND w.origin_ts = dl.origin_ts AND w.horizon_h = dl.horizon_h)""".format(seg=fc.SEG.replace("horizon_h", "w.horizon_h"))


def _pairs(spark, d):
    """Errors of both models on their common forecast keys."""
    from panelcast.functions.predicates import horizon_group

    h = materialize(pn.hourly_filled(spark, d))
    keys = [KEY, "origin_ts", "horizon_h"]
    a = fc.weekly(h).select(*keys, (F.col("y") - F.col("q50")).alias("e1"))
    b = fc.seasonal(h).select(*keys, (F.col("y") - F.col("q50")).alias("e2"))
    return materialize(a.join(b, keys).withColumn("segment", horizon_group()))


def _dm_sql(loss1, loss2, keys, h, flat=True):
    lags = ", ".join(f"lag(d, {k}) OVER (PARTITION BY {keys} ORDER BY horizon_h, origin_ts) AS l{k}" for k in range(1, h))
    g = " + ".join(
        f"avg((d - m) * (l{k} - m))" if flat else f"(1 - {k} / {h}::DOUBLE) * covar_samp(d, l{k})" for k in range(1, h)
    )
    var = f"(avg((d - m) * (d - m)) + 2 * ({g})) / count(*)" if h > 1 else "avg((d - m) * (d - m)) / count(*)"
    fix = f" * sqrt((count(*) + 1 - {2 * h} + {h * (h - 1)} / count(*)::DOUBLE) / count(*))" if flat else ""
    return f""", dd AS (SELECT *, {loss1} - {loss2} AS d FROM pr), dm AS (SELECT *, avg(d) OVER (PARTITION BY {keys}) AS m{', ' + lags if lags else ''} FROM dd)
    SELECT {keys}, count(*) AS n, {r('first(m)', 4)} AS loss_diff_mean, {r(f'first(m) / sqrt({var}){fix}')} AS statistic FROM dm GROUP BY {keys}"""


@query("m13_diebold_mariano_corrected", with_ctes(fc.FC, _PAIR) + _dm_sql("e1 * e1", "e2 * e2", "series_key", 3), digits={"loss_diff_mean": 4})
def _(spark, d):
    return S.diebold_mariano(_pairs(spark, d), [KEY], "e1", "e2", horizon=3)


@query("m14_diebold_mariano_bartlett", with_ctes(fc.FC, _PAIR) + _dm_sql("abs(e1)", "abs(e2)", "series_key", 6, flat=False), digits={"loss_diff_mean": 4})
def _(spark, d):
    return S.diebold_mariano(_pairs(spark, d), [KEY], "e1", "e2", horizon=6, loss=F.abs, weights="bartlett")


@query(
    "m15_segment_test_and_power",
    with_ctes(fc.FC, _PAIR) + f""", dd AS (SELECT *, e1 * e1 - e2 * e2 AS d FROM pr), dm AS (SELECT *, avg(d) OVER (PARTITION BY series_key, segment) AS m FROM dd)
    SELECT series_key, segment, count(*) AS n, {r('first(m) / sqrt(avg((d - m) * (d - m)) / count(*)) * sqrt((count(*) - 1) / count(*)::DOUBLE)')} AS statistic, {r('(1.959964 + 0.8416212) * stddev_pop(abs(e1) - abs(e2)) / sqrt(count(*))')} AS mde_mae,
    {r('avg(abs(e1))')} AS mean_a, {r('avg(abs(e2))')} AS mean_b FROM dm GROUP BY 1, 2""",
)
def _(spark, d):
    """Absolute errors go through the default squared loss, as the callers do."""
    p = _pairs(spark, d).withColumns({"a1": F.abs("e1"), "a2": F.abs("e2")})
    t = S.diebold_mariano(p, [KEY, "segment"], "a1", "a2").drop("loss_diff_mean")
    s = p.groupBy(KEY, "segment").agg(
        S.detectable_difference(F.count(F.lit(1)), F.stddev_pop(F.col("a1") - F.col("a2"))).alias("mde_mae"),
        F.avg("a1").alias("mean_a"), F.avg("a2").alias("mean_b"),
    )
    return t.join(s, [KEY, "segment"])


def _simpson(f: str, steps: int = 4000) -> str:
    """Integral of ``f`` (of ``x``) from 0 to ``abs(statistic)``, as SQL."""
    x = f"(abs(statistic) * i / {steps})"
    weight = f"(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"abs(statistic) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {f.replace('x', x)}))"


_STUDENT_P = f"(1 - 2 * exp(lgamma(n / 2.0::DOUBLE) - lgamma((n - 1) / 2.0::DOUBLE)) / sqrt((n - 1) * pi()) * {_simpson('pow(1 + x * x / (n - 1), -n / 2.0::DOUBLE)')})"
_NORMAL_P = f"(1 - 2 / sqrt(2 * pi()) * {_simpson('pow(2.718281828459045, -0.5::DOUBLE * x * x)')})"


def _dm_p_sql():
    def tested(variant, flat):
        lags = ", ".join(f"lag(d, {k}) OVER (PARTITION BY series_key ORDER BY horizon_h, origin_ts) AS l{k}" for k in (1, 2))
        g = " + ".join(f"avg((d - m) * (l{k} - m))" if flat else f"(1 - {k} / 3::DOUBLE) * covar_samp(d, l{k})" for k in (1, 2))
        fix = " * sqrt((count(*) - 5 + 6 / count(*)::DOUBLE) / count(*))" if flat else ""
        return f"""SELECT '{variant}' AS variant, series_key, count(*) AS n, first(m) AS loss_diff_mean, first(m) / sqrt((avg((d - m) * (d - m)) + 2 * ({g})) / count(*)){fix} AS statistic
        FROM (SELECT *, avg(d) OVER (PARTITION BY series_key) AS m, {lags} FROM (SELECT *, e1 * e1 - e2 * e2 AS d FROM pr)) GROUP BY 2"""

    half = f"CASE WHEN statistic > 0 THEN 1 - {_STUDENT_P} / 2 ELSE {_STUDENT_P} / 2 END"
    return f""", te AS ({tested('flat', True)} UNION ALL {tested('bartlett', False)})
    SELECT variant, series_key, n, {r('loss_diff_mean', 4)} AS loss_diff_mean, {r('statistic')} AS statistic, CASE WHEN variant = 'flat' THEN {r(_STUDENT_P)} ELSE {r(_NORMAL_P)} END AS p_value,
    CASE WHEN variant = 'flat' THEN {r(half)} END AS p_one_sided FROM te"""


@query("m13_m14_p_values", with_ctes(fc.FC, _PAIR) + _dm_p_sql(), digits={"loss_diff_mean": 4})
def _(spark, d):
    p = _pairs(spark, d)
    flat = S.with_p_value(S.diebold_mariano(p, [KEY], "e1", "e2", horizon=3))
    flat = flat.withColumn("p_one_sided", S.p_student(F.col("statistic"), F.col("n") - 1, one_sided=True))
    bart = S.with_p_value(S.diebold_mariano(p, [KEY], "e1", "e2", horizon=3, weights="bartlett"), weights="bartlett")
    return flat.withColumn("variant", F.lit("flat")).unionByName(bart.withColumns({"variant": F.lit("bartlett"), "p_one_sided": F.lit(None).cast("double")}))


@query("m16_bootstrap_interval")
def _(spark, d):
    p = _pairs(spark, d)
    return S.bootstrap_mean(p, F.abs("e1") - F.abs("e2"), [KEY, "origin_ts", "horizon_h"], keys=[KEY])


_TRADE = """tr0 AS (SELECT series_key, ts, price, q50, lag(price) OVER (PARTITION BY series_key ORDER BY ts) AS prev FROM (SELECT w.series_key, w.target_ts AS ts, w.y AS price, w.q50 FROM weekly w WHERE horizon_h = 1)),
tr AS (SELECT *, price > prev AS up, q50 > prev AS say_up, CASE WHEN q50 > prev THEN price - prev - 0.1 ELSE prev - price - 0.1 END AS pnl FROM tr0 WHERE prev IS NOT NULL)"""


@query(
    "m17_trading_evaluation",
    with_ctes(fc.FC, _TRADE) + f"""SELECT t.series_key, {r('avg((up = say_up)::INTEGER)')} AS direction_hit, {r('sum(pnl)')} AS total_pnl, {r('avg(pnl)')} AS mean_pnl, {r('avg(pnl) / stddev_samp(pnl) * sqrt(8760)')} AS sharpe,
    {r('avg((up = say_up)::INTEGER) FILTER (abs(price - prev) > s)')} AS volatile_hit, count(*) AS n FROM tr t JOIN (SELECT series_key, stddev_samp(price) AS s FROM tr GROUP BY 1) v ON t.series_key = v.series_key GROUP BY 1""",
)
def _(spark, d):
    w = fc.weekly(pn.hourly_filled(spark, d)).where("horizon_h = 1").select(KEY, F.col("target_ts").alias(TS), F.col("y").alias("price"), "q50")
    t = over_buckets(w, {"prev": lambda x: F.lag("price").over(x)}, back=1).where("prev IS NOT NULL")
    up, say = F.col("price") > F.col("prev"), F.col("q50") > F.col("prev")
    move = F.col("price") - F.col("prev")
    t = materialize(t.withColumns({"hit": (up == say).cast("int"), "pnl": F.when(say, move).otherwise(-move) - 0.1, "move": F.abs(move)}))
    sd = t.groupBy(KEY).agg(F.stddev_samp("price").alias("_s"))
    return t.join(sd, KEY).groupBy(KEY).agg(
        F.avg("hit").alias("direction_hit"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl"),
        (F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * 8760**0.5).alias("sharpe"),
        F.avg(F.when(F.col("move") > F.col("_s"), F.col("hit"))).alias("volatile_hit"), F.count(F.lit(1)).alias("n"),
    )


@query(
    "m18_direction_confusion",
    with_ctes(fc.FC, _ANCHORED) + """SELECT model, sign(y - anchor)::INTEGER AS actual_dir, count(*) FILTER (sign(q50 - anchor) = -1) AS pred_down, count(*) FILTER (sign(q50 - anchor) = 0) AS pred_flat,
    count(*) FILTER (sign(q50 - anchor) = 1) AS pred_up FROM sa WHERE horizon_h = 1 GROUP BY 1, 2""",
)
def _(spark, d):
    s = _anchored(spark, d).where("horizon_h = 1")
    s = s.select("model", F.signum(F.col("y") - F.col("anchor")).cast("int").alias("actual_dir"), F.signum(F.col("q50") - F.col("anchor")).cast("int").alias("p"))
    w = s.groupBy("model", "actual_dir").pivot("p", [-1, 0, 1]).agg(F.count(F.lit(1))).fillna(0)
    return w.withColumnsRenamed({"-1": "pred_down", "0": "pred_flat", "1": "pred_up"})


@query(
    "m19_reliability_curve",
    with_ctes(fc.FC) + f""", lv AS (SELECT unnest(generate_series(0, 48)) AS i), hw AS (SELECT model, y, q50, (q90 - q10) / 2 AS half FROM sc), mh AS (SELECT model, avg(half) AS mh, list(half) AS l FROM hw GROUP BY 1),
    wq AS (SELECT model, i, mh, list_aggregate(l, 'quantile_cont', """ + "[" + ", ".join(repr(1 - (0.02 + 0.96 / 48 * i)) for i in range(49)) + f"""])[i + 1] AS wa FROM mh, lv)
    SELECT h.model, round(0.02 + 0.02 * i, 4)::DOUBLE AS nominal, {r('avg((y >= q50 - wa * (half / mh) AND y <= q50 + wa * (half / mh))::INTEGER)')} AS covered FROM hw h JOIN wq ON h.model = wq.model GROUP BY 1, 2""",
)
def _(spark, d):
    return M.reliability(fc.scored(spark, d), ["model"])


@query(
    "m20_error_by_hour_and_year",
    with_ctes(fc.FC) + f"""SELECT model, hour(target_ts)::INTEGER AS hour, year(target_ts)::INTEGER AS year, {r(MAE)} AS mae, {r('avg(q50 - y)')} AS bias, {r('quantile_cont(q50 - y, 0.5)')} AS median_error FROM sc GROUP BY 1, 2, 3""",
)
def _(spark, d):
    from panelcast.operators.order_stats import grouped_quantiles

    s = fc.scored(spark, d).withColumns({"hour": F.hour("target_ts"), "year": F.year("target_ts"), "err": F.col("q50") - F.col("y")})
    return grouped_quantiles(s, ["model", "hour", "year"], "err", {"median_error": 0.5}, extra=(M.mae().alias("mae"), M.bias().alias("bias"))).drop("n")
