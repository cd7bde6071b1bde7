"""Window features (W)."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.functions import timefeatures as tf
from panelcast.functions.fundamentals import residual_load, row_mean
from panelcast.operators import dedupe, fills, grid
from panelcast.operators.buckets import over_buckets, running, slot
from panelcast.operators.expanding import expanding_quantile
from panelcast.operators.rolling import centred, guarded, lag_exprs, rolling_exprs, shaped_profit
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import DAY, KEY, TS

_W = "WINDOW w AS (PARTITION BY series_key ORDER BY ts)"
PRICE_LAGS, LOAD_LAGS = (1, 2, 3, 24, 25, 48, 49, 168, 169), (24, 48, 168, 336)


@query(
    "w1_price_and_load_lags",
    with_ctes(pn.H) + "SELECT series_key, ts, "
    + ", ".join([f"{r(f'lag(price, {k}) OVER w')} AS price_lag{k}h" for k in PRICE_LAGS] + [f"{r(f'lag(load, {k}) OVER w')} AS load_lag{k}h" for k in LOAD_LAGS])
    + f" FROM h {_W}",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price", "load")
    ex = {**lag_exprs("price", PRICE_LAGS, "price"), **lag_exprs("load", LOAD_LAGS, "load")}
    return over_buckets(h, ex, back=336).drop("price", "load")


_SQLF = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query(
    "w2_rolling_statistics",
    with_ctes(pn.H) + "SELECT series_key, ts, "
    + ", ".join(
        f"{r(f'CASE WHEN count(price) OVER w{n} >= {max(2, n // 4)} THEN {_SQLF[s]}(price) OVER w{n} END')} AS price_roll{n}_{s}"
        for n in (24, 168, 336) for s in _SQLF
    )
    + " FROM h WINDOW " + ", ".join(f"w{n} AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (24, 168, 336)),
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price")
    return over_buckets(h, rolling_exprs("price", (24, 168, 336), "price"), back=336).drop("price")


@query(
    "w2_interval_rolling_mean",
    with_ctes(pn.H) + f"""SELECT series_key, ts, {r('avg(price) OVER (PARTITION BY series_key ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING)')} AS price_day_mean FROM hraw""",
)
def _(spark, d):
    """Gap-safe: a RANGE frame over time on the ungridded rows, one day reach."""
    raw = pn.hourly_raw(spark, d).select(KEY, TS, "price")
    mean = {"price_day_mean": lambda w: F.avg("price").over(w.rangeBetween(-24, -1))}
    return over_buckets(raw, mean, back=24).drop("price")


_RES = "load - (gen_wind_onshore + gen_wind_offshore + gen_solar + gen_hydro_ror)"
_MR = f"mr AS (SELECT series_key, ts, {_RES} AS residual_load FROM m)"


@query(
    "w3_expanding_high_residual_load",
    with_ctes(pn.M, _MR) + f"""SELECT series_key, ts, {r('thr')} AS threshold, CASE WHEN residual_load >= thr THEN 1 ELSE 0 END::INTEGER AS is_high_residual_load FROM (
    SELECT *, CASE WHEN count(residual_load) OVER w >= 300 THEN quantile_cont(residual_load, 0.9) OVER w END AS thr FROM mr
    WINDOW w AS (PARTITION BY series_key, hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
def _(spark, d):
    m = pn.market(spark, d)
    mr = m.select(KEY, TS, residual_load(m)["residual_load"].alias("residual_load"), F.hour(TS).alias("hour"))
    q = expanding_quantile(mr, "residual_load", 0.9, "threshold", pos=slot(TS, DAY), keys=(KEY, "hour"), least=300)
    flag = F.coalesce((F.col("residual_load") >= F.col("threshold")).cast("int"), F.lit(0))
    return q.select(KEY, TS, "threshold", flag.alias("is_high_residual_load"))


@query(
    "w3_expanding_high_load_by_hour",
    with_ctes(pn.H) + f"""SELECT series_key, ts, {r('thr')} AS threshold, CASE WHEN net >= thr THEN 1 ELSE 0 END::INTEGER AS is_high_net_load FROM (
    SELECT *, CASE WHEN count(net) OVER w >= 10 THEN quantile_cont(net, 0.9) OVER w END AS thr FROM (SELECT series_key, ts, load - 10 * activity AS net FROM h)
    WINDOW w AS (PARTITION BY series_key, hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
def _(spark, d):
    """Every hour of the day has its own past."""
    h = pn.hourly(spark, d).select(KEY, TS, (F.col("load") - 10 * F.col("activity")).alias("net"), F.hour(TS).alias("hour"))
    q = expanding_quantile(h, "net", 0.9, "threshold", pos=slot(), keys=(KEY, "hour"), least=10)
    return q.select(KEY, TS, "threshold", F.coalesce((F.col("net") >= F.col("threshold")).cast("int"), F.lit(0)).alias("is_high_net_load"))


@query(
    "w4_causal_spike_threshold",
    with_ctes(pn.H) + f"""SELECT series_key, ts, {r('thr')} AS threshold, CASE WHEN price > thr THEN 1 ELSE 0 END::INTEGER AS spike FROM (
    SELECT *, CASE WHEN count(price) OVER w >= 200 THEN quantile_cont(price, 0.9) OVER w END AS thr FROM h
    WINDOW w AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price")
    q = expanding_quantile(h, "price", 0.9, "threshold", pos=slot(), least=200, include_current=False, size=256)
    return q.select(KEY, TS, "threshold", F.coalesce((F.col("price") > F.col("threshold")).cast("int"), F.lit(0)).alias("spike"))


@query(
    "w5_weather_lags",
    with_ctes(pn.M) + "SELECT series_key, ts, "
    + ", ".join(f"{r(f'lag({c}, {k}) OVER w')} AS {c}_lag{k}" for c in ("temp_a", "temp_b") for k in (1, 3, 6, 24)) + f" FROM m {_W}",
)
def _(spark, d):
    m = pn.market(spark, d).select(KEY, TS, "temp_a", "temp_b")
    ex = {n: f for c in ("temp_a", "temp_b") for n, f in lag_exprs(c, (1, 3, 6, 24), c, suffix="").items()}
    return over_buckets(m, ex, back=24, step=DAY).drop("temp_a", "temp_b")


@query(
    "w6_load_weather_lags",
    with_ctes(pn.M) + "SELECT series_key, ts, "
    + ", ".join(f"{r(f'lag(temp_a, {k}) OVER w')} AS temp_a_lag{k}h" for k in (24, 48, 168))
    + f", {r('lag((temp_a + temp_b) / 2, 24) OVER w')} AS weather_mean_temp_lag24h, {r('lag(CASE WHEN temp_a IS NOT NULL THEN greatest(15 - (temp_a + temp_b) / 2, 0) END, 24) OVER w')} AS heating_dh_lag24h FROM m {_W}",
)
def _(spark, d):
    m = pn.market(spark, d).select(KEY, TS, "temp_a", "temp_b").withColumn("mean_temp", row_mean(["temp_a", "temp_b"]))
    m = m.withColumn("heating_dh", F.when(F.col("mean_temp").isNotNull(), F.greatest(15 - F.col("mean_temp"), F.lit(0.0))))
    ex = {
        **lag_exprs("temp_a", (24, 48, 168), "temp_a"), **lag_exprs("mean_temp", (24,), "weather_mean_temp"), **lag_exprs("heating_dh", (24,), "heating_dh"),
    }
    return over_buckets(m, ex, back=168, step=DAY).drop("temp_a", "temp_b", "mean_temp", "heating_dh")


@query(
    "w7_renewable_lags",
    with_ctes(pn.M) + f"""SELECT series_key, ts, lag(gen_wind_onshore + gen_wind_offshore, 24) OVER w AS wind_total_lag24h, lag(gen_wind_onshore + gen_wind_offshore, 168) OVER w AS wind_total_lag168h,
    lag(gen_solar, 24) OVER w AS solar_lag24h, lag(gen_solar, 168) OVER w AS solar_lag168h, lag(load - (gen_wind_onshore + gen_wind_offshore + gen_solar), 24) OVER w AS residual_load_lag24h FROM m {_W}""",
)
def _(spark, d):
    wind = F.col("gen_wind_onshore") + F.col("gen_wind_offshore")
    m = pn.market(spark, d).select(KEY, TS, wind.alias("wind"), "gen_solar", (F.col("load") - (wind + F.col("gen_solar"))).alias("res"))
    ex = {**lag_exprs("wind", (24, 168), "wind_total"), **lag_exprs("gen_solar", (24, 168), "solar"), **lag_exprs("res", (24,), "residual_load")}
    return over_buckets(m, ex, back=168, step=DAY).drop("wind", "gen_solar", "res")


_UP = "OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DOWN = "OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "w8_fill_forward_backward",
    with_ctes(pn.D) + f"""SELECT series_key, ts, {r(f'last_value(price IGNORE NULLS) {_UP}')} AS forward, {r(f'first_value(price IGNORE NULLS) {_DOWN}')} AS backward,
    {r(f'coalesce(last_value(price IGNORE NULLS) {_UP}, first_value(price IGNORE NULLS) {_DOWN})')} AS filled FROM d""",
)
def _(spark, d):
    h = pn.daily(spark, d).select(KEY, TS, "price")
    both = running(h, {"forward": ("last", F.col("price")), "backward": ("next", F.col("price"))}, step=DAY)
    return both.select(KEY, TS, "forward", "backward", F.coalesce("forward", "backward").alias("filled"))


@query(
    "w9_linear_interpolation",
    with_ctes(pn.H) + f"""SELECT series_key, ts, {r('CASE WHEN price IS NOT NULL THEN price WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt)) END')} AS price FROM (
    SELECT series_key, ts, price, last_value(price IGNORE NULLS) {_UP} AS pv, first_value(price IGNORE NULLS) {_DOWN} AS nv,
    last_value(CASE WHEN price IS NOT NULL THEN ts END IGNORE NULLS) {_UP} AS pt, first_value(CASE WHEN price IS NOT NULL THEN ts END IGNORE NULLS) {_DOWN} AS nt FROM h)""",
)
def _(spark, d):
    return fills.interpolate(pn.hourly(spark, d).select(KEY, TS, "price"), "price")


@query(
    "w10_centred_rolling",
    with_ctes(pn.H) + f"""SELECT series_key, ts, {r('CASE WHEN count(price) OVER a = 24 THEN avg(price) OVER a END')} AS centred_mean, {r('CASE WHEN count(price) OVER b = 72 THEN stddev_samp(price) OVER b END')} AS centred_std
    FROM h WINDOW a AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), b AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 36 PRECEDING AND 35 FOLLOWING)""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price")
    return over_buckets(
        h, {"centred_mean": centred(F.avg, "price", 24), "centred_std": centred(F.stddev_samp, "price", 72)}, back=36, ahead=35
    ).drop("price")


@query(
    "w11_rolling_zscore_outliers",
    with_ctes(pn.H) + f"""SELECT series_key, ts, {r('price')} AS price, {r('z')} AS z FROM (SELECT series_key, ts, price, (price - avg(price) OVER a) / nullif(stddev_samp(price) OVER a, 0) AS z
    FROM h WINDOW a AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)) WHERE abs(z) > 3""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price")
    out = over_buckets(
        h, {"_m": centred(F.avg, "price", 168, least=1), "_s": centred(F.stddev_samp, "price", 168, least=1)}, back=84, ahead=83
    )
    z = (F.col("price") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return out.withColumn("z", z).where(F.abs("z") > 3).select(KEY, TS, "price", "z")


_DF = pn.D + ",\n" + pn.sql_filled("df", "d", ["price"])


@query(
    "w12_log_return_volatility",
    with_ctes(_DF) + f"""SELECT series_key, ts, {r('ret')} AS log_return, {r('CASE WHEN count(ret) OVER b = 20 THEN stddev_samp(ret) OVER b * sqrt(252) END')} AS volatility
    FROM (SELECT series_key, ts, ln(price / lag(price) OVER (PARTITION BY series_key ORDER BY ts)) AS ret FROM df) WINDOW b AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    p = fills.ffill_bfill(pn.daily(spark, d).select(KEY, TS, "price"), ["price"], step=DAY)
    ret = over_buckets(p, {"log_return": lambda w: F.ln(F.col("price") / F.nullif(F.lag("price").over(w), F.lit(0.0)))}, back=1, step=DAY)

    def vol(w):
        f = w.rowsBetween(-19, 0)
        return guarded(F.stddev_samp("log_return").over(f) * math.sqrt(252), F.count("log_return").over(f), 20)

    return over_buckets(ret, {"volatility": vol}, back=19, step=DAY).drop("price")


@query(
    "w13_missing_run_lengths",
    with_ctes(pn.D) + f"""SELECT series_key, count(*) AS n_runs, max(n) AS max_run, {r('quantile_cont(n, 0.5)')} AS median_run, {r('avg((n > 1)::INTEGER)')} AS share_long FROM (
      SELECT series_key, count(*) AS n FROM (SELECT series_key, ts, price, count(price) OVER (PARTITION BY series_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM d) WHERE price IS NULL GROUP BY series_key, g) GROUP BY 1""",
)
def _(spark, d):
    from panelcast.operators.order_stats import grouped_quantiles

    runs = dedupe.missing_runs(pn.daily(spark, d), "price", step=DAY)
    runs = runs.withColumn("len", F.col("run_length").cast("double"))
    out = grouped_quantiles(runs, [KEY], "len", {"median_run": 0.5}, extra=(
        F.count(F.lit(1)).alias("n_runs"), F.max("run_length").alias("max_run"), F.avg((F.col("run_length") > 1).cast("int")).alias("share_long"),
    ))
    return out.select(KEY, "n_runs", "max_run", "median_run", "share_long")


@query(
    "w14_gap_detection",
    with_ctes(pn.H) + """SELECT series_key, ts, gap_seconds FROM (SELECT series_key, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_key ORDER BY ts))) // 1000000 AS gap_seconds FROM hraw) WHERE gap_seconds > 3600""",
)
def _(spark, d):
    return dedupe.stamp_gaps(pn.hourly_raw(spark, d)).where("gap_seconds > 3600").select(KEY, TS, "gap_seconds")


@query(
    "w15_step_break_flag",
    with_ctes(pn.H) + """SELECT series_key, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_key ORDER BY ts)) <> 3600000000)::INTEGER, 0) AS is_step_break FROM hraw""",
)
def _(spark, d):
    gaps = dedupe.stamp_gaps(pn.hourly_raw(spark, d))
    return gaps.select(KEY, TS, F.coalesce((F.col("gap_seconds") != 3600).cast("int"), F.lit(0)).alias("is_step_break"))


# local offset of Berlin: +2 h from the last Sunday of March to the last Sunday of October (of September
# before 1996), each at 01:00 UTC
def sql_offset(ts: str) -> str:
    last = "({d} - (isodow({d}) % 7)::INTEGER)::TIMESTAMP + INTERVAL 1 HOUR"
    spring = last.format(d=f"make_date(year({ts}), 3, 31)")
    autumn = last.format(d=f"(CASE WHEN year({ts}) < 1996 THEN make_date(year({ts}), 9, 30) ELSE make_date(year({ts}), 10, 31) END)")
    return f"(CASE WHEN {ts} >= {spring} AND {ts} < {autumn} THEN 7200 ELSE 3600 END)"


@query(
    "w16_daylight_saving_flag",
    with_ctes(pn.D) + f"""SELECT series_key, ts, coalesce((o <> lag(o) OVER (PARTITION BY series_key ORDER BY ts))::INTEGER, 0) AS is_dst_change FROM (SELECT series_key, ts, {sql_offset('ts')} AS o FROM d)""",
)
def _(spark, d):
    p = pn.daily(spark, d).select(KEY, TS)
    return over_buckets(p, {"is_dst_change": lambda w: tf.dst_change(w)}, back=1, step=DAY)


@query(
    "w17_monthly_rolling_mean",
    with_ctes(pn.D) + f"""SELECT series_key, ts, {r('CASE WHEN count(p) OVER b = 3 THEN avg(p) OVER b END')} AS rolling_mean FROM (SELECT series_key, date_trunc('month', ts)::TIMESTAMP AS ts, avg(price) AS p FROM d GROUP BY 1, 2)
    WINDOW b AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    monthly = grid.resample(pn.daily(spark, d), "month", {"p": F.avg("price")})
    f = Window.partitionBy(KEY).orderBy(TS).rowsBetween(-2, 0)  # one row per month
    return monthly.select(KEY, TS, guarded(F.avg("p").over(f), F.count("p").over(f), 3).alias("rolling_mean"))


@query(
    "w18_cumulative_sum",
    with_ctes(pn.H) + f"SELECT series_key, ts, {r('sum(coalesce(price - 50, 0)) OVER (PARTITION BY series_key ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS cumulative FROM h",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, (F.col("price") - 50).alias("pnl"))
    return running(h, {"cumulative": ("sum", F.col("pnl"))}).drop("pnl")


@query(
    "w19_rolling_tail_risk",
    with_ctes(pn.HF) + f"""SELECT series_key, ts, {r('c')} AS rolling_cvar, {r('profit - coalesce(0.1 * greatest(0, -c), 0)')} AS shaped_profit FROM (SELECT series_key, ts, profit, CASE WHEN len(l) >= 4 THEN
    coalesce(list_avg(list_filter(l, lambda x: x <= q)), q) END AS c FROM (SELECT *, list_aggregate(l, 'quantile_cont', 0.05) AS q FROM (SELECT series_key, ts, price - 50 AS profit, list(price - 50) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS l FROM hf)))""",
)
def _(spark, d):
    h = pn.hourly_filled(spark, d).select(KEY, TS, (F.col("price") - 50).alias("profit"))
    return shaped_profit(h, "profit").drop("profit")
