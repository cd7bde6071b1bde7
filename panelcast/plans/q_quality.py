"""Aggregations, profiles and imputation audits (A)."""

from statistics import NormalDist

from pyspark.sql import functions as F

from panelcast.functions import timefeatures as tf
from panelcast.functions.fundamentals import residual_load_skipping
from panelcast.operators import constraints as K
from panelcast.operators import fills, grid
from panelcast.operators import quality as Q
from panelcast.operators.joins import hours
from panelcast.operators.order_stats import grouped_quantiles, two_sample
from panelcast.plans import panels as pn
from panelcast.plans.q_features import SUN
from panelcast.plans.q_grid import HS, BOUNDS
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import DAY, HOUR, KEY, TS
from panelcast.session import materialize

GENS = list(pn.GENERATION.values())
_IN = ", ".join(GENS)


@query(
    "a1_a2_scalers",
    with_ctes(pn.M) + " UNION ALL ".join(
        f"SELECT series_key, '{n}' AS metric, {r(f'avg({e})')} AS mean, {r(f'coalesce(nullif(stddev_pop({e}), 0), 1)')} AS scale FROM m WHERE ts < TIMESTAMP '2000-01-01' GROUP BY 1"
        for n, e in (("price", "asinh(price)"), ("load", "load"), ("residual_load", "load - coalesce(gen_wind_onshore, 0) - coalesce(gen_wind_offshore, 0) - coalesce(gen_solar, 0) - coalesce(gen_hydro_ror, 0)"),
                     ("wind", "gen_wind_onshore + gen_wind_offshore"), ("solar", "gen_solar"), ("constant", "series_key IS NULL"))
        if n != "constant"
    ),
)
def _(spark, d):
    m = pn.market(spark, d).where(F.col(TS) < F.lit("2000-01-01").cast("timestamp"))
    return Q.fit_scaler(m, {
        "price": F.asinh("price"), "load": F.col("load"), "residual_load": residual_load_skipping(m),
        "wind": F.col("gen_wind_onshore") + F.col("gen_wind_offshore"), "solar": F.col("gen_solar"),
    }, [KEY])


@query(
    "a3_null_rates_grouping_sets",
    with_ctes(pn.M) + f"""SELECT metric, year, month, {r('avg((value IS NULL)::INTEGER)')} AS null_rate, count(*) AS n FROM (SELECT metric, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, value FROM m UNPIVOT INCLUDE NULLS (value FOR metric IN ({_IN})))
    GROUP BY GROUPING SETS ((metric), (metric, year), (metric, month))""",
)
def _(spark, d):
    return Q.null_rates(pn.market(spark, d), GENS)


@query(
    "a4_column_profile",
    with_ctes(pn.M) + f"""SELECT metric, min(value) AS min, {r('avg(value)')} AS mean, max(value) AS max, count(*) FILTER (value IS NULL) AS n_null, {r('avg((value IS NULL)::INTEGER)')} AS null_rate FROM (FROM m UNPIVOT INCLUDE NULLS (value FOR metric IN ({_IN}))) GROUP BY 1""",
)
def _(spark, d):
    return Q.profile(pn.market(spark, d), GENS)


_PS = {f"p{int(p * 100)}": p for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)}


@query(
    "a5_describe_by_split",
    with_ctes(pn.H, HS) + f"SELECT split, count(price) AS n, {r('avg(price)')} AS mean, {r('stddev_samp(price)')} AS std, min(price) AS min, max(price) AS max, ".replace("min(price)", r("min(price)")).replace("max(price)", r("max(price)"))
    + ", ".join(f"{r(f'quantile_cont(price, {p})')} AS {n}" for n, p in _PS.items()) + " FROM hs GROUP BY 1",
)
def _(spark, d):
    from panelcast.functions.predicates import split_label

    h = pn.hourly(spark, d).withColumn("split", split_label(BOUNDS))
    return grouped_quantiles(h, ["split"], "price", _PS, extra=(
        F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.min("price").alias("min"), F.max("price").alias("max"),
    ))


@query(
    "a6_moments",
    with_ctes(pn.H) + f"""SELECT series_key, {r('avg(price)')} AS mean, {r('quantile_cont(price, 0.5)')} AS median, {r('stddev_samp(price)')} AS std, {r('avg(power(price - m, 3)) / power(avg(power(price - m, 2)), 1.5)')} AS skew, {r('avg(power(price - m, 4)) / power(avg(power(price - m, 2)), 2) - 3')} AS kurtosis,
    {r('avg((price < 20)::INTEGER)')} AS share_low, {r('avg((price > 200)::INTEGER)')} AS share_high FROM (SELECT *, avg(price) OVER (PARTITION BY series_key) AS m FROM h) GROUP BY 1""",
)
def _(spark, d):
    return grouped_quantiles(pn.hourly(spark, d), [KEY], "price", {"median": 0.5}, extra=(
        F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.skewness("price").alias("skew"), F.kurtosis("price").alias("kurtosis"),
        F.avg((F.col("price") < 20).cast("int")).alias("share_low"), F.avg((F.col("price") > 200).cast("int")).alias("share_high"),
    )).drop("n")


@query(
    "a7_yearly_statistics",
    with_ctes(pn.D) + f"SELECT series_key, year(ts)::INTEGER AS year, {r('avg(price)')} AS mean, {r('quantile_cont(price, 0.5)')} AS median, {r('stddev_samp(price)')} AS std, {r('avg((price < 100)::INTEGER)')} AS share_low, {r('quantile_cont(price, 0.99)')} AS p99 FROM d GROUP BY 1, 2",
)
def _(spark, d):
    p = pn.daily(spark, d).withColumn("year", F.year(TS))
    return grouped_quantiles(p, [KEY, "year"], "price", {"median": 0.5, "p99": 0.99}, extra=(
        F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.avg((F.col("price") < 100).cast("int")).alias("share_low"),
    )).drop("n")


@query("a7_rollup_year_month", with_ctes(pn.D) + f"SELECT year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, {r('avg(price)')} AS mean, count(price) AS n FROM d GROUP BY ROLLUP (1, 2)")
def _(spark, d):
    p = pn.daily(spark, d)
    return p.rollup(F.year(TS).alias("year"), F.month(TS).alias("month")).agg(F.avg("price").alias("mean"), F.count("price").alias("n"))


@query(
    "a8_low_frequency_cube",
    with_ctes(pn.H) + f"SELECT series_key, hour(ts)::INTEGER AS hour, {r('avg((price < 20)::INTEGER)')} AS share_low, {r('avg(price) FILTER (price < 20)')} AS mean_depth FROM h GROUP BY CUBE (1, 2)",
)
def _(spark, d):
    h = pn.hourly(spark, d)
    low = F.col("price") < 20
    return h.cube(KEY, F.hour(TS).alias("hour")).agg(F.avg(low.cast("int")).alias("share_low"), F.avg(F.when(low, F.col("price"))).alias("mean_depth"))


@query(
    "a9_heat_map_median",
    with_ctes(pn.H) + "SELECT hour(ts)::INTEGER AS hour, " + ", ".join(f"{r(f'quantile_cont(price, 0.5) FILTER (isodow(ts) = {k})')} AS dow_{k}" for k in range(1, 8)) + " FROM h GROUP BY 1",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(F.hour(TS).alias("hour"), (F.weekday(TS) + 1).alias("dow"), "price")
    med = grouped_quantiles(h, ["hour", "dow"], "price", {"median": 0.5})
    return grid.pivot_wide(med, ["hour"], "dow", range(1, 8), F.first("median"), rename=lambda k: f"dow_{k}")


@query(
    "a10_hourly_profiles",
    with_ctes(pn.H) + f"SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(ts)::INTEGER AS hour, {r('avg(price)')} AS mean, {r('stddev_samp(price)')} AS std FROM h GROUP BY 1, 2",
)
def _(spark, d):
    return pn.hourly(spark, d).groupBy(tf.day_type().alias("day_type"), F.hour(TS).alias("hour")).agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"))


@query(
    "a11_holiday_dip",
    with_ctes(pn.D) + f"SELECT series_key, year(ts)::INTEGER AS year, {r('avg(price) FILTER (month(ts) = 1 AND day(ts) = 1) / quantile_cont(price, 0.5)')} AS ratio FROM d GROUP BY 1, 2",
)
def _(spark, d):
    p = pn.daily(spark, d).withColumn("year", F.year(TS))
    first = F.avg(F.when((F.month(TS) == 1) & (F.dayofmonth(TS) == 1), F.col("price"))).alias("first")
    q = grouped_quantiles(p, [KEY, "year"], "price", {"median": 0.5}, extra=(first,))
    return q.select(KEY, "year", (F.col("first") / F.col("median")).alias("ratio"))


@query(
    "a12_iqr_outliers",
    with_ctes(pn.H) + f"""SELECT h.series_key, count(*) AS n, {r('min(price)')} AS lowest, {r('max(price)')} AS highest FROM h JOIN (SELECT series_key, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM h GROUP BY 1) q ON h.series_key = q.series_key
    WHERE price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1) GROUP BY 1""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, "price")
    q = grouped_quantiles(h, [KEY], "price", {"q1": 0.25, "q3": 0.75}).drop("n")
    w = 3 * (F.col("q3") - F.col("q1"))
    out = h.join(q, KEY).where((F.col("price") < F.col("q1") - w) | (F.col("price") > F.col("q3") + w))
    return out.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


_REN = "(coalesce(gen_wind_onshore, 0) + coalesce(gen_wind_offshore, 0) + coalesce(gen_solar, 0) + coalesce(gen_hydro_ror, 0))"


_ALL = "(" + " + ".join(f"coalesce({g}, 0)" for g in pn.GENERATION.values()) + ")"


@query(
    "a13_generation_mix",
    with_ctes(pn.M) + f"SELECT date_trunc('month', ts)::TIMESTAMP AS month, {r(f'100 * sum({_REN}) / nullif(sum({_ALL}), 0)')} AS renewable_share, {', '.join(r(f'100 * coalesce(sum({g}), 0) / nullif(sum({_ALL}), 0)') + f' AS {g}_share' for g in pn.GENERATION.values())} FROM m GROUP BY 1",
)
def _(spark, d):
    m = pn.market(spark, d)
    ren = F.col("load") - residual_load_skipping(m)
    every = sum((F.coalesce(F.col(g), F.lit(0.0)) for g in pn.GENERATION.values()), F.lit(0.0))
    total = F.nullif(F.sum(every), F.lit(0.0))
    return m.groupBy(F.date_trunc("month", TS).alias("month")).agg(
        (100 * F.sum(ren) / total).alias("renewable_share"),
        *[(100 * F.coalesce(F.sum(g), F.lit(0.0)) / total).alias(f"{g}_share") for g in pn.GENERATION.values()],
    )


_FLOWS = [f"{p}_to_DELU" for p in ("FR", "AT", "CH")] + [f"DELU_to_{p}" for p in ("FR", "AT", "CH")]
_CC = ["price", "load", "temp_a", "temp_b", *GENS, *_FLOWS]


@query(
    "a14_correlations",
    with_ctes(pn.M) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr FROM m" for i, a in enumerate(_CC) for b in _CC[i + 1:]),
)
def _(spark, d):
    return Q.correlations(pn.market(spark, d), _CC)


@query(
    "a15_missing_together",
    with_ctes(pn.M) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr(({a} IS NULL)::INTEGER, ({b} IS NULL)::INTEGER)')} AS corr FROM m" for i, a in enumerate(GENS) for b in GENS[i + 1:]),
)
def _(spark, d):
    flags = pn.market(spark, d).select([F.col(c).isNull().cast("double").alias(c) for c in GENS])
    return Q.correlations(flags, GENS)


@query(
    "a16_missing_by_decile",
    with_ctes(pn.M) + f""", e AS (SELECT list_sort(list_distinct(quantile_cont(load, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM m)
    SELECT greatest(len(list_filter(edges, lambda x: x < load)), 1)::INTEGER AS bucket, {r('avg((gen_solar IS NULL)::INTEGER)')} AS p_missing, count(*) AS n FROM m, e WHERE load IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return Q.missing_by_decile(pn.market(spark, d), "gen_solar", "load")


_RULES = {
    "negative_generation:gen_solar": "gen_solar - 30 < -1e-3", "solar_at_full_night:gen_solar": "abs(gen_solar - 30) > 1 AND elev < -6",
    "both_directions_positive:FR_to_DELU": "FR_to_DELU > 1 AND DELU_to_FR > 1",
}


@query(
    "a17_violation_counts",
    with_ctes(pn.M, "mh AS (SELECT * REPLACE (ts + (dayofyear(ts) % 24) * INTERVAL 1 HOUR AS ts) FROM m)", SUN.format(source="mh"))
    + "SELECT series_key, rule, n FROM (SELECT series_key, " + ", ".join(f'count(*) FILTER ({c}) AS "{n}"' for n, c in _RULES.items())
    + " FROM sun GROUP BY 1) UNPIVOT (n FOR rule IN (" + ", ".join(f'"{n}"' for n in _RULES) + "))",
)
def _(spark, d):
    """All rules; the days stand at the hours of the clock in turn, so that some lie at night."""
    at = (F.col(TS) + hours(F.dayofyear(TS) % 24)).alias(TS)
    return K.violation_counts(pn.market(spark, d).select(KEY, at, (F.col("gen_solar") - 30).alias("gen_solar"), "FR_to_DELU", "DELU_to_FR"))


# ---- audits of an imputation: interpolated generation columns of the market panel ----
AUDITED = ["gen_solar", "gen_wind_onshore", "gen_fossil_gas"]
_CELLS = f"""cl AS (SELECT series_key, ts, metric, raw FROM m UNPIVOT INCLUDE NULLS (raw FOR metric IN ({', '.join(AUDITED)}))),
cn AS (SELECT *, last_value(raw IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN raw IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS pt, first_value(raw IGNORE NULLS) OVER v AS nv, first_value(CASE WHEN raw IS NOT NULL THEN ts END IGNORE NULLS) OVER v AS nt FROM cl
  WINDOW w AS (PARTITION BY series_key, metric ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY series_key, metric ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cells AS (SELECT series_key, ts, metric, raw, CASE WHEN raw IS NOT NULL THEN raw WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt)) END AS value FROM cn)"""
_ECDF = """vals AS (SELECT series_key, metric, value AS x, count(*) FILTER (raw IS NOT NULL) AS c1, count(*) FILTER (raw IS NULL) AS c2 FROM cells GROUP BY ALL),
cum AS (SELECT *, sum(c1) OVER w AS k1, sum(c2) OVER w AS k2, sum(c1) OVER (PARTITION BY series_key, metric) AS n1, sum(c2) OVER (PARTITION BY series_key, metric) AS n2, lead(x) OVER (PARTITION BY series_key, metric ORDER BY x) AS nx FROM vals
  WINDOW w AS (PARTITION BY series_key, metric ORDER BY x)),
ts2 AS (SELECT series_key, metric, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(k1 / n1::DOUBLE - k2 / n2::DOUBLE)) AS ks, sum(abs(k1 / n1::DOUBLE - k2 / n2::DOUBLE) * (nx - x)) AS wasserstein,
  sum(c2 * ((k1 + k2 - c1 - c2) + (c1 + c2 + 1) / 2.0::DOUBLE)) - max(n2) * (max(n2) + 1) / 2.0::DOUBLE AS u FROM cum GROUP BY 1, 2)"""


def _cells(spark, d):
    long = Q.long(pn.market(spark, d), AUDITED).withColumnRenamed("value", "raw")
    return materialize(fills.interpolate(long, "raw", out="value", keys=[KEY, "metric"], step=DAY))


@query(
    "a20_a21_a26_two_sample_distances",
    with_ctes(pn.M, _CELLS, _ECDF) + f"SELECT series_key, metric, n1, n2, {r('ks')} AS ks, {r('wasserstein')} AS wasserstein, {r('u')} AS u FROM ts2",
)
def _(spark, d):
    c = _cells(spark, d).withColumn("second", F.col("raw").isNull())
    return two_sample(c, [KEY, "metric"], "value", "second").drop("z")


_LAM = "(ks * sqrt(n1::DOUBLE * n2 / (n1 + n2)))"


@query(
    "a18_a19_static_audit",
    with_ctes(pn.M, _CELLS, _ECDF) + f""", mo AS (SELECT series_key, metric, avg((raw IS NULL)::INTEGER) AS nan_rate_raw, count(raw) AS n_observed, count(*) FILTER (raw IS NULL) AS n_imputed, avg(raw) AS mean_observed, avg(value) FILTER (raw IS NULL) AS mean_imputed,
      stddev_pop(raw) AS std_observed, stddev_pop(value) FILTER (raw IS NULL) AS std_imputed FROM cells GROUP BY 1, 2),
    ap AS (SELECT mo.*, ks, wasserstein, CASE WHEN {_LAM} < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * {_LAM} * {_LAM}))))) END AS p FROM mo JOIN ts2 ON mo.series_key = ts2.series_key AND mo.metric = ts2.metric),
    lg AS (SELECT series_key, metric, value - avg(value) OVER (PARTITION BY series_key, metric) AS x, lag(value, 7) OVER (PARTITION BY series_key, metric ORDER BY ts) - avg(value) OVER (PARTITION BY series_key, metric) AS x7 FROM cells),
    ac AS (SELECT series_key, metric, sum(x * x7) / sum(x * x) AS acf FROM lg GROUP BY 1, 2)
    SELECT ap.series_key, ap.metric, {r('nan_rate_raw')} AS nan_rate_raw, n_observed, n_imputed, {r('mean_observed')} AS mean_observed, {r('mean_imputed')} AS mean_imputed, {r('std_observed')} AS std_observed, {r('std_imputed')} AS std_imputed, {r('ks')} AS ks, {r('wasserstein')} AS wasserstein, {r('p')} AS ks_pvalue, {r('acf')} AS acf_7,
    CASE WHEN abs(mean_imputed - mean_observed) / std_observed > 1 OR std_imputed / std_observed < 0.3 OR sign(mean_imputed) <> sign(mean_observed) THEN 'red' WHEN abs(mean_imputed - mean_observed) / std_observed > 0.5 OR p < 0.01 THEN 'yellow' ELSE 'green' END AS status,
    ((abs(mean_imputed - mean_observed) / std_observed > 0.5)::INTEGER + (std_imputed / std_observed < 0.3)::INTEGER + (p < 0.01)::INTEGER)::INTEGER AS n_reasons FROM ap JOIN ac ON ap.series_key = ac.series_key AND ap.metric = ac.metric WHERE nan_rate_raw > 0""",
)
def _(spark, d):
    a = Q.static_audit(_cells(spark, d), lags=(1, 7), step=DAY)
    return a.select(
        KEY, "metric", "nan_rate_raw", "n_observed", "n_imputed", "mean_observed", "mean_imputed", "std_observed", "std_imputed", "ks", "wasserstein", "ks_pvalue",
        F.col("acf_imputed")[7].alias("acf_7"), "status", F.size("reasons").alias("n_reasons"),
    )


@query(
    "a22_autocorrelation",
    with_ctes(pn.HF) + ", ".join([""]) + f""", lg AS (SELECT series_key, price - avg(price) OVER (PARTITION BY series_key) AS x, {', '.join(f'lag(price, {k}) OVER (PARTITION BY series_key ORDER BY ts) - avg(price) OVER (PARTITION BY series_key) AS x{k}' for k in (1, 24, 168))} FROM hf)
    SELECT series_key, {', '.join(f"{r(f'sum(x * x{k}) / sum(x * x)')} AS acf_{k}" for k in (1, 24, 168))} FROM lg GROUP BY 1""",
)
def _(spark, d):
    return Q.acf(pn.hourly_filled(spark, d), "price", (1, 24, 168))


_HL = "hl AS (SELECT series_key, 'price' AS metric, ts, price AS value FROM h)"
_MASK = """mk AS (SELECT series_key, metric, ts FROM (SELECT *, row_number() OVER (PARTITION BY series_key, metric ORDER BY md5(concat_ws('|', series_key, metric, epoch_us(ts)::VARCHAR, '7'))) AS rn,
  count(*) OVER (PARTITION BY series_key, metric) AS n FROM hl WHERE value IS NOT NULL) WHERE rn <= floor(n * 0.2))"""


def _price_cells(spark, d):
    return pn.hourly(spark, d).select(KEY, F.lit("price").alias("metric"), TS, F.col("price").alias("value"))


@query("a23_mcar_mask", with_ctes(pn.H, _HL, _MASK) + "SELECT series_key, metric, ts FROM mk")
def _(spark, d):
    return Q.mcar_mask(_price_cells(spark, d), 0.2, seed=7)


@query(
    "a24_block_mask",
    with_ctes(pn.H, _HL) + """, e AS (SELECT series_key, metric, min(epoch_us(ts) // 3600000000) AS a, max(epoch_us(ts) // 3600000000) AS z FROM hl GROUP BY 1, 2),
    b AS (SELECT series_key, metric, a + ('0x' || substr(md5(concat_ws('|', series_key, metric, i::VARCHAR, '3')), 1, 8))::BIGINT % (z - a - 24 + 1) AS s FROM e, (SELECT unnest(generate_series(0, 4)) AS i))
    SELECT DISTINCT hl.series_key, hl.metric, hl.ts FROM hl JOIN b ON hl.series_key = b.series_key AND hl.metric = b.metric AND epoch_us(hl.ts) // 3600000000 BETWEEN s AND s + 23 WHERE value IS NOT NULL""",
)
def _(spark, d):
    return Q.block_mask(_price_cells(spark, d), 5, 24, seed=3)


@query(
    "a25_masked_scores",
    with_ctes(pn.H, _HL, _MASK) + f""", hid AS (SELECT hl.*, mk.ts IS NOT NULL AS hide FROM hl LEFT JOIN mk ON hl.series_key = mk.series_key AND hl.ts = mk.ts),
    pr AS (SELECT series_key, metric, hide, value AS y, coalesce(last_value(CASE WHEN NOT hide THEN value END IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY ts ROWS UNBOUNDED PRECEDING),
      first_value(CASE WHEN NOT hide THEN value END IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM hid)
    SELECT series_key, metric, count(*) AS n_evaluated, {r('avg(abs(y - p))')} AS mae, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse, {r('avg(abs(y - p) / CASE WHEN (abs(y) + abs(p)) / 2 > 1e-9 THEN (abs(y) + abs(p)) / 2 ELSE 1 END)')} AS smape, {r('corr(y, p)')} AS pearson FROM pr WHERE hide GROUP BY 1, 2""",
)
def _(spark, d):
    c = materialize(_price_cells(spark, d))
    return Q.masked_audit(c, Q.mcar_mask(c, 0.2, seed=7), lambda x: fills.ffill_bfill(x, ["value"], keys=[KEY, "metric"]))


_A26 = {"other_borders": [c for c in _FLOWS if "FR" not in c]}
_A26_MISSING = [c for c in _FLOWS if "FR" in c] + GENS


def _normal_p(z: str) -> str:
    """Two-sided normal p by Simpson's rule, as SQL."""
    f = f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5::DOUBLE * ({z}) * ({z}) * i / 2000 * i / 2000)"
    return f"(1 - 2 / sqrt(2 * pi()) * abs({z}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: {f})))"


@query(
    "a26_missing_dependence",
    with_ctes(pn.M, "ac AS (SELECT *, " + " + ".join(f"coalesce(abs({c}), 0)" for c in _A26["other_borders"]) + " AS other_borders FROM m)") + ", "
    + "lo AS (" + " UNION ALL ".join(f"SELECT '{c}' AS missing, '{a}' AS activity, {c} IS NULL AS f, {a}::DOUBLE AS x FROM ac WHERE {a} IS NOT NULL" for c in _A26_MISSING for a in ("other_borders", "load")) + f"""),
    rk AS (SELECT *, rank() OVER (PARTITION BY missing, activity ORDER BY x) + (count(*) OVER (PARTITION BY missing, activity, x) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY missing, activity, x) AS t FROM lo),
    us AS (SELECT missing, activity, count(*) FILTER (f) AS n_missing, count(*) FILTER (NOT f) AS n_present, coalesce(sum(rank) FILTER (f), 0) - n_missing * (n_missing + 1) / 2.0::DOUBLE AS u, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY 1, 2),
    zs AS (SELECT *, u - n_missing * n_present / 2.0::DOUBLE AS gap, sqrt(n_missing::DOUBLE * n_present / 12 * ((n_missing + n_present + 1) - ties / nullif((n_missing + n_present)::DOUBLE * (n_missing + n_present - 1), 0))) AS s FROM us),
    zz AS (SELECT *, CASE WHEN s > 0 THEN sign(gap) * greatest(abs(gap) - 0.5, 0) / s END AS zv FROM zs)
    SELECT missing, activity, n_missing, n_present, {r('u')} AS u, {r('zv')} AS z, {r(_normal_p('zv'))} AS p_value FROM zz""",
)
def _(spark, d):
    total = sum((F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in _A26["other_borders"]), F.lit(0.0))
    return Q.missing_dependence(pn.market(spark, d), {"other_borders": total, "load": F.col("load")}, _A26_MISSING)


@query(
    "a27_histogram",
    with_ctes(pn.H) + "SELECT series_key, floor(price / 10)::BIGINT AS bin, count(*) AS n FROM h WHERE price IS NOT NULL GROUP BY 1, 2",
)
def _(spark, d):
    h = pn.hourly(spark, d).where("price IS NOT NULL")
    b = F.floor(F.col("price") / 10)
    return h.groupBy(KEY, b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_PROBS = [i / 20 for i in range(1, 20)]


@query(
    "a27_normal_quantile_plot",
    with_ctes(pn.H) + " UNION ALL ".join(f"SELECT series_key, {p}::DOUBLE AS p, {r(f'{NormalDist().inv_cdf(p)!r}::DOUBLE')} AS normal, {r(f'(quantile_cont(price, {p}) - avg(price)) / stddev_samp(price)')} AS sample FROM h GROUP BY 1" for p in _PROBS),
)
def _(spark, d):
    return Q.normal_plot(pn.hourly(spark, d), "price", _PROBS)


@query(
    "a28_imputation_summary",
    with_ctes(pn.D) + f"SELECT series_key, date_trunc('month', ts)::TIMESTAMP AS month, sum((price IS NULL)::INTEGER)::BIGINT AS n_imputed, {r('100 * avg((price IS NULL)::INTEGER)')} AS pct_imputed FROM d GROUP BY 1, 2",
)
def _(spark, d):
    miss = F.col("price").isNull().cast("int")
    return pn.daily(spark, d).groupBy(KEY, F.date_trunc("month", TS).alias("month")).agg(F.sum(miss).alias("n_imputed"), (100 * F.avg(miss)).alias("pct_imputed"))


@query(
    "a29_scaled_source_merge",
    with_ctes(pn.FUELS) + f""", supp AS (SELECT l_shipdate::DATE::TIMESTAMP AS ts, avg(l_extendedprice) AS s FROM lineitem GROUP BY 1), j AS (SELECT coalesce(f.ts, s.ts) AS ts, ttf_gas AS b, s.s FROM fuels f FULL JOIN supp s ON f.ts = s.ts),
    k AS (SELECT quantile_cont(b, 0.5) / quantile_cont(s, 0.5) AS ratio FROM j WHERE b IS NOT NULL AND s IS NOT NULL) SELECT ts, {r('coalesce(b, s * ratio)')} AS ttf_gas FROM j, k""",
)
def _(spark, d):
    from panelcast.sources.tables import read_table

    l = read_table(spark, d, "lineitem", ["l_shipdate", "l_extendedprice"])
    supp = l.groupBy(F.date_trunc("day", "l_shipdate").alias(TS)).agg(F.avg("l_extendedprice").alias("ttf_gas"))
    return Q.scaled_merge(pn.fuels(spark, d).select(TS, "ttf_gas"), supp, "ttf_gas")


@query(
    "a30_binary_columns",
    with_ctes(pn.M) + ", b AS (SELECT price, load, CASE WHEN series_key = 'A' THEN 1.0 ELSE 0.0 END AS is_a, 1.0 AS one FROM m) SELECT \"column\", is_binary FROM (SELECT count(DISTINCT price) = 2 AS price, count(DISTINCT load) = 2 AS load, count(DISTINCT is_a) = 2 AS is_a, count(DISTINCT one) = 2 AS one FROM b) UNPIVOT (is_binary FOR \"column\" IN (price, load, is_a, one))",
)
def _(spark, d):
    m = pn.market(spark, d).select("price", "load", F.when(F.col(KEY) == "A", 1.0).otherwise(0.0).alias("is_a"), F.lit(1.0).alias("one"))
    return Q.binary_columns(m, ["price", "load", "is_a", "one"])


def _with_interpolation(spark, d):
    return fills.interpolate(pn.hourly(spark, d).select(KEY, TS, "price"), "price", out="interp")


@query("a31_harmonic_window_fill")
def _(spark, d):
    return Q.window_fill(_with_interpolation(spark, d), "price", Q.harmonic_fit, other="interp")


@query("a32_whittaker_window_fill")
def _(spark, d):
    return Q.window_fill(_with_interpolation(spark, d), "price", Q.whittaker_fit, other="interp")


@query("a33_held_out_blend_weight")
def _(spark, d):
    """Hide a tenth of the observed cells, let both fillers predict them, weigh by least squares."""
    c = materialize(_price_cells(spark, d))
    mask = Q.mcar_mask(c, 0.1, seed=11).withColumn("hide", F.lit(True))
    hidden = materialize(c.join(mask, [KEY, "metric", TS], "left").withColumn("shown", F.when(F.col("hide").isNull(), F.col("value"))))
    first = fills.interpolate(hidden.select(KEY, TS, "shown"), "shown", out="first")
    second = Q.window_fill(hidden.select(KEY, TS, "shown"), "shown", Q.whittaker_fit).select(KEY, TS, F.col("fitted").alias("second"))
    held = hidden.where("hide").select(KEY, TS, F.col("value").alias("y")).join(first.select(KEY, TS, "first"), [KEY, TS]).join(second, [KEY, TS])
    return Q.blend_weight(held, [KEY])


@query(
    "a34_smooth_imputed_cells",
    with_ctes(pn.HF) + f""", s AS (SELECT hf.series_key, hf.ts, h.price AS raw, hf.price AS v, lag(hf.price) OVER w AS p, lead(hf.price) OVER w AS n FROM hf JOIN h ON hf.series_key = h.series_key AND hf.ts = h.ts WINDOW w AS (PARTITION BY hf.series_key ORDER BY hf.ts))
    SELECT series_key, ts, {r('CASE WHEN raw IS NULL THEN (coalesce(p, 0) + v + coalesce(n, 0)) / 3 ELSE v END')} AS mean_smoothed, {r('CASE WHEN raw IS NULL THEN list_sort([coalesce(p, v), v, coalesce(n, v)])[2] ELSE v END')} AS median_smoothed FROM s""",
)
def _(spark, d):
    f = fills.ffill_bfill(pn.hourly(spark, d).select(KEY, TS, F.col("price").alias("raw"), "price"), ["price"])
    return Q.smooth_imputed(f, "price", F.col("raw").isNull()).select(KEY, TS, "mean_smoothed", "median_smoothed")


@query(
    "a35_a36_policy_and_held_out_flags",
    with_ctes(pn.HF, _HL, _MASK) + f"""SELECT f.series_key, f.ts, {r('coalesce(h.price, f.price)')} AS price, ((h.price IS NULL OR mk.ts IS NOT NULL) <> (h.price IS NULL)) AS held_out FROM hf f JOIN h ON h.series_key = f.series_key AND h.ts = f.ts LEFT JOIN mk ON mk.series_key = f.series_key AND mk.ts = f.ts""",
)
def _(spark, d):
    c = _price_cells(spark, d)
    mask = Q.mcar_mask(c, 0.2, seed=7).select(KEY, TS, F.lit(True).alias("m"))
    j = pn.hourly(spark, d).select(KEY, TS, F.col("price").alias("observed")).join(pn.hourly_filled(spark, d).select(KEY, TS, F.col("price").alias("imputed")), [KEY, TS]).join(mask, [KEY, TS], "left")
    now = F.col("observed").isNull() | F.col("m").isNotNull()
    return j.select(KEY, TS, fills.keep_observed(F.col("observed"), F.col("imputed")).alias("price"), (now != F.col("observed").isNull()).alias("held_out"))
