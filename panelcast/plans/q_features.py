"""Row-wise features and repairs (C), feature bundles (G14)."""

from pyspark.sql import functions as F

from panelcast.functions import fundamentals as fu
from panelcast.functions import timefeatures as tf
from panelcast.functions.bundles import build_features
from panelcast.operators import constraints as K
from panelcast.operators import grid
from panelcast.plans import panels as pn
from panelcast.plans.q_windows import sql_offset
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import DAY, KEY, TS
from panelcast.sources.tables import read_table


def _cal(base=0):
    return ", ".join(
        f"{r(f'{f}({e} * (2 * pi() / {n}))')} AS {k}_{f}" for k, e, n in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", f"(month(ts) - {base})", 12)) for f in ("sin", "cos")
    ) + ", (isodow(ts) >= 6)::INTEGER AS is_weekend"


for _base in (0, 1):
    @query(f"c{_base + 1}_calendar_month_base_{_base}", with_ctes(pn.H) + f"SELECT series_key, ts, {_cal(_base)} FROM h")
    def _(spark, d, base=_base):
        return pn.hourly(spark, d).select(KEY, TS, *[c.alias(n) for n, c in tf.calendar(month_base=base).items()])


@query(
    "c3_holidays",
    """WITH y AS (SELECT unnest(generate_series(1990, 2030)) AS y), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
    b AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h, (32 + 2 * (b % 4) + 2 * (c // 4) - ((19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30) - c % 4) % 7 AS l FROM a),
    e AS (SELECT y, make_date(y, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1) AS easter FROM b),
    hol AS (SELECT easter + unnest([-2, 1, 39, 50]) AS day FROM e UNION SELECT make_date(y, m, dd) FROM y, (VALUES (1, 1), (5, 1), (10, 3), (12, 25), (12, 26)) v(m, dd) UNION SELECT DATE '2017-10-31')
    SELECT o_orderdate::DATE::TIMESTAMP AS ts, count(*) AS n_orders, (o_orderdate::DATE IN (SELECT day FROM hol))::INTEGER AS is_holiday FROM orders GROUP BY 1, 3""",
)
def _(spark, d):
    o = read_table(spark, d, "orders", ["o_orderdate"])
    return o.groupBy(F.date_trunc("day", "o_orderdate").alias(TS)).agg(F.count(F.lit(1)).alias("n_orders")).withColumn("is_holiday", tf.is_holiday())


_REN = "(gen_wind_onshore + gen_wind_offshore + gen_solar + gen_hydro_ror)"


@query(
    "c4_c7_fundamentals",
    with_ctes(pn.MF) + f"""SELECT series_key, ts, {r('ttf_gas * 1.95 + coalesce(carbon_ets, 0) * 0.39')} AS clean_spark_anchor, {r('ttf_gas * 2.46 + coalesce(carbon_ets, 0) * 0.8364')} AS clean_dark_anchor, {r('ttf_gas * coalesce(carbon_ets, 0)')} AS gas_carbon_interaction,
    {r(f'load - {_REN}')} AS residual_load, {r('coalesce(least(greatest((gen_wind_onshore + gen_wind_offshore + gen_solar) / nullif(load, 0), CASE WHEN gen_wind_onshore + gen_wind_offshore + gen_solar IS NULL THEN NULL ELSE 0 END), CASE WHEN gen_wind_onshore + gen_wind_offshore + gen_solar IS NULL THEN NULL ELSE 1 END), 0)')} AS renewable_penetration,
    {r('load - coalesce(gen_wind_onshore, 0) - coalesce(gen_wind_offshore, 0) - coalesce(gen_solar, 0) - coalesce(gen_hydro_ror, 0)')} AS residual_load_skipping,
    (coalesce((gen_wind_onshore + gen_wind_offshore + gen_solar) / nullif(load, 0), 0) < 0.1)::INTEGER AS is_renewable_scarcity, (ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1998-03-01')::INTEGER AS regime FROM mf""",
)
def _(spark, d):
    m = pn.market_with_fuels(spark, d)
    f = m.withColumns({**fu.cost_anchors(), **fu.residual_load(m), "residual_load_skipping": fu.residual_load_skipping(m)})
    return f.select(
        KEY, TS, *fu.cost_anchors(), "residual_load", "renewable_penetration", "residual_load_skipping",
        fu.scarcity().alias("is_renewable_scarcity"), tf.in_range("1997-03-01", "1998-03-01").alias("regime"),
    )


_TC = ", ".join(f"max(temperature_2m) FILTER (location = '{c}') AS t{i}, max(windspeed_10m) FILTER (location = '{c}') AS w{i}" for i, c in enumerate(pn.REGIONS))
_L = lambda p: "[" + ", ".join(f"{p}{i}" for i in range(5)) + "]"


@query(
    "c8_c9_weather_aggregates",
    with_ctes(pn.WEATHER, f"ww AS (SELECT ts, {_TC} FROM wl GROUP BY 1)") + f"""SELECT ts, {r(f"list_avg({_L('t')})")} AS weather_mean_temperature_2m, {r(f"list_avg({_L('w')})")} AS weather_mean_windspeed_10m, {r(f"list_max({_L('w')})")} AS weather_max_windspeed_10m,
    {r(f"greatest(15 - list_avg({_L('t')}), 0)")} AS heating_degree, {r(f"greatest(list_avg({_L('t')}) - 22, 0)")} AS cooling_degree FROM ww""",
)
def _(spark, d):
    w = grid.locations_wide(pn.weather_long(spark, d), [TS], "location", pn.REGIONS, ("temperature_2m", "windspeed_10m"))
    agg = fu.weather_aggregates(w, [c.lower() for c in pn.REGIONS], ("temperature_2m", "windspeed_10m"))
    out = w.select(TS, *[c.alias(n) for n, c in agg.items()])
    return out.withColumns(fu.degree_hours(F.col("weather_mean_temperature_2m")))


@query("c10_net_imports", with_ctes(pn.M) + "SELECT series_key, ts, " + ", ".join(f"{b}_to_DELU - DELU_to_{b} AS net_import_{b}" for b in ("FR", "AT", "CH")) + " FROM m")
def _(spark, d):
    m = pn.market(spark, d)
    return m.select(KEY, TS, *[c.alias(n) for n, c in fu.net_imports(m).items()])


_G = "(dayofyear(ts) + (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24 - 1) * (2 * pi() / 365)"
SUN = f"""sun0 AS (SELECT *, {_G} AS g FROM {{source}}), sun1 AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl,
  229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq FROM sun0),
sun AS (SELECT *, degrees(asin(sin(radians(51)) * sin(decl) + cos(radians(51)) * cos(decl) * cos(radians((hour(ts) * 60 + minute(ts) + eq + 40) / 4 - 180)))) AS elev FROM sun1)"""


@query("c11_c12_solar_elevation_and_night", with_ctes(pn.H, SUN.format(source="h")) + f"SELECT series_key, ts, {r('elev')} AS elevation, {r('price * least(greatest((elev + 6) / 6, 0), 1)')} AS gen_solar FROM sun")
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, F.col("price").alias("gen_solar"), fu.solar_elevation().alias("elevation"))
    return K.solar_night(h, elevation=F.col("elevation"))


@query(
    "c13_c14_clip_and_flow_coherence",
    with_ctes(pn.M) + f"""SELECT series_key, ts, CASE WHEN gen_solar IS NOT NULL THEN greatest(gen_solar - 40, 0) END AS gen_solar, gen_hydro_pumped - 40 AS gen_hydro_pumped, """
    + ", ".join(
        f"CASE WHEN coalesce({a}, 0) > 0 AND coalesce({b}, 0) > 0 AND {a} < {b} THEN 0 ELSE {a} END AS {a}, CASE WHEN coalesce({a}, 0) > 0 AND coalesce({b}, 0) > 0 AND {a} >= {b} THEN 0 ELSE {b} END AS {b}"
        for a, b in (("FR_to_DELU", "DELU_to_FR"), ("AT_to_DELU", "DELU_to_AT"), ("CH_to_DELU", "DELU_to_CH"))
    ) + " FROM m",
)
def _(spark, d):
    m = pn.market(spark, d).withColumns({"gen_solar": F.col("gen_solar") - 40, "gen_hydro_pumped": F.col("gen_hydro_pumped") - 40})
    out = K.coherent_flows(K.clip_generation(m))
    return out.select(KEY, TS, "gen_solar", "gen_hydro_pumped", *[c for p in K.FLOW_PAIRS for c in p])


@query(
    "c15_c17_nulling_and_zero_fill",
    with_ctes(pn.MF) + f"""SELECT series_key, ts, {r("CASE WHEN ts >= TIMESTAMP '1997-01-01' THEN carbon_ets END")} AS carbon_ets, (ts < TIMESTAMP '1997-01-01')::INTEGER AS carbon_ets_pre_launch, coalesce(gen_fossil_coal_gas, 0) AS gen_fossil_coal_gas,
    (gen_fossil_coal_gas IS NULL)::INTEGER AS gen_fossil_coal_gas_structural_zero, CASE WHEN ts > TIMESTAMP '1999-04-15' THEN coalesce(gen_fossil_gas, 0) ELSE gen_fossil_gas END AS gen_fossil_gas FROM mf""",
)
def _(spark, d):
    m = pn.market_with_fuels(spark, d).select(KEY, TS, "carbon_ets", "gen_fossil_coal_gas", "gen_fossil_gas")
    out = K.null_before(m, start="1997-01-01")
    out = K.structural_zero(out, pn.market(spark, d))
    return K.zero_after(out, "gen_fossil_gas", "1999-04-15")


@query(
    "c18_constraint_sequence",
    with_ctes(pn.M) + """SELECT series_key, ts, CASE WHEN gen_wind_onshore IS NOT NULL THEN greatest(gen_wind_onshore - 40, 0) END AS gen_wind_onshore,
    CASE WHEN coalesce(FR_to_DELU, 0) > 0 AND coalesce(DELU_to_FR, 0) > 0 AND FR_to_DELU < DELU_to_FR THEN 0 ELSE FR_to_DELU END AS FR_to_DELU, (gen_fossil_coal_gas IS NULL)::INTEGER AS gen_fossil_coal_gas_structural_zero FROM m""",
)
def _(spark, d):
    raw = pn.market(spark, d)
    out = K.apply_constraints(raw.withColumn("gen_wind_onshore", F.col("gen_wind_onshore") - 40), raw)
    return out.select(KEY, TS, "gen_wind_onshore", "FR_to_DELU", "gen_fossil_coal_gas_structural_zero")


@query(
    "c19_c21_transforms",
    with_ctes(pn.HF) + f"""SELECT h.series_key, h.ts, {r('asinh(price)')} AS z, {r('sinh(asinh(price))')} AS back, {r('(asinh(price) - m) / s')} AS scaled, {r('price - ln(1 + exp(load / 100))')} AS q10, {r('price')} AS q50, {r('price + ln(1 + exp(activity0 / 10))')} AS q90
    FROM (SELECT hf.*, coalesce(h.activity, 0) AS activity0 FROM hf JOIN h ON hf.series_key = h.series_key AND hf.ts = h.ts) h JOIN (SELECT series_key, avg(asinh(price)) AS m, coalesce(nullif(stddev_pop(asinh(price)), 0), 1) AS s FROM hf GROUP BY 1) q ON h.series_key = q.series_key""",
)
def _(spark, d):
    from panelcast.operators.quality import fit_scaler

    h = pn.hourly_filled(spark, d).withColumn("z", F.asinh("price"))
    stats = fit_scaler(h, {"z": F.col("z")}, keys=[KEY])
    j = h.join(stats.select(KEY, "mean", "scale"), KEY)
    q = fu.monotone_quantiles(F.col("price"), F.col("load") / 100, F.coalesce(F.col("activity"), F.lit(0)) / 10)
    return j.select(KEY, TS, "z", F.sinh("z").alias("back"), fu.standardise(F.col("z"), F.col("mean"), F.col("scale")).alias("scaled"), *[c.alias(n) for n, c in q.items()])


@query(
    "c22_c26_labels",
    with_ctes(pn.D) + f"""SELECT series_key, ts, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
    CASE WHEN hour(l) BETWEEN 6 AND 9 THEN 'morning_peak' WHEN hour(l) BETWEEN 10 AND 16 THEN 'midday' WHEN hour(l) BETWEEN 17 AND 20 THEN 'evening_peak' ELSE 'night' END AS local_hour_group, hour(l)::INTEGER AS local_hour
    FROM (SELECT series_key, ts + INTERVAL 5 HOUR AS ts, ts + INTERVAL 5 HOUR + to_seconds({sql_offset("(ts + INTERVAL 5 HOUR)")}) AS l FROM d)""",
)
def _(spark, d):
    p = pn.daily(spark, d).select(KEY, (F.col(TS) + F.make_dt_interval(hours=F.lit(5))).alias(TS))
    return p.select(
        KEY, TS, tf.season().alias("season"), tf.day_type().alias("day_type"), tf.hour_group(tf.local()).alias("local_hour_group"), F.hour(tf.local()).alias("local_hour")
    )


@query(
    "c23_segment_flags",
    with_ctes(pn.HF) + """SELECT h.series_key, h.ts, hour(ts) BETWEEN 8 AND 20 AS peak, NOT (hour(ts) BETWEEN 8 AND 20) AS off_peak, isodow(ts) >= 6 AS weekend, isodow(ts) < 6 AS weekday, false AS crisis_2022, true AS post_crisis,
    price < 0 AS negative_price, price >= t AS spike_top10pct FROM hf h JOIN (SELECT series_key, quantile_cont(price, 0.9) AS t FROM hf GROUP BY 1) q ON h.series_key = q.series_key""",
)
def _(spark, d):
    from panelcast.operators.metrics import with_threshold

    h = with_threshold(pn.hourly_filled(spark, d), [KEY], y="price")
    flags = tf.segments(TS, F.col("price"), F.col("threshold"))
    return h.select(KEY, TS, *[c.alias(n) for n, c in flags.items() if n != "all"])


@query(
    "c24_anchor_residual_target",
    with_ctes(pn.HF) + f"""SELECT o.series_key, o.ts AS origin_ts, k::INTEGER AS horizon_h, {r('asinh(t.price - o.price)')} AS target, {r('sinh(asinh(t.price - o.price)) + o.price')} AS restored FROM hf o CROSS JOIN (SELECT unnest(range(1, 25)) AS k)
    JOIN hf t ON t.series_key = o.series_key AND t.ts = o.ts + k * INTERVAL 1 HOUR""",
)
def _(spark, d):
    from panelcast.operators.supervised import supervised

    x = supervised(pn.hourly_filled(spark, d), ["price"], [], "price", horizons=tuple(range(1, 25)))
    z = fu.anchor_target(F.col("y"), F.col("price"))
    return x.select(KEY, "origin_ts", "horizon_h", z.alias("target"), fu.anchor_inverse(z, F.col("price")).alias("restored"))


_U = lambda seed: f"((('0x' || md5(concat_ws('|', o.series_key, epoch_us(o.ts)::VARCHAR, k::VARCHAR, '{seed}'))[1:12])::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"


@query(
    "c25_horizon_noise",
    with_ctes(pn.HF) + f"""SELECT o.series_key, o.ts AS origin_ts, k::INTEGER AS horizon_h, {r(f"t.load + sqrt(-2 * ln({_U(7)})) * cos(2 * pi() * {_U(8)}) * 0.1 * sqrt(k)")} AS fut_load FROM hf o CROSS JOIN (SELECT unnest(range(1, 25)) AS k)
    JOIN hf t ON t.series_key = o.series_key AND t.ts = o.ts + k * INTERVAL 1 HOUR""",
)
def _(spark, d):
    from panelcast.operators.supervised import supervised

    x = supervised(pn.hourly_filled(spark, d), [], ["load"], "price", horizons=tuple(range(1, 25)))
    return x.select(KEY, "origin_ts", "horizon_h", fu.horizon_noise(F.col("fut_load"), 0.1, F.col("horizon_h"), [KEY, "origin_ts", "horizon_h"], 7).alias("fut_load"))


@query(
    "c28_code_names",
    "SELECT CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in pn.GENERATION.items())
    + " END AS metric, replace(lower(r_name), ' ', '_') || '_temperature_2m' AS column_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
def _(spark, d):
    l = read_table(spark, d, "lineitem", ["l_linenumber", "l_suppkey"])
    s = read_table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    g = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    names = F.create_map(*[F.lit(x) for kv in pn.GENERATION.items() for x in kv])
    per = l.groupBy("l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    j = per.join(s, per.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(
        names[F.col("l_linenumber")].alias("metric"), F.concat_ws("_", F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")), F.lit("temperature_2m")).alias("column_name")
    ).agg(F.sum("c").alias("n"))


@query(
    "g14_feature_bundles",
    with_ctes(pn.MF) + f"""SELECT series_key, ts, {r(f'load - {_REN}')} AS residual_load, (coalesce((gen_wind_onshore + gen_wind_offshore + gen_solar) / nullif(load, 0), 0) < 0.1)::INTEGER AS is_renewable_scarcity, {r('sin((isodow(ts) - 1) * (2 * pi() / 7))')} AS dow_sin, 0 AS crisis_2022_flag FROM mf""",
)
def _(spark, d):
    return build_features(pn.market_with_fuels(spark, d), ["spike", "calendar", "regime"]).select(
        KEY, TS, "residual_load", "is_renewable_scarcity", "dow_sin", "crisis_2022_flag"
    )


@query(
    "c20_c21_unscaled_sorted_quantiles",
    with_ctes(pn.M) + f"""SELECT series_key, ts, {r('s[1]')} AS q10, {r('s[2]')} AS q50, {r('s[3]')} AS q90 FROM (SELECT series_key, ts, list_sort([price, temp_a, temp_b]) AS s FROM m
    WHERE price IS NOT NULL AND temp_a IS NOT NULL AND temp_b IS NOT NULL)""",
)
def _(spark, d):
    """Crossing quantiles in units of the series' spread, put in order and taken back to its own units."""
    from panelcast.operators.quality import fit_scaler

    m = pn.market(spark, d)
    given = {"q10": "price", "q50": "temp_a", "q90": "temp_b"}
    j = m.join(fit_scaler(m, {"price": F.col("price")}, [KEY]).drop("metric"), KEY).dropna(subset=list(given.values()))
    scaled = j.withColumns({q: fu.standardise(F.col(c), F.col("mean"), F.col("scale")) for q, c in given.items()}).withColumns(fu.repair_crossing())
    return scaled.select(KEY, TS, *[fu.unstandardise(F.col(q), F.col("mean"), F.col("scale")).alias(q) for q in given])
