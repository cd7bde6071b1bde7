"""Gridding, reshaping and windows (G), filters and splits (F)."""

from pyspark.sql import functions as F

from panelcast.functions import predicates as P
from panelcast.operators import grid
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import DAY, KEY, TS
from panelcast.sources.tables import read_table


@query("g1_regular_spine", with_ctes(pn.H) + f"SELECT series_key, ts, {r('price')} AS price, {r('load')} AS load, activity FROM h")
def _(spark, d):
    return pn.hourly(spark, d)


@query(
    "g2_g3_hourly_mean",
    "SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, " + r("avg(value)") + " AS price FROM events GROUP BY 1, 2",
)
def _(spark, d):
    e = read_table(spark, d, "events", ["ts", "event_type", "value"]).withColumnRenamed("event_type", KEY)
    return grid.resample(e, "hour", {"price": F.avg("value")})


@query(
    "g4_hourly_sum_min_count",
    with_ctes(pn.H) + f"SELECT series_key, date_trunc('hour', ts) AS ts, {r('sum(load)')} AS load FROM h GROUP BY 1, 2",
)
def _(spark, d):
    return grid.resample(pn.hourly(spark, d), "hour", {"load": F.sum("load")})


for _unit in ("week", "month", "year"):
    @query(
        f"g5_resample_{_unit}",
        with_ctes(pn.D) + f"SELECT series_key, date_trunc('{_unit}', ts)::TIMESTAMP AS ts, {r('avg(price)')} AS price, {r('sum(load)', 3)} AS load FROM d GROUP BY 1, 2",
        digits={"load": 3},
    )
    def _(spark, d, unit=_unit):
        return grid.resample(pn.daily(spark, d), unit, {"price": F.avg("price"), "load": F.sum("load")})


@query(
    "g5_resample_day",
    with_ctes(pn.H) + f"SELECT series_key, ts::DATE::TIMESTAMP AS ts, {r('avg(price)')} AS price, {r('sum(load)')} AS load FROM h GROUP BY 1, 2",
)
def _(spark, d):
    return grid.resample(pn.hourly(spark, d), "day", {"price": F.avg("price"), "load": F.sum("load")})


@query(
    "g6_pivot_generation_types",
    "SELECT l_shipdate::DATE::TIMESTAMP AS ts, "
    + ", ".join(f"sum(l_quantity) FILTER (l_linenumber = {k}) AS {v}" for k, v in pn.GENERATION.items())
    + " FROM lineitem GROUP BY 1",
)
def _(spark, d):
    l = read_table(spark, d, "lineitem", ["l_shipdate", "l_linenumber", "l_quantity"])
    long = l.select(F.date_trunc("day", "l_shipdate").alias(TS), "l_linenumber", "l_quantity")
    return grid.pivot_wide(
        long, [TS], "l_linenumber", pn.GENERATION, F.sum("l_quantity"), rename=lambda k: pn.GENERATION[k]
    )


@query(
    "g7_locations_wide",
    with_ctes(pn.WEATHER) + "SELECT ts, "
    + ", ".join(
        r(f"max({v}) FILTER (location = '{c}')") + f' AS "{c.lower()}_{v}"'
        for c in pn.REGIONS for v in ("temperature_2m", "windspeed_10m")
    )
    + " FROM wl GROUP BY 1",
)
def _(spark, d):
    return grid.locations_wide(
        pn.weather_long(spark, d), [TS], "location", pn.REGIONS, ("temperature_2m", "windspeed_10m")
    )


_WIN = """p AS (SELECT series_key, ts, price, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS pos,
  count(*) OVER (PARTITION BY series_key) AS n FROM h),
win AS (SELECT series_key, ts, price, w.window_id, (pos - w.window_id * 24)::INTEGER AS "offset" FROM p,
  LATERAL (SELECT unnest(generate_series(greatest(-floor(-(pos - 47) / 24.0), 0)::BIGINT, least(pos // 24, (n - 48) // 24)::BIGINT)) AS window_id) w
  WHERE n >= 48)"""


@query("g10_fixed_windows", with_ctes(pn.H, _WIN) + f'SELECT series_key, ts, {r("price")} AS price, window_id, "offset" FROM win')
def _(spark, d):
    return grid.window_rows(pn.hourly(spark, d).select(KEY, TS, "price"), 48, 24)


@query(
    "g11_overlap_average",
    with_ctes(pn.H, _WIN)
    + f"""SELECT h.series_key, h.ts, {r('coalesce(a.price, 0)')} AS price FROM h LEFT JOIN
    (SELECT series_key, ts, avg(price * (1 + "offset" / 48.0::DOUBLE)) AS price FROM win GROUP BY 1, 2) a
    ON h.series_key = a.series_key AND h.ts = a.ts""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price")
    w = grid.window_rows(h, 48, 24).withColumn("price", F.col("price") * (1 + F.col("offset") / 48.0))
    return grid.overlap_average(h, w, "price")


@query(
    "g12_origin_windows",
    with_ctes(pn.HF) + f"""SELECT series_key, ts AS origin_ts, {r('past_mean')} AS past_mean, {r('first_past')} AS first_past,
    {r('fut_mean')} AS future_mean, {r('last_fut')} AS last_future FROM (SELECT series_key, ts,
      avg(price) OVER a AS past_mean, first_value(price) OVER a AS first_past, count(*) OVER a AS np,
      avg(price) OVER b AS fut_mean, last_value(price) OVER b AS last_fut, count(*) OVER b AS nf FROM hf
      WINDOW a AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW),
             b AS (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)) WHERE np = 168 AND nf = 24""",
)
def _(spark, d):
    w = grid.origin_windows(pn.hourly_filled(spark, d), ["price"], ["price"], lookback=168, horizon=24)
    mean = lambda c, n: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x["price"]) / n
    return w.select(
        KEY, "origin_ts", mean("past", 168).alias("past_mean"), F.col("past")[0]["price"].alias("first_past"),
        mean("future", 24).alias("future_mean"), F.col("future")[23]["price"].alias("last_future"),
    )


@query("g13_select_by_prefix", with_ctes(pn.M) + "SELECT series_key, ts, COLUMNS('gen_.*') FROM m")
def _(spark, d):
    return P.select_prefixed(pn.market(spark, d), [KEY, TS], prefixes=("gen_",), names=("not_there",))


# ---- filters, splits ----
_SPLIT = "CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26' THEN 'val' WHEN ts < TIMESTAMP '2024-02-01' THEN 'test' END"
BOUNDS = {"train": (None, "2024-01-21"), "val": ("2024-01-21", "2024-01-26"), "test": ("2024-01-26", "2024-02-01")}
HS = f"hs AS (SELECT *, {_SPLIT} AS split FROM h)"


@query("f1_split_rows", with_ctes(pn.H, HS) + f"SELECT series_key, ts, split, {r('price')} AS price FROM hs")
def _(spark, d):
    return pn.hourly(spark, d).select(KEY, TS, P.split_label(BOUNDS).alias("split"), "price")


@query(
    "f2_horizon_groups",
    with_ctes(pn.H) + """SELECT series_key, ts AS origin_ts, hh::INTEGER AS horizon_h,
    CASE WHEN hh <= 6 THEN 'h1_6' WHEN hh <= 18 THEN 'h7_18' ELSE 'h19_24' END AS horizon_group
    FROM h, (SELECT unnest(generate_series(1, 24)) AS hh) WHERE hh BETWEEN 7 AND 24""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, F.col(TS).alias("origin_ts"), F.explode(F.sequence(F.lit(1), F.lit(24))).alias("horizon_h"))
    g = h.withColumn("horizon_group", P.horizon_group("horizon_h"))
    return P.filter_horizons(g, groups=("h7_18", "h19_24"))


@query("f3_drop_null_rows", with_ctes(pn.H) + f"SELECT series_key, ts, {r('price')} AS price, {r('load')} AS load FROM h WHERE price IS NOT NULL AND load IS NOT NULL")
def _(spark, d):
    return pn.hourly(spark, d).select(KEY, TS, "price", "load").dropna(subset=["price", "load"])


@query(
    "f4_outside_hard_bounds",
    with_ctes(pn.M) + f"""SELECT series_key, ts, 'price' AS metric, {r('price')} AS value, 20.0::DOUBLE AS lo, 80.0::DOUBLE AS hi FROM m WHERE price < 20 OR price > 80
    UNION ALL SELECT series_key, ts, 'load', load, 10, 400 FROM m WHERE load < 10 OR load > 400""",
)
def _(spark, d):
    bounds = {"price": (20.0, 80.0), "load": (10.0, 400.0)}
    return P.outside_bounds(pn.market(spark, d), bounds)


@query(
    "f5_consistency_checks",
    with_ctes(pn.M) + """SELECT series_key, rule, passed FROM (SELECT series_key,
      coalesce(bool_and(load >= 0), true) AS load_nonnegative, coalesce(bool_and(gen_solar >= 0), true) AS gen_solar_nonnegative,
      coalesce(bool_and(gen_wind_onshore >= 0), true) AS gen_wind_onshore_nonnegative,
      coalesce(bool_and(price BETWEEN 10 AND 95), true) AS price_in_range,
      coalesce(bool_and(temp_a BETWEEN -30 AND 25), true) AS temp_in_range FROM m GROUP BY 1)
      UNPIVOT (passed FOR rule IN (load_nonnegative, gen_solar_nonnegative, gen_wind_onshore_nonnegative, price_in_range, temp_in_range))""",
)
def _(spark, d):
    rules = {
        "load_nonnegative": F.col("load") >= 0,
        "gen_solar_nonnegative": F.col("gen_solar") >= 0,
        "gen_wind_onshore_nonnegative": F.col("gen_wind_onshore") >= 0,
        "price_in_range": F.col("price").between(10, 95),
        "temp_in_range": F.col("temp_a").between(-30, 25),
    }
    return P.check_rules(pn.market(spark, d), rules, keys=[KEY])


@query(
    "f6_split_leakage",
    with_ctes(pn.H, HS) + """, b AS (SELECT split, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM hs GROUP BY 1)
    SELECT a.split AS split_a, c.split AS split_b, (a.hi < c.lo OR c.hi < a.lo) AS is_disjoint FROM b a JOIN b c ON a.split < c.split""",
)
def _(spark, d):
    h = pn.hourly(spark, d).withColumn("split", P.split_label(BOUNDS))
    return P.split_overlaps(h)


@query(
    "f7_context_then_restrict",
    with_ctes(pn.H) + f"""SELECT series_key, ts, {r('m')} AS mean_168 FROM (SELECT series_key, ts,
      avg(price) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS m FROM h) WHERE ts >= TIMESTAMP '2024-01-26'""",
)
def _(spark, d):
    from panelcast.operators.buckets import over_buckets

    h = P.with_context(pn.hourly(spark, d), "2024-01-26", 168)
    out = over_buckets(h, {"mean_168": lambda w: F.avg("price").over(w.rowsBetween(-168, -1))}, back=168)
    return out.where(F.col(TS) >= F.lit("2024-01-26").cast("timestamp")).select(KEY, TS, "mean_168")
