"""Joins (J), set operations, ordering and top-k (O)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import dedupe, joins
from panelcast.operators.supervised import rolling_origin_folds
from panelcast.plans import forecasts as fc
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import DAY, HOUR, KEY, TS
from panelcast.session import materialize
from panelcast.sources.tables import read_table


@query(
    "j1_align_sources",
    with_ctes(pn.M, pn.FUELS, pn.WEATHER) + f"""SELECT m.series_key, m.ts, {r('m.price')} AS price, m.load, {r('f.ttf_gas')} AS ttf_gas, w.location, {r('w.temperature_2m')} AS temperature_2m,
    {r('w.windspeed_10m')} AS windspeed_10m FROM m LEFT JOIN fuels f ON m.ts = f.ts LEFT JOIN wl w ON m.ts = w.ts""",
)
def _(spark, d):
    """Market rows with the day's fuel quote and the weather of every region."""
    m = pn.market(spark, d).select(KEY, TS, "price", "load")
    return m.join(pn.fuels(spark, d).select(TS, "ttf_gas"), TS, "left").join(pn.weather_long(spark, d), TS, "left")


@query(
    "j2_inner_actuals",
    with_ctes(pn.H) + f"""SELECT h.series_key, h.ts, {r('h.price')} AS price, {r('a.load')} AS other_load FROM h JOIN hraw a
    ON h.ts = a.ts + INTERVAL 24 HOUR AND a.series_key = h.series_key WHERE h.price IS NOT NULL AND a.load IS NOT NULL""",
)
def _(spark, d):
    """Every series next to its own actuals as published a day later: rows known on both sides."""
    other = joins.shifted(pn.hourly_raw(spark, d), {"other_load": "load"}, 24 * HOUR)
    return pn.hourly(spark, d).select(KEY, TS, "price").join(other, [KEY, TS]).dropna()


@query(
    "j3_time_shifted_self",
    with_ctes(pn.H) + f"""SELECT h.series_key, h.ts, {r('h.price')} AS price, {r('b.price')} AS price_last_week FROM h LEFT JOIN h b
    ON h.series_key = b.series_key AND b.ts = h.ts - INTERVAL 168 HOUR""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price")
    return h.join(joins.shifted(h, {"price_last_week": "price"}, 168 * HOUR), [KEY, TS], "left")


@query(
    "j4_asof_backward",
    with_ctes(pn.MF) + f"SELECT series_key, ts, {r('ttf_gas')} AS ttf_gas, {r('carbon_ets')} AS carbon_ets FROM mf",
)
def _(spark, d):
    return pn.market_with_fuels(spark, d).select(KEY, TS, "ttf_gas", "carbon_ets")


@query(
    "j4_asof_keyed_ticks",
    f"""SELECT c.event_id, c.ts, {r('c.value')} AS value, {r('v.value')} AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
)
def _(spark, d):
    e = read_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    views = e.where("event_type = 'view'").select("user_id", TS, F.col("value").alias("last_view"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", TS, "value")
    return joins.asof_backward(clicks, views, ["last_view"], keys=["user_id"]).drop("user_id")


@query(
    "j5_left_optional_columns",
    with_ctes(pn.H) + f"""SELECT h.series_key, h.ts, {r('h.price')} AS price, {r('q.load')} AS load_hint FROM h LEFT JOIN
    (SELECT * FROM hraw WHERE activity >= 3) q ON h.series_key = q.series_key AND h.ts = q.ts""",
)
def _(spark, d):
    hint = pn.hourly_raw(spark, d).where("activity >= 3").select(KEY, TS, F.col("load").alias("load_hint"))
    return pn.hourly(spark, d).select(KEY, TS, "price").join(hint, [KEY, TS], "left")


@query("j6_left_semi", with_ctes(pn.H) + f"SELECT series_key, ts, {r('price')} AS price FROM h WHERE ts IN (SELECT ts FROM hraw WHERE series_key = 'error' AND activity >= 2)")
def _(spark, d):
    wanted = pn.hourly_raw(spark, d).where("series_key = 'error' AND activity >= 2").select(TS)
    return pn.hourly(spark, d).select(KEY, TS, "price").join(wanted, TS, "left_semi")


@query("j7_left_anti_missing_slots", with_ctes(pn.H) + "SELECT s.series_key, s.ts FROM hspine s ANTI JOIN hraw r ON s.series_key = r.series_key AND s.ts = r.ts")
def _(spark, d):
    from panelcast.operators import grid

    raw = pn.hourly_raw(spark, d)
    return grid.spine(raw).join(raw, [KEY, TS], "left_anti")


_FOLDS = """ends AS (SELECT min(ts) AS a, max(ts) AS z FROM h),
folds AS (SELECT k::INTEGER AS fold_id, a + k * INTERVAL 4 DAY AS train_start, a + k * INTERVAL 4 DAY + INTERVAL 8 DAY AS train_end,
  a + k * INTERVAL 4 DAY + INTERVAL 8 DAY + INTERVAL 24 HOUR AS val_start, a + k * INTERVAL 4 DAY + INTERVAL 12 DAY + INTERVAL 24 HOUR AS val_end
  FROM ends, (SELECT unnest(generate_series(0, 4)) AS k) WHERE a + k * INTERVAL 4 DAY + INTERVAL 12 DAY + INTERVAL 24 HOUR <= z)"""


@query(
    "j8_fold_range_join",
    with_ctes(pn.H, _FOLDS) + """SELECT f.fold_id, CASE WHEN h.ts BETWEEN f.train_start AND f.train_end THEN 'train' ELSE 'val' END AS part, h.series_key, h.ts
    FROM h JOIN folds f ON h.ts BETWEEN f.train_start AND f.train_end OR h.ts BETWEEN f.val_start AND f.val_end""",
)
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS)
    folds = rolling_origin_folds(h, n_folds=5, train_days=8, val_days=4, gap_hours=24)
    return joins.folds_join(h, folds).select("fold_id", "part", KEY, TS)


@query(
    "j9_common_keys",
    with_ctes(fc.FC) + f"""SELECT a.series_key, a.origin_ts, a.horizon_h, {r('a.q50')} AS weekly, {r('b.q50')} AS daily FROM weekly a
    JOIN daily b ON a.series_key = b.series_key AND a.origin_ts = b.origin_ts AND a.horizon_h = b.horizon_h""",
)
def _(spark, d):
    """Two forecast tables on the (series, origin, horizon) rows that both have."""
    h = materialize(pn.hourly_filled(spark, d))
    on = [KEY, "origin_ts", "horizon_h"]
    return fc.weekly(h).select(*on, F.col("q50").alias("weekly")).join(fc.seasonal(h).select(*on, F.col("q50").alias("daily")), on)


@query(
    "j10_dimension_join",
    f"""SELECT c_mktsegment, n_name, count(*) AS n, {r('sum(o_totalprice)', 2)} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    digits={"revenue": 2},
)
def _(spark, d):
    o = read_table(spark, d, "orders", ["o_custkey", "o_totalprice"])
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name"])
    # combine per customer before joining: the large side shrinks to one row per customer
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("c"))
    j = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.sum("c").alias("n"), F.sum("s").alias("revenue"))


@query(
    "j11_around_anchor",
    with_ctes(pn.D) + f"""SELECT series_key, ts, {r('price')} AS price, y::INTEGER AS anchor_year, (epoch_us(ts) - epoch_us(make_timestamp(y, 12, 25, 0, 0, 0.0))) / 3600000000.0::DOUBLE AS hours_from_anchor
    FROM d, (SELECT unnest(generate_series(1990, 2010)) AS y) WHERE abs(epoch_us(ts) - epoch_us(make_timestamp(y, 12, 25, 0, 0, 0.0))) <= 240 * 3600000000""",
)
def _(spark, d):
    return joins.around_anchor(pn.daily(spark, d).select(KEY, TS, "price"), 12, 25, 240)


# ---- set operations, ordering, top-k ----
@query("o1_concat_splits", with_ctes(pn.H) + f"SELECT series_key, ts, {r('price')} AS price, 'a' AS part FROM h WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT series_key, ts, {r('price')}, 'b' FROM h WHERE ts >= TIMESTAMP '2024-01-10'")
def _(spark, d):
    h = pn.hourly(spark, d).select(KEY, TS, "price")
    cut = F.lit("2024-01-10").cast("timestamp")
    return h.where(F.col(TS) < cut).withColumn("part", F.lit("a")).unionByName(h.where(F.col(TS) >= cut).withColumn("part", F.lit("b")))


for _last in (True, False):
    _name = "o2_keep_last" if _last else "o3_keep_first"

    @query(
        _name,
        f"""SELECT event_type, ts, event_id, {r('value')} AS value FROM (SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value,
        row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id {'DESC' if _last else 'ASC'}) AS rn FROM events) WHERE rn = 1""",
    )
    def _(spark, d, last=_last):
        e = read_table(spark, d, "events", ["event_type", "ts", "event_id", "value"]).withColumn(TS, F.date_trunc("hour", TS))
        return dedupe.keep_one(e, ["event_type", "ts"], "event_id", last=last)


@query(
    "o4_duplicates_and_gaps",
    with_ctes(pn.H) + """SELECT a.series_key, a.n_rows, a.n_keys, a.n_rows - a.n_keys AS n_duplicates, coalesce(g.n_gaps, 0) AS n_gaps FROM
    (SELECT event_type AS series_key, count(*) AS n_rows, count(DISTINCT date_trunc('hour', ts)) AS n_keys FROM events GROUP BY 1) a
    LEFT JOIN (SELECT series_key, count(*) AS n_gaps FROM h WHERE price IS NULL GROUP BY 1) g ON a.series_key = g.series_key""",
)
def _(spark, d):
    e = read_table(spark, d, "events", ["ts", "event_type"]).select(F.col("event_type").alias(KEY), F.date_trunc("hour", TS).alias(TS))
    holes = pn.hourly(spark, d).where("price IS NULL").groupBy(KEY).agg(F.count(F.lit(1)).alias("n_gaps"))
    return dedupe.duplicate_counts(e, [KEY], [TS]).join(holes, KEY, "left").fillna(0, subset=["n_gaps"])


@query("o5_set_difference", with_ctes(pn.H) + "SELECT series_key, ts FROM hraw EXCEPT SELECT series_key, ts + INTERVAL 24 HOUR FROM hraw")
def _(spark, d):
    """Hours of each series without the same hour a day before."""
    raw = pn.hourly_raw(spark, d).select(KEY, TS)
    return raw.subtract(joins.shifted(raw, {}, 24 * HOUR))


@query("o6_set_intersection", with_ctes(pn.H) + "SELECT series_key, ts FROM hraw INTERSECT SELECT series_key, ts + INTERVAL 24 HOUR FROM hraw")
def _(spark, d):
    """Hours of each series that it also has a day before."""
    raw = pn.hourly_raw(spark, d).select(KEY, TS)
    return raw.intersect(joins.shifted(raw, {}, 24 * HOUR))


@query("o7_sorted_by_key_and_metric", with_ctes(pn.H) + f"SELECT series_key, ts, {r('load')} AS load FROM hraw ORDER BY series_key, load DESC, ts")
def _(spark, d):
    return pn.hourly_raw(spark, d).select(KEY, TS, "load").orderBy(KEY, F.desc("load"), TS)


_GEN = list(pn.GENERATION.values())


@query(
    "o8_top_null_columns",
    with_ctes(pn.M) + f"""SELECT metric, {r('rate')} AS null_rate FROM (SELECT {', '.join(f'avg(({c} IS NULL)::INTEGER) AS {c}' for c in _GEN)} FROM m)
    UNPIVOT (rate FOR metric IN ({', '.join(_GEN)})) ORDER BY rate DESC, metric LIMIT 3""",
)
def _(spark, d):
    a = pn.market(spark, d).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in _GEN])
    long = a.unpivot([], _GEN, "metric", "null_rate")
    return long.orderBy(F.desc("null_rate"), "metric").limit(3)


@query(
    "o9_cheapest_and_dearest_hours",
    with_ctes(pn.HF) + f"""SELECT series_key, ts, {r('price')} AS price, CASE WHEN a <= 2 THEN 'cheap' ELSE 'dear' END AS side FROM (SELECT series_key, ts, price,
    row_number() OVER (PARTITION BY series_key, ts::DATE ORDER BY price, ts) AS a, row_number() OVER (PARTITION BY series_key, ts::DATE ORDER BY price DESC, ts DESC) AS b FROM hf) WHERE a <= 2 OR b <= 2""",
)
def _(spark, d):
    h = pn.hourly_filled(spark, d).select(KEY, TS, "price")
    day = F.date_trunc("day", TS)
    lo = Window.partitionBy(KEY, day).orderBy("price", TS)
    hi = Window.partitionBy(KEY, day).orderBy(F.desc("price"), F.desc(TS))
    ranked = h.select("*", F.row_number().over(lo).alias("a"), F.row_number().over(hi).alias("b"))
    return ranked.where("a <= 2 OR b <= 2").select(KEY, TS, "price", F.when(F.col("a") <= 2, "cheap").otherwise("dear").alias("side"))


@query(
    "o10_gap_frequencies",
    with_ctes(pn.H) + """SELECT gap_seconds, count(*) AS n FROM (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_key ORDER BY ts))) // 1000000 AS gap_seconds FROM hraw)
    WHERE gap_seconds IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap_seconds LIMIT 5""",
)
def _(spark, d):
    gaps = dedupe.stamp_gaps(pn.hourly_raw(spark, d)).where("gap_seconds IS NOT NULL")
    return gaps.groupBy("gap_seconds").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gap_seconds").limit(5)
