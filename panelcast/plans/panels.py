"""Panels derived from the given tables, and the same panels as SQL.

hourly   events by event type: mean value as ``price``, sum as ``load``
daily    orders by priority: mean total price as ``price``, sum as ``load``
market   line items by return flag and day: price, load, generation by type,
         border flows, fuels; the wide panel used by the feature operators
weather  line items by day and supplier region, long
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import fills, grid
from panelcast.operators.joins import asof_backward
from panelcast.schemas import DAY, HOUR, KEY, TS
from panelcast.sources.tables import read_table

# Line number -> production type of the market panel.
GENERATION = {
    1: "gen_solar", 2: "gen_wind_onshore", 3: "gen_wind_offshore", 4: "gen_hydro_ror",
    5: "gen_fossil_gas", 6: "gen_fossil_coal_gas", 7: "gen_hydro_pumped",
}
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def hourly_raw(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events", ["ts", "event_type", "value"])
    return e.groupBy(F.col("event_type").alias(KEY), F.date_trunc("hour", TS).alias(TS)).agg(
        F.avg("value").alias("price"), F.sum("value").alias("load"), F.count(F.lit(1)).alias("activity")
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return grid.reindex(hourly_raw(spark, folder))


def hourly_filled(spark: SparkSession, folder: str) -> DataFrame:
    return fills.ffill_bfill(hourly(spark, folder), ["price", "load"])


def daily_raw(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders", ["o_orderdate", "o_orderpriority", "o_totalprice"])
    return o.groupBy(F.col("o_orderpriority").alias(KEY), F.date_trunc("day", "o_orderdate").alias(TS)).agg(
        (F.avg("o_totalprice") / 1000).alias("price"), (F.sum("o_totalprice") / 1000).alias("load"),
        F.count(F.lit(1)).alias("activity"),
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return grid.reindex(daily_raw(spark, folder), step=DAY)


def fuels(spark: SparkSession, folder: str) -> DataFrame:
    """Daily fuel quotes: business days only, no series key."""
    o = read_table(spark, folder, "orders", ["o_orderdate", "o_totalprice"])
    return o.where(F.weekday("o_orderdate") < 5).groupBy(F.date_trunc("day", "o_orderdate").alias(TS)).agg(
        (F.avg("o_totalprice") / 10000).alias("ttf_gas"),
        (F.max("o_totalprice") / 10000).alias("carbon_ets"),
    )


def market_raw(spark: SparkSession, folder: str) -> DataFrame:
    l = read_table(
        spark, folder, "lineitem",
        ["l_shipdate", "l_returnflag", "l_linenumber", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    )
    q = F.col("l_quantity")
    gens = [F.sum(F.when(F.col("l_linenumber") == k, q)).alias(v) for k, v in GENERATION.items()]
    inflow, outflow = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    flows = [
        F.sum(F.when(inflow & F.col("l_linenumber").isin(a, b), q)).alias(f"{p}_to_DELU")
        for p, a, b in (("FR", 1, 2), ("AT", 3, 4), ("CH", 5, 6))
    ] + [
        F.sum(F.when(outflow & F.col("l_linenumber").isin(a, b), q)).alias(f"DELU_to_{p}")
        for p, a, b in (("FR", 1, 2), ("AT", 3, 4), ("CH", 5, 6))
    ]
    return l.groupBy(F.col("l_returnflag").alias(KEY), F.date_trunc("day", "l_shipdate").alias(TS)).agg(
        (F.avg("l_extendedprice") / 1000).alias("price"), F.sum("l_quantity").alias("load"),
        (F.avg("l_discount") * 300).alias("temp_a"), (F.avg("l_tax") * 300).alias("temp_b"),
        *gens, *flows,
    )


def market(spark: SparkSession, folder: str) -> DataFrame:
    return grid.reindex(market_raw(spark, folder), step=DAY)


def market_with_fuels(spark: SparkSession, folder: str) -> DataFrame:
    """Fuel quotes carried onto each day; done once per day, then joined to all series."""
    m = market(spark, folder)
    days = m.select(TS).distinct()
    quotes = asof_backward(days, fuels(spark, folder), ["ttf_gas", "carbon_ets"], keys=(), step=DAY)
    return m.join(quotes, TS)


def weather_long(spark: SparkSession, folder: str) -> DataFrame:
    l = read_table(spark, folder, "lineitem", ["l_shipdate", "l_suppkey", "l_discount", "l_tax"])
    s = read_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey"])
    n = read_table(spark, folder, "nation", ["n_nationkey", "n_regionkey"])
    g = read_table(spark, folder, "region", ["r_regionkey", "r_name"])
    dims = s.join(n, s.s_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return (
        l.join(dims.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.date_trunc("day", "l_shipdate").alias(TS), F.col("r_name").alias("location"))
        .agg((F.avg("l_discount") * 300).alias("temperature_2m"), (F.avg("l_tax") * 100).alias("windspeed_10m"))
    )


# ---- the same panels as SQL common table expressions ----

H_RAW = """hraw AS (SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, avg(value) AS price,
  sum(value) AS load, count(*) AS activity FROM events GROUP BY 1, 2)"""
H = H_RAW + """,
hspine AS (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hraw GROUP BY 1),
h AS (SELECT s.series_key, s.ts, r.price, r.load, r.activity FROM hspine s LEFT JOIN hraw r
  ON s.series_key = r.series_key AND s.ts = r.ts)"""


def sql_filled(name: str, source: str, cols, keep=()) -> str:
    def one(c):
        return (
            f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        )

    return f"{name} AS (SELECT series_key, ts, " + ", ".join([*keep, *map(one, cols)]) + f" FROM {source})"


HF = H + ",\n" + sql_filled("hf", "h", ["price", "load"])
D = """draw AS (SELECT o_orderpriority AS series_key, o_orderdate::DATE::TIMESTAMP AS ts, avg(o_totalprice) / 1000 AS price,
  sum(o_totalprice) / 1000 AS load, count(*) AS activity FROM orders GROUP BY 1, 2),
dspine AS (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM draw GROUP BY 1),
d AS (SELECT s.series_key, s.ts, r.price, r.load, r.activity FROM dspine s LEFT JOIN draw r
  ON s.series_key = r.series_key AND s.ts = r.ts)"""
FUELS = """fuels AS (SELECT o_orderdate::DATE::TIMESTAMP AS ts, avg(o_totalprice) / 10000 AS ttf_gas, max(o_totalprice) / 10000 AS carbon_ets
  FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1)"""
_GEN_SQL = ", ".join(f"sum(l_quantity) FILTER (l_linenumber = {k}) AS {v}" for k, v in GENERATION.items())
_FLOW_SQL = ", ".join(
    f"sum(l_quantity) FILTER (l_linestatus = 'O' AND l_linenumber IN ({a}, {b})) AS {p}_to_DELU, "
    f"sum(l_quantity) FILTER (l_linestatus = 'F' AND l_linenumber IN ({a}, {b})) AS DELU_to_{p}"
    for p, a, b in (("FR", 1, 2), ("AT", 3, 4), ("CH", 5, 6))
)
M = f"""mraw AS (SELECT l_returnflag AS series_key, l_shipdate::DATE::TIMESTAMP AS ts, avg(l_extendedprice) / 1000 AS price,
  sum(l_quantity) AS load, avg(l_discount) * 300 AS temp_a, avg(l_tax) * 300 AS temp_b, {_GEN_SQL}, {_FLOW_SQL}
  FROM lineitem GROUP BY 1, 2),
mspine AS (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM mraw GROUP BY 1),
m AS (SELECT s.series_key AS series_key, s.ts AS ts, r.* EXCLUDE (series_key, ts) FROM mspine s LEFT JOIN mraw r
  ON s.series_key = r.series_key AND s.ts = r.ts)"""
MF = M + ",\n" + FUELS + """,
mdays AS (SELECT DISTINCT ts FROM m),
quotes AS (SELECT d.ts, f.ttf_gas, f.carbon_ets FROM mdays d ASOF LEFT JOIN fuels f ON d.ts >= f.ts),
mf AS (SELECT m.*, q.ttf_gas, q.carbon_ets FROM m JOIN quotes q ON m.ts = q.ts)"""
WEATHER = """wl AS (SELECT l_shipdate::DATE::TIMESTAMP AS ts, r_name AS location, avg(l_discount) * 300 AS temperature_2m, avg(l_tax) * 100 AS windspeed_10m
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""
