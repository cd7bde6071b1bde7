"""Sources, sinks and catalogue (S)."""

from pyspark.sql import functions as F

from panelcast.functions import predicates as P
from panelcast.plans import panels as pn
from panelcast.plans.q_grid import BOUNDS, HS
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import KEY, TS
from panelcast.session import scratch_path
from panelcast.sources import catalog, feeds
from panelcast.sources.tables import masked_columns, read_split, read_table, with_mask_indicators


@query("s1_load_events", f"SELECT event_id, ts, user_id, event_type, {r('value')} AS value FROM events")
def _(spark, d):
    return read_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])


def _written_split(spark, d):
    h = pn.hourly(spark, d).withColumn("split", P.split_label(BOUNDS))
    path = scratch_path(spark, "splits")
    catalog.write_splits(h.repartition("split", KEY), path)
    return spark.read.parquet(path)


@query("s2_s6_split_round_trip", with_ctes(pn.H, HS) + f"SELECT series_key, ts, split, {r('price')} AS price, activity FROM hs WHERE split = 'val'")
def _(spark, d):
    return read_split(_written_split(spark, d), "val").select(KEY, TS, "split", "price", "activity")


@query(
    "s3_mask_indicators",
    with_ctes(pn.HF, HS) + f"""SELECT f.series_key, f.ts, {r('f.price')} AS price, (hs.price IS NULL)::INTEGER AS price_was_missing,
    (hs.load IS NULL)::INTEGER AS load_was_missing FROM hf f JOIN hs ON f.series_key = hs.series_key AND f.ts = hs.ts WHERE hs.split = 'train'""",
)
def _(spark, d):
    raw = pn.hourly(spark, d)
    mask = raw.select(KEY, TS, *[F.col(c).isNull().alias(c) for c in ("price", "load")])
    cols = masked_columns(mask, ["price", "load"]) or ["price", "load"]
    filled = pn.hourly_filled(spark, d).withColumn("split", P.split_label(BOUNDS))
    return with_mask_indicators(read_split(filled, "train"), mask, [KEY, TS], cols).select(
        KEY, TS, "price", "price_was_missing", "load_was_missing"
    )


@query(
    "s4_market_documents",
    f"""SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, 'B0' || length(event_type)::VARCHAR AS psr_type,
    {r('avg(value)', 5)} AS value FROM events GROUP BY 1, 2, 3""",
    digits={"value": 5},
)
def _(spark, d):
    """Hourly prices rendered as one market document per series and day, then parsed back."""
    raw = pn.hourly_raw(spark, d).withColumn("day", F.date_trunc("day", TS))
    point = F.concat(
        F.lit("<Point><position>"), (F.hour(TS) + 1).cast("string"), F.lit("</position><price.amount>"),
        F.format_string("%.9f", F.col("price")), F.lit("</price.amount></Point>"),
    )
    docs = raw.groupBy(KEY, "day").agg(F.concat_ws("", F.array_sort(F.collect_list(point))).alias("pts")).select(
        KEY,
        F.concat(
            F.lit('<Publication_MarketDocument xmlns="urn:market:7:3"><TimeSeries><MktPSRType><psrType>B0'), F.length(KEY).cast("string"),
            F.lit("</psrType></MktPSRType><Period><timeInterval><start>"), F.date_format("day", "yyyy-MM-dd'T'HH:mm'Z'"),
            F.lit("</start></timeInterval><resolution>PT60M</resolution>"), "pts", F.lit("</Period></TimeSeries></Publication_MarketDocument>"),
        ).alias("xml"),
    )
    return feeds.parse_documents(docs, "xml", [KEY])


@query(
    "s5_json_daily_last",
    f"""SELECT event_type AS series_key, ts::DATE::TIMESTAMP AS ts, {r('arg_max(value, (epoch_us(ts) // 1000000) * 1000000000 + event_id)')} AS price FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    """Payloads of one series and hour, holding the last quote of each second."""
    e = read_table(spark, d, "events", ["event_id", "ts", "event_type", "value"])
    per_second = e.groupBy(F.col("event_type").alias(KEY), F.unix_seconds(TS).alias("s")).agg(F.max_by("value", "event_id").alias("v"))
    docs = per_second.groupBy(KEY, F.floor(F.col("s") / 3600).alias("hour")).agg(
        F.array_sort(F.collect_list(F.struct("s", "v"))).alias("a")
    )
    json = F.to_json(F.struct(F.col("a.s").alias("unix_seconds"), F.col("a.v").alias("price")))
    return feeds.daily_last_quotes(docs.select(KEY, json.alias("json")), "json", [KEY])


@query(
    "s7_split_catalogue",
    with_ctes(pn.H, HS) + "SELECT split, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows, 5::INTEGER AS n_columns FROM hs GROUP BY 1",
)
def _(spark, d):
    return catalog.split_catalogue(pn.hourly(spark, d).withColumn("split", P.split_label(BOUNDS)))


_RATE = "avg(({c} IS NULL)::INTEGER)"


@query(
    "s8_validate_output",
    with_ctes(pn.H) + f"""SELECT dataset, n_rows, first_ts, last_ts, reasons = '' AS passed, reasons FROM (SELECT dataset, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
    concat_ws('; ', CASE WHEN count(*) < least_rows THEN 'too few rows' END, CASE WHEN min(ts) > TIMESTAMP '2024-01-03' THEN 'starts late' END,
    CASE WHEN max(ts) < TIMESTAMP '2024-01-15' THEN 'ends early' END, CASE WHEN {_RATE.format(c='price')} > 0.5 THEN 'price over half null' END) AS reasons FROM h, (VALUES ('hourly', 1000000000), ('hourly, small', 100)) AS v(dataset, least_rows) GROUP BY dataset, least_rows)""",
)
def _(spark, d):
    h = pn.hourly(spark, d)
    dates = {"start": "2024-01-01", "end": "2024-01-15"}
    v = catalog.validate(h, "hourly", ["price"], min_rows=1_000_000_000, **dates).unionByName(catalog.validate(h, "hourly, small", ["price"], min_rows=100, **dates))
    return v.withColumn("reasons", F.concat_ws("; ", "reasons"))


@query(
    "s9_inventory",
    with_ctes(pn.H, pn.D, pn.M) + " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, {r('greatest(' + ', '.join(_RATE.format(c=c) for c in cs) + ')')} AS max_null_rate FROM {t}"
        for n, t, cs in (("hourly", "h", ["price", "load"]), ("daily", "d", ["price", "load"]), ("market", "m", ["price", "gen_solar", "FR_to_DELU"]))
    ),
)
def _(spark, d):
    return catalog.inventory({
        "hourly": (pn.hourly(spark, d), TS, ["price", "load"]),
        "daily": (pn.daily(spark, d), TS, ["price", "load"]),
        "market": (pn.market(spark, d), TS, ["price", "gen_solar", "FR_to_DELU"]),
    })
