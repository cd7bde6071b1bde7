"""Streaming operators (T), run over the available data and returned as tables."""

from pyspark.sql import functions as F

from panelcast.plans import forecasts as fc
from panelcast.plans import panels as pn
from panelcast.plans.registry import ORACLE, query, r, with_ctes
from panelcast.schemas import KEY, TS
from panelcast.session import scratch_path
from panelcast.streaming import operators as S
from panelcast.streaming.feeds import in_slices, run_available, stream_folder


def _events(spark, d):
    return stream_folder(spark, d, "events.parquet").select(
        F.col("event_type").alias(KEY), TS, "value", "user_id", "event_id"
    )


def _as_stream(spark, df, label):
    """A batch table written out and read back as a stream of its files."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return stream_folder(spark, path)


@query(
    "t1_tumbling_hourly",
    f"""SELECT event_type AS series_key, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, {r('avg(value)')} AS mean, {r('sum(value)')} AS total FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    return run_available(S.tumbling(_events(spark, d), {"mean": F.avg("value"), "total": F.sum("value")}), "tumbling")


@query(
    "t2_sliding_day",
    f"""SELECT event_type AS series_key, w AS window_start, w + INTERVAL 24 HOUR AS window_end, {r('avg(value)')} AS mean, count(*) AS n FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events)
    WHERE w + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    return run_available(S.sliding(_events(spark, d), {"mean": F.avg("value"), "n": F.count(F.lit(1))}), "sliding")


@query(
    "t3_sessions",
    """WITH a AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR)::INTEGER AS brk FROM events), b AS (SELECT user_id, ts, sum(coalesce(brk, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a)
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM b GROUP BY user_id, g HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
)
def _(spark, d):
    return run_available(S.sessions(_events(spark, d), keys=["user_id"]), "sessions")


@query("t4_first_per_key", "SELECT DISTINCT event_type AS series_key, date_trunc('hour', ts) AS ts FROM events")
def _(spark, d):
    e = _events(spark, d).select(KEY, F.date_trunc("hour", TS).alias(TS))
    return run_available(S.first_per_key(e), "first")


@query(
    "t4_last_per_key",
    """SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, arg_max(event_id, event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events
    WHERE date_trunc('hour', ts) < (SELECT max(date_trunc('hour', ts)) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    """Newest event of each hour, given out when the watermark has passed the hour's stamp."""
    e = _events(spark, d).select(KEY, F.date_trunc("hour", TS).alias(TS), "event_id", "user_id")
    return run_available(S.last_per_key(e, "event_id"), "last")


@query(
    "t5_online_conformal",
    with_ctes(fc.FC).replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT *, row_number() OVER (PARTITION BY series_key, horizon_h ORDER BY origin_ts) AS i FROM weekly),
    f AS (SELECT DISTINCT series_key, horizon_h, 0::BIGINT AS i, 0.0::DOUBLE AS delta, 0.0::DOUBLE AS err FROM o UNION ALL SELECT o.series_key, o.horizon_h, o.i, greatest(0.0::DOUBLE, f.delta + 0.005::DOUBLE * (e - 0.2::DOUBLE)), e FROM f JOIN o ON o.series_key = f.series_key AND o.horizon_h = f.horizon_h AND o.i = f.i + 1,
      LATERAL (SELECT CASE WHEN o.y < o.q10 - f.delta OR o.y > o.q90 + f.delta THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e))
    SELECT o.series_key, o.horizon_h, o.origin_ts, {r('q10 - delta')} AS q10, {r('q90 + delta')} AS q90, {r('delta')} AS delta, {r('err')} AS err FROM o JOIN f ON o.series_key = f.series_key AND o.horizon_h = f.horizon_h AND o.i = f.i""",
)
def _(spark, d):
    w = fc.weekly(pn.hourly_filled(spark, d)).select(KEY, "horizon_h", "origin_ts", "q10", "q90", "y")
    return run_available(S.online_conformal(in_slices(w, "origin_ts", "scored")), "conformal")


@query("t6_risk_monitor", ORACLE["w19_rolling_tail_risk"])
def _(spark, d):
    p = pn.hourly_filled(spark, d).select(KEY, TS, (F.col("price") - 50).alias("profit"))
    return run_available(S.risk_monitor(in_slices(p, TS, "profits")), "risk")


@query(
    "t7_stream_static_enrichment",
    f"""SELECT event_id, e.event_type AS series_key, ts, {r('(value - m) / s')} AS z FROM events e JOIN (SELECT event_type, avg(value) AS m, coalesce(nullif(stddev_pop(value), 0), 1) AS s FROM events GROUP BY 1) q ON e.event_type = q.event_type""",
)
def _(spark, d):
    from panelcast.operators.quality import fit_scaler
    from panelcast.sources.tables import read_table

    e = read_table(spark, d, "events", ["event_type", "value"]).withColumnRenamed("event_type", KEY)
    stats = fit_scaler(e, {"value": F.col("value")}, [KEY]).drop("metric")
    z = S.enrich(_events(spark, d), stats, KEY)
    return run_available(z.select("event_id", KEY, TS, ((F.col("value") - F.col("mean")) / F.col("scale")).alias("z")), "enriched")


@query(
    "t8_stream_stream_scoring",
    with_ctes(fc.FC) + f"SELECT series_key, origin_ts, horizon_h, target_ts, {r('q50')} AS q50, {r('y')} AS y FROM weekly",
)
def _(spark, d):
    h = pn.hourly_filled(spark, d)
    f = _as_stream(spark, fc.weekly(h).select(KEY, "origin_ts", "horizon_h", "target_ts", "q50"), "forecasts")
    a = _as_stream(spark, h.select(KEY, TS, F.col("price").alias("y")), "actuals")
    return run_available(S.score_on_arrival(f, a), "scoring")
