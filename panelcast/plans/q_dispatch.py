"""Storage dispatch (B)."""

from pyspark.sql import functions as F

from panelcast.operators import dispatch as D
from panelcast.operators import grid
from panelcast.plans import forecasts as fc
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import KEY, TS
from panelcast.session import materialize


def _episodes(spark, d):
    return D.episodes(pn.hourly_filled(spark, d).select(KEY, TS, "price"))


def _greedy(spark, d):
    return D.simulate(D.rank_actions(_episodes(spark, d), "price"), F.col("action") * D.POWER)


def _policies(spark, d):
    """Episode profits of the greedy, scheduled and idle policies."""
    e = materialize(_episodes(spark, d))
    runs = {
        "greedy": D.rank_actions(e, "price"), "schedule": D.hourly_actions(e), "idle": D.hourly_actions(e, (), ()),
    }
    out = None
    for name, acted in runs.items():
        p = D.episode_profits(D.simulate(acted, F.col("action") * D.POWER)).withColumn("policy", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return materialize(out)


# the battery as a recursion over the steps of each day
_SIM = """ep AS (SELECT series_key, ts::DATE::TIMESTAMP AS episode, hour(ts)::INTEGER AS step, ts, price, count(*) OVER (PARTITION BY series_key, ts::DATE) AS n FROM hf),
act AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_key, episode ORDER BY price, step) <= 2 THEN -1 WHEN row_number() OVER (PARTITION BY series_key, episode ORDER BY price DESC, step DESC) <= 2 THEN 1 ELSE 0 END AS greedy,
  CASE WHEN step BETWEEN 0 AND 5 THEN -1 WHEN step BETWEEN 8 AND 13 THEN 1 ELSE 0 END AS schedule FROM ep WHERE n = 24),
sim AS (SELECT series_key, episode, -1 AS step, 50.0::DOUBLE AS soc, 0.0::DOUBLE AS power, 0.0::DOUBLE AS profit, NULL::TIMESTAMP AS ts FROM act GROUP BY series_key, episode
  UNION ALL SELECT a.series_key, a.episode, a.step, greatest(least(CASE WHEN p >= 0 THEN s.soc - p / sqrt(0.9::DOUBLE) ELSE s.soc - p * sqrt(0.9::DOUBLE) END, 100), 0), p, a.price * p, a.ts
  FROM sim s JOIN act a ON a.series_key = s.series_key AND a.episode = s.episode AND a.step = s.step + 1,
  LATERAL (SELECT CASE WHEN a.{policy} * 50 >= 0 THEN least(a.{policy} * 50.0::DOUBLE, s.soc * sqrt(0.9::DOUBLE)) ELSE greatest(a.{policy} * 50.0::DOUBLE, -(100 - s.soc) / sqrt(0.9::DOUBLE)) END AS p))"""


def sim_sql(policy: str, tail: str) -> str:
    return with_ctes(pn.HF, _SIM.format(policy=policy)).replace("WITH ", "WITH RECURSIVE ", 1) + tail


@query("b1_b3_greedy_steps", sim_sql("greedy", f"SELECT series_key, episode, step, ts, {r('soc')} AS soc, {r('power')} AS power, {r('profit')} AS profit FROM sim WHERE step >= 0"))
def _(spark, d):
    return _greedy(spark, d).select(KEY, "episode", "step", TS, "soc", "power", "profit")


@query("b2_schedule_profit", sim_sql("schedule", f"SELECT series_key, episode, {r('sum(profit)')} AS profit FROM sim GROUP BY 1, 2"))
def _(spark, d):
    e = D.hourly_actions(_episodes(spark, d))
    return D.episode_profits(D.simulate(e, F.col("action") * D.POWER))


_FORECAST_ACT = """ep AS (SELECT series_key, target_ts::DATE::TIMESTAMP AS episode, hour(target_ts)::INTEGER AS step, target_ts AS ts, y AS price, q10, q50, q90, count(*) OVER (PARTITION BY series_key, target_ts::DATE) AS n FROM weekly WHERE hour(origin_ts) = 23),
rk AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_key, episode ORDER BY q50, step) <= 2 THEN -1 WHEN row_number() OVER (PARTITION BY series_key, episode ORDER BY q50 DESC, step DESC) <= 2 THEN 1 ELSE 0 END AS a FROM ep WHERE n = 24),
act AS (SELECT *, CASE WHEN max(CASE WHEN a < 0 THEN q90 END) OVER (PARTITION BY series_key, episode) < min(CASE WHEN a > 0 THEN q10 END) OVER (PARTITION BY series_key, episode) THEN a ELSE 0 END AS banded FROM rk),
sim AS""" + _SIM.format(policy="banded").split("sim AS", 1)[1]


@query(
    "b4_forecast_driven_policy",
    with_ctes(fc.FC, _FORECAST_ACT).replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT series_key, episode, step, ts, {r('soc')} AS soc, {r('power')} AS power, {r('profit')} AS profit FROM sim WHERE step >= 0",
)
def _(spark, d):
    """Hours ranked by the day-ahead median, traded only on days whose bands part; settled at actual prices."""
    w = fc.weekly(pn.hourly_filled(spark, d)).where(F.hour("origin_ts") == 23)
    e = D.episodes(w.select(KEY, F.col("target_ts").alias(TS), F.col("y").alias("price"), "q10", "q50", "q90"))
    acted = D.where_bands_part(D.rank_actions(e, "q50"))
    return D.simulate(acted, F.col("action") * D.POWER).select(KEY, "episode", "step", TS, "soc", "power", "profit")


@query(
    "b5_episode_summary",
    sim_sql("greedy", f""", pr AS (SELECT series_key, episode, sum(profit) AS profit FROM sim GROUP BY 1, 2)
    SELECT p.series_key, {r('avg(profit)')} AS mean, {r('stddev_pop(profit)')} AS std, {r('quantile_cont(profit, 0.5)')} AS median, {r('coalesce(avg(profit) FILTER (profit <= c), max(c))')} AS cvar_5pct, {r('avg(profit) / stddev_pop(profit)')} AS sharpe,
    {r('quantile_cont(profit, 0.1)')} AS p10, {r('quantile_cont(profit, 0.9)')} AS p90, count(*) AS n_episodes, {r('avg((profit < 0)::INTEGER)')} AS loss_rate FROM pr p JOIN (SELECT series_key, quantile_cont(profit, 0.05) AS c FROM pr GROUP BY 1) q ON p.series_key = q.series_key GROUP BY 1"""),
)
def _(spark, d):
    return D.summary(materialize(D.episode_profits(_greedy(spark, d))), [KEY])


@query(
    "b6_tail_means",
    sim_sql("greedy", f""", pr AS (SELECT series_key, episode, sum(profit) AS profit FROM sim GROUP BY 1, 2), lv AS (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS level),
    cs AS (SELECT 0.01::DOUBLE AS level, quantile_cont(profit, 0.01) AS c FROM pr UNION ALL SELECT 0.05, quantile_cont(profit, 0.05) FROM pr UNION ALL SELECT 0.1, quantile_cont(profit, 0.1) FROM pr UNION ALL SELECT 0.2, quantile_cont(profit, 0.2) FROM pr)
    SELECT level, {r('coalesce(avg(profit) FILTER (profit <= c), max(c))')} AS cvar FROM pr, cs GROUP BY 1"""),
)
def _(spark, d):
    return D.tail_means(materialize(D.episode_profits(_greedy(spark, d))), [], "profit")


@query("b7_hourly_profile", sim_sql("greedy", f"SELECT step AS hour, {r('avg(power)')} AS mean_power, {r('avg(soc)')} AS mean_soc, {r('avg(profit)')} AS mean_profit FROM sim WHERE step >= 0 GROUP BY 1"))
def _(spark, d):
    return D.hourly_profile(_greedy(spark, d))


_BOTH = _SIM.format(policy="greedy") + ",\n" + "sim2" + _SIM.format(policy="schedule").split("sim", 1)[1].replace("FROM sim s", "FROM sim2 s")


@query(
    "b7_capture_ratio",
    with_ctes(pn.HF, _BOTH).replace("WITH ", "WITH RECURSIVE ", 1) + f""", ms AS (SELECT 'greedy' AS policy, avg(p) AS mean FROM (SELECT sum(profit) AS p FROM sim GROUP BY series_key, episode)
    UNION ALL SELECT 'schedule', avg(p) FROM (SELECT sum(profit) AS p FROM sim2 GROUP BY series_key, episode) UNION ALL SELECT 'idle', 0)
    SELECT policy, {r('mean')} AS mean, {r("mean - (SELECT mean FROM ms WHERE policy = 'greedy')")} AS delta, {r("mean / (SELECT mean FROM ms WHERE policy = 'greedy')")} AS capture FROM ms""",
)
def _(spark, d):
    return D.capture_ratio(_policies(spark, d).groupBy("policy").agg(F.avg("profit").alias("mean")))


_Z = lambda c: r(f"({c} - m) / s")


@query(
    "b8_decision_states",
    with_ctes(fc.FC) + f""", st AS (SELECT series_key, avg(price) AS m, coalesce(nullif(stddev_samp(price), 0), 1) AS s FROM hf WHERE ts < TIMESTAMP '{fc.TRAIN_END}' GROUP BY 1),
    wd AS (SELECT series_key, origin_ts, {', '.join(f'max({q}) FILTER (horizon_h = {k}) AS {q}_h{k}' for q in ('q10', 'q50', 'q90') for k in range(1, 25))} FROM weekly GROUP BY 1, 2)
    SELECT h.series_key, h.ts, {r('sin(hour(h.ts) * (2 * pi() / 24))')} AS hour_sin, {r('cos(hour(h.ts) * (2 * pi() / 24))')} AS hour_cos, {r('sin((isodow(h.ts) - 1) * (2 * pi() / 7))')} AS dow_sin, {r('cos((isodow(h.ts) - 1) * (2 * pi() / 7))')} AS dow_cos,
    {_Z('price')} AS price_z, {', '.join(f"{_Z(f'{q}_h{k}')} AS {q}_h{k}_z" for q in ('q10', 'q50', 'q90') for k in range(1, 25))}, {_Z('0')} AS extra_z FROM hf h JOIN st ON h.series_key = st.series_key JOIN wd ON wd.series_key = h.series_key AND wd.origin_ts = h.ts""",
)
def _(spark, d):
    h = materialize(pn.hourly_filled(spark, d).select(KEY, TS, "price"))
    train = h.where(F.col(TS) < F.lit(fc.TRAIN_END).cast("timestamp"))
    stats = train.groupBy(KEY).agg(
        F.avg("price").alias("mean"), F.coalesce(F.nullif(F.stddev_samp("price"), F.lit(0.0)), F.lit(1.0)).alias("scale")
    )
    wide = grid.forecast_wide(fc.weekly(h), prefix="").withColumnRenamed("origin_ts", TS)
    names = [f"{q}_h{k}" for q in ("q10", "q50", "q90") for k in range(1, 25)]
    return D.decision_states(h.join(wide, [KEY, TS]), [*names, "extra"], stats)
