"""Conformal calibration (K)."""

from pyspark.sql import functions as F

from panelcast.operators import conformal as C
from panelcast.operators import metrics as M
from panelcast.plans import forecasts as fc
from panelcast.plans import panels as pn
from panelcast.plans.q_metrics import STANDARD
from panelcast.plans.registry import query, r, with_ctes
from panelcast.schemas import KEY
from panelcast.session import materialize

_CUT = f"TIMESTAMP '{fc.TEST_START}'"


def sql_deltas(name: str, keys: str, higher: bool) -> str:
    """Order statistic of the calibration scores by rank."""
    index = "ceil((n - 1) * lv)" if higher else "floor((n - 1) * lv)"
    value = (
        "max(s) FILTER (rn - 1 = ceil((n - 1) * lv))" if higher
        else "max(s) FILTER (rn - 1 = floor((n - 1) * lv)) + (max(s) FILTER (rn - 1 = ceil((n - 1) * lv)) - max(s) FILTER (rn - 1 = floor((n - 1) * lv))) * max((n - 1) * lv - floor((n - 1) * lv))"
    )
    return f"""{name} AS (SELECT {keys}, max(n) AS n, {value} AS delta FROM (SELECT *, least(ceil((n + 1) * 0.8::DOUBLE) / n, 1.0) AS lv FROM (
      SELECT *, greatest(q10 - y, y - q90) AS s, count(*) OVER (PARTITION BY {keys}) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY greatest(q10 - y, y - q90)) AS rn
      FROM weekly WHERE target_ts < {_CUT})) GROUP BY {keys})"""


def _parts(spark, d):
    """Calibration rows (targets before the test start) and test rows."""
    w = materialize(fc.weekly(pn.hourly_filled(spark, d)))
    cut = F.lit(fc.TEST_START).cast("timestamp")
    return w.where(F.col("target_ts") < cut), w.where(F.col("origin_ts") >= cut)


@query("k1_pooled_deltas", with_ctes(fc.FC, sql_deltas("dl", "series_key", False)) + f"SELECT series_key, n, {r('delta')} AS delta, 0.2::DOUBLE AS alpha FROM dl")
def _(spark, d):
    return C.deltas(_parts(spark, d)[0], [KEY])


@query("k2_per_horizon_deltas", with_ctes(fc.FC, sql_deltas("dl", "series_key, horizon_h", True)) + f"SELECT series_key, horizon_h, n, {r('delta')} AS delta, 0.2::DOUBLE AS alpha FROM dl")
def _(spark, d):
    return C.deltas(_parts(spark, d)[0], [KEY, "horizon_h"], method="higher")


@query(
    "k2_k4_calibrated_test_forecasts",
    with_ctes(fc.FC, sql_deltas("dl", "series_key, horizon_h", True)) + f"""SELECT w.series_key, w.origin_ts, w.horizon_h, {r('q10 - coalesce(delta, 0)')} AS q10, {r('q50')} AS q50, {r('q90 + coalesce(delta, 0)')} AS q90 FROM weekly w
    LEFT JOIN dl ON w.series_key = dl.series_key AND w.horizon_h = dl.horizon_h WHERE w.origin_ts >= {_CUT}""",
)
def _(spark, d):
    cal, test = _parts(spark, d)
    table = C.deltas(cal, [KEY, "horizon_h"], method="higher")
    return C.apply_deltas(test, table, [KEY, "horizon_h"]).select(KEY, "origin_ts", "horizon_h", "q10", "q50", "q90")


@query(
    "k3_adaptive_intervals",
    with_ctes(fc.FC, sql_deltas("dl", "series_key, horizon_h", True)).replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT w.*, coalesce(delta, 0) AS base, row_number() OVER (PARTITION BY w.series_key, w.horizon_h ORDER BY origin_ts) AS i FROM weekly w
      LEFT JOIN dl ON w.series_key = dl.series_key AND w.horizon_h = dl.horizon_h WHERE origin_ts >= {_CUT}),
    f AS (SELECT DISTINCT series_key, horizon_h, 0::BIGINT AS i, 0.2::DOUBLE AS a, 0.0::DOUBLE AS d FROM o UNION ALL SELECT o.series_key, o.horizon_h, o.i, f.a + 0.01::DOUBLE * (0.2::DOUBLE - CASE WHEN o.y BETWEEN o.q10 - x AND o.q90 + x THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), x
      FROM f JOIN o ON o.series_key = f.series_key AND o.horizon_h = f.horizon_h AND o.i = f.i + 1, LATERAL (SELECT o.base * (1.0::DOUBLE + (0.2::DOUBLE - f.a) / 0.2::DOUBLE) AS x))
    SELECT o.series_key, o.horizon_h, o.origin_ts, {r('q10 - d')} AS q10, {r('q50')} AS q50, {r('q90 + d')} AS q90 FROM o JOIN f ON o.series_key = f.series_key AND o.horizon_h = f.horizon_h AND o.i = f.i""",
)
def _(spark, d):
    cal, test = _parts(spark, d)
    table = C.deltas(cal, [KEY, "horizon_h"], method="higher")
    out = C.adaptive(test, table, slice_days=3)
    return out.select(KEY, "horizon_h", "origin_ts", "q10", "q50", "q90")


_STAGES = f""", te AS (SELECT w.*, coalesce(delta, 0) AS dd FROM weekly w LEFT JOIN dl ON w.series_key = dl.series_key AND w.horizon_h = dl.horizon_h WHERE w.origin_ts >= {_CUT}),
st AS (SELECT 'raw' AS stage, series_key, horizon_h, q10, q50, q90, y FROM te UNION ALL SELECT 'calibrated', series_key, horizon_h, q10 - dd, q50, q90 + dd, y FROM te)"""


@query(
    "k5_before_after_by_horizon_group",
    with_ctes(fc.FC, sql_deltas("dl", "series_key, horizon_h", True)) + _STAGES[2:].replace("te AS", ", te AS", 1)
    + f" SELECT series_key, stage, 'overall' AS segment, {STANDARD} FROM st GROUP BY 1, 2 UNION ALL SELECT series_key, stage, {fc.SEG} AS segment, {STANDARD} FROM st GROUP BY 1, 2, 3",
)
def _(spark, d):
    cal, test = _parts(spark, d)
    table = C.deltas(cal, [KEY, "horizon_h"], method="higher")
    return C.before_after(test, C.apply_deltas(test, table, [KEY, "horizon_h"]), [KEY], M.standard())
