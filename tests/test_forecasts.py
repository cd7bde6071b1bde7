import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import baselines as B
from panelcast.operators import conformal as C
from panelcast.operators import dispatch as D
from panelcast.operators import grid, joins
from panelcast.operators import metrics as M
from panelcast.operators.supervised import expanding_window_folds, rolling_origin_folds, supervised
from panelcast.schemas import KEY, TS

UTC = dt.timezone.utc
T0 = dt.datetime(2023, 1, 1, tzinfo=UTC)


def one(spark, rows, schema, **metrics):
    return spark.createDataFrame(rows, schema).agg(*[c.alias(n) for n, c in metrics.items()]).first()


def test_point_metrics(spark):
    s = "y double, q50 double"
    assert one(spark, [(1.0, 1.0), (2.0, 4.0), (3.0, 0.0)], s, m=M.mae())["m"] == pytest.approx(5 / 3)
    assert one(spark, [(0.0, 3.0), (0.0, 4.0), (0.0, 0.0)], s, m=M.rmse())["m"] == pytest.approx((25 / 3) ** 0.5)
    assert one(spark, [(10.0, 12.0), (20.0, 18.0), (30.0, 33.0)], s, m=M.nmae())["m"] == pytest.approx((7 / 3) / 20)
    assert one(spark, [(10.0, 8.0)], s, m=M.pinball(0.9, "q50"))["m"] == pytest.approx(1.8)
    assert one(spark, [(10.0, 13.0)], s, m=M.pinball(0.9, "q50"))["m"] == pytest.approx(0.3)
    r = one(spark, [(1.0, 1.5), (7.0, 2.0)], s, a=M.pinball(0.5, "q50"), b=M.mae())
    assert r["a"] == pytest.approx(r["b"] / 2)


def test_interval_metrics(spark):
    s = "y double, q10 double, q90 double"
    assert one(spark, [(v, 0.0, 10.0) for v in (1.0, 5.0, 9.0, 11.0)], s, m=M.coverage())["m"] == 0.75
    assert one(spark, [(0.0, 1.0, 4.0), (0.0, 2.0, 10.0)], s, m=M.width())["m"] == 5.5
    assert one(spark, [(20.0, 0.0, 10.0)], s, m=M.winkler())["m"] == pytest.approx(110)
    assert one(spark, [(3.0, 0.0, 2.0)], s, m=M.winkler())["m"] == pytest.approx(12)
    r = one(spark, [(float(v), 3.0, 9.0) for v in range(1, 11)], s, lo=M.below("q10"), hi=M.below("q90"))
    assert (r["lo"], r["hi"]) == (0.2, 0.8)


def test_spike_mae_and_empty_segment(spark):
    rows = [("m", float(v), 0.0 if v >= 90 else float(v)) for v in range(100)]
    df = spark.createDataFrame(rows, "model string, y double, q50 double")
    assert M.spike_mae(df, ["model"]).first()["spike_mae"] == pytest.approx(94.5)
    seg = M.segment_metrics(df, {"all": F.lit(True), "none": F.col("y") < 0}, {"mae": M.mae()}, ["model"])
    assert {r["segment"]: r["mae"] for r in seg.collect()} == {"all": pytest.approx(9.45), "none": None}


def scores(spark, n, alpha, method):
    y = np.random.default_rng(0).normal(0, 1, n)
    df = spark.createDataFrame([("s", float(v), -1.0, 0.0, 1.0) for v in y], "series_key string, y double, q10 double, q50 double, q90 double")
    s = np.maximum(-1 - y, y - 1)
    level = min(1.0, np.ceil((n + 1) * (1 - alpha)) / n)
    return df, C.deltas(df, [KEY], alpha, method), np.quantile(s, level, method=method)


@pytest.mark.parametrize("n", [3, 99, 100])
@pytest.mark.parametrize("method", ["linear", "higher"])
def test_conformal_delta(spark, n, method):
    _, table, want = scores(spark, n, 0.2, method)
    assert table.first()["delta"] == pytest.approx(want)


def test_conformal_coverage_and_untouched_median(spark):
    _, table, want = scores(spark, 500, 0.2, "linear")
    y = np.random.default_rng(9).normal(0, 1, 2000)
    test = spark.createDataFrame([("s" if i % 2 else "new", float(v), -1.0, 0.0, 1.0) for i, v in enumerate(y)], "series_key string, y double, q10 double, q50 double, q90 double")
    out = C.apply_deltas(test, table, [KEY])
    cov = out.where("series_key = 's'").agg(M.coverage().alias("c")).first()["c"]
    assert cov >= 0.77
    assert out.where("q50 <> 0").count() == 0
    assert out.where("series_key = 'new' AND (q10 <> -1 OR q90 <> 1)").count() == 0


def test_adaptive_slices_do_not_matter(spark):
    rng = np.random.default_rng(3)
    rows = [("s", h, T0 + dt.timedelta(hours=i), -1.0, 0.0, 1.0, float(rng.normal(0, 2))) for h in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "series_key string, horizon_h int, origin_ts timestamp, q10 double, q50 double, q90 double, y double")
    table = spark.createDataFrame([("s", 1, 0.5)], "series_key string, horizon_h int, delta double")
    keys = [KEY, "horizon_h"]
    a = C.adaptive(df, table, slice_days=2).orderBy(*keys, "origin_ts").collect()
    b = C.adaptive(df, table, slice_days=400).orderBy(*keys, "origin_ts").collect()
    level, ys = 0.2, [r[6] for r in rows if r[1] == 1]
    for x, y, v in zip(a, b, ys):
        d = 0.5 * (1 + (0.2 - level) / 0.2)
        assert (x["q10"], x["q90"]) == pytest.approx((-1 - d, 1 + d)) and (x["q10"], x["q90"]) == pytest.approx((y["q10"], y["q90"]))
        level += 0.01 * (0.2 - (0.0 if -1 - d <= v <= 1 + d else 1.0))
    assert all(r["q10"] == -1 for r in a if r["horizon_h"] == 2)


def test_truth_and_lag_baselines(spark, hourly):
    f = spark.createDataFrame([("a", T0, 1), ("a", T0, 2)], "series_key string, origin_ts timestamp, horizon_h int")
    got = joins.truth_for(f, hourly({"a": range(30)}), "price")
    assert {r["horizon_h"]: r["y"] for r in got.collect()} == {1: 1.0, 2: 2.0}
    df = hourly({"a": range(400)})
    x = supervised(df, ["price"], [], "price")
    b = B.lag_baselines(x.where("(horizon_h = 5 AND price = 40) OR (horizon_h = 3 AND price = 200)"), df, "price", {"l24": 24, "l168": 168})
    assert {r["price"]: (r["l24"], r["l168"]) for r in b.collect()} == {40.0: (21.0, None), 200.0: (179.0, 35.0)}


def test_supervised_layout(hourly):
    got = supervised(hourly({"a": range(50), "b": range(30)}), ["price"], [], "price", end="2023-01-02 12:00:00")
    assert got.where("y <> price + horizon_h").count() == 0
    assert got.where("target_ts > '2023-01-02 12:00:00'").count() == 0
    assert got.where("series_key = 'a'").count() == sum(min(24, 36 - i) for i in range(36))


def test_weekly_naive_matches_brute_force(hourly):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(50, 10, 480), 2)
    got = B.weekly_naive(hourly({"a": x}), "price", train_end="2023-01-18", lag=168, horizon=24)
    resid = x[168:17 * 24] - x[:17 * 24 - 168]
    lo, med, hi = np.quantile(resid, [0.1, 0.5, 0.9])
    rows = got.collect()
    assert len(rows) == (480 - 24 - 167) * 24
    for r in rows[:: 97]:
        p = int((r["origin_ts"].replace(tzinfo=UTC) - T0).total_seconds() // 3600)
        assert r["q50"] == pytest.approx(x[p + r["horizon_h"] - 168] + med)
        assert (r["q10"], r["q90"]) == pytest.approx((x[p + r["horizon_h"] - 168] + lo, x[p + r["horizon_h"] - 168] + hi))


def test_residual_forecaster_round_trip(spark, hourly, tmp_path):
    x = supervised(hourly({"a": np.random.default_rng(1).normal(0, 1, 100)}), ["price"], [], "price", horizons=(1, 2))
    model = B.ResidualForecaster("naive", "price").fit(x)
    model.save(str(tmp_path / "m"))
    again = B.ResidualForecaster("naive", "price").load(spark, str(tmp_path / "m"))
    new = x.withColumn("horizon_h", F.lit(7))  # unseen horizon: pooled quantiles
    a, b = model.predict_quantiles(new).first(), again.predict_quantiles(new).first()
    assert a["q10"] < a["q50"] < a["q90"] and a["q50"] == b["q50"]
    with pytest.raises(KeyError):
        B.ResidualForecaster("naive", "nope").fit(x)


def test_ensemble_and_wide_round_trip(spark):
    rows = [("a", T0, h, float(h), float(h + 1), float(h + 2)) for h in range(1, 25)]
    f = spark.createDataFrame(rows, "series_key string, origin_ts timestamp, horizon_h int, q10 double, q50 double, q90 double")
    e = B.ensemble([f, f.withColumn("q50", F.col("q50") + 2)])
    assert e.where("q50 <> horizon_h + 2 OR q10 > q50").count() == 0
    back = grid.forecast_long(grid.forecast_wide(f))
    assert back.exceptAll(f.select(back.columns)).count() == 0 and back.count() == 24


def test_folds(hourly):
    days = hourly({"a": [0] * 2000}, step=86400)
    roll, grow = rolling_origin_folds(days).collect(), expanding_window_folds(days).collect()
    assert len(roll) == len(grow) == 5
    for f in roll + grow:
        assert f["val_start"] - f["train_end"] == dt.timedelta(hours=24) and f["val_end"] - f["val_start"] == dt.timedelta(days=90)
    assert len({f["train_end"] - f["train_start"] for f in roll}) == 1
    assert [f["train_start"] for f in grow] == [grow[0]["train_start"]] * 5
    with pytest.raises(Exception, match="span too short"):
        rolling_origin_folds(hourly({"a": [0] * 10})).collect()


def by_hand(prices, mw, start=50.0):
    soc, out, root = start, [], 0.9**0.5
    for p, want in zip(prices, mw):
        delta = -want / root if want >= 0 else -want * root
        new = min(max(soc + delta, 0.0), 100.0)
        power = -(new - soc) * root if want >= 0 else -(new - soc) / root
        soc = new
        out.append((soc, power, p * power))
    return out


def test_dispatch_steps(hourly):
    rng = np.random.default_rng(2)
    prices, mw = rng.normal(20, 40, 24), rng.uniform(-50, 50, 24)
    e = D.episodes(hourly({"a": prices}).join(hourly({"a": mw}, "mw"), [KEY, TS]))
    got = D.simulate(e, F.col("mw")).orderBy("step").collect()
    assert [(r["soc"], r["power"], r["profit"]) for r in got] == [pytest.approx(x) for x in by_hand(prices, mw)]
    assert all(0 <= r["soc"] <= 100 for r in got)


def test_greedy_beats_idle_and_incomplete_days_are_left_out(hourly):
    df = hourly({"a": list(range(24)) * 2 + [1, 2, 3]})
    e = D.episodes(df)
    assert e.count() == 48
    g = D.simulate(D.rank_actions(e, "price"), F.col("action") * D.POWER)
    acted = {r["step"]: r["power"] for r in g.where("power <> 0").collect()}
    assert set(acted) == {0, 1, 22, 23} and acted[0] < 0 < acted[23]
    assert D.episode_profits(g).where("profit <= 0").count() == 0
    idle = D.simulate(D.hourly_actions(e, (), ()), F.col("action") * D.POWER)
    assert idle.where("profit <> 0 OR soc <> 50").count() == 0


def test_forecast_driven_policy_settles_at_actual_prices(hourly):
    q, y = list(range(24)), list(range(24))[::-1]
    df = hourly({"a": q}, "q50").join(hourly({"a": y}), [KEY, TS])
    acted = D.rank_actions(D.episodes(df), "q50", spread=F.col("step") != 23)
    got = {r["step"]: r for r in D.simulate(acted, F.col("action") * D.POWER).collect()}
    assert {k for k, r in got.items() if r["power"] != 0} == {0, 1, 22}
    assert got[0]["profit"] == pytest.approx(23 * got[0]["power"]) and got[22]["profit"] == pytest.approx(1 * got[22]["power"])
