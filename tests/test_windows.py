import bisect
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import dedupe, fills, grid, joins
from panelcast.operators.buckets import counted_buckets, over_buckets, row_position, running, slot
from panelcast.operators.expanding import WaveletTree, expanding_quantile
from panelcast.operators.rolling import lag_exprs, rolling_exprs, shaped_profit
from panelcast.schemas import KEY, TS


def walk(n, seed=1, holes=0.2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(50, 20, n), 2)
    return [None if rng.random() < holes else v for v in x]


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(KEY, TS).collect()]


@pytest.mark.parametrize("size", [7, 50])
def test_buckets_equal_plain_windows(spark, hourly, size):
    df = hourly({"a": walk(120), "b": walk(90, 2)})
    ex = {**lag_exprs("price", (1, 24), "p"), **rolling_exprs("price", (24,), "p")}
    w = Window.partitionBy(KEY).orderBy(TS)
    plain = df.select("*", *[f(w).alias(n) for n, f in ex.items()])
    got = over_buckets(df, ex, back=24, size=size)
    assert got.count() == df.count()
    for g, p in zip(values(got, *ex), values(plain, *ex)):
        assert g == pytest.approx(p, nan_ok=True)


@pytest.mark.parametrize("size", [5, 1000])
def test_running_equals_plain_windows(spark, hourly, size):
    df = hourly({"a": walk(60), "b": walk(41, 2)})
    specs = {"s": ("sum", F.col("price")), "m": ("max", F.col("price")), "l": ("last", F.col("price")), "n": ("next", F.col("price"))}
    w = Window.partitionBy(KEY).orderBy(TS)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    plain = df.select(
        "*", F.coalesce(F.sum("price").over(up), F.lit(0.0)).alias("s"), F.max("price").over(up).alias("m"),
        F.last("price", True).over(up).alias("l"), F.first("price", True).over(down).alias("n"),
    )
    for g, p in zip(values(running(df, specs, size=size), *specs), values(plain, *specs)):
        assert g == pytest.approx(p)


def test_row_position(hourly):
    df = hourly({"a": range(23), "b": range(9)})
    got = row_position(df, "i", pos=slot(), size=4)
    assert all(r["i"] == r["price"] for r in got.collect())


@pytest.mark.parametrize("current", [True, False])
def test_expanding_quantile(hourly, current):
    data = {"a": walk(80, 3), "b": walk(30, 4)}
    got = expanding_quantile(hourly(data), "price", 0.9, "q", pos=slot(), least=5, include_current=current, size=9, block=8)
    for k, v in data.items():
        mine = [r["q"] for r in got.where(F.col(KEY) == k).orderBy(TS).collect()]
        for i, m in enumerate(mine):
            past = [x for x in v[: i + (1 if current else 0)] if x is not None]
            if len(past) < 5:
                assert m is None
            else:
                assert m == pytest.approx(np.quantile(past, 0.9))


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    symbols, before = rng.integers(0, 13, 200), rng.integers(0, 5, 13)
    tree = WaveletTree(symbols, 4)
    for upto in (0, 1, 57, 200):
        line = np.sort(np.concatenate([np.repeat(np.arange(13), before), symbols[:upto]]))
        rank = np.arange(len(line))
        found, k = tree.smallest(np.full(len(line), upto), rank, before)
        assert (found == line).all() and (k == rank - np.searchsorted(line, line)).all()


@pytest.mark.parametrize("current", [True, False])
def test_expanding_quantile_of_a_long_series_in_small_tasks(spark, current, monkeypatch):
    from panelcast.operators import expanding

    n = 60_000
    rng = np.random.default_rng(2)
    v = np.round(np.cumsum(rng.normal(size=n)), 1)  # drifts: ties, and a quantile that moves through the blocks
    df = spark.createDataFrame([("a", i, None if i % 17 == 0 else float(x)) for i, x in enumerate(v)], f"{KEY} string, t long, x double")
    make = expanding._solver

    def watched(include_current, names):
        solve = make(include_current, names)

        def run(values, wanted):
            if max(len(values), len(wanted)) > 8192:
                raise AssertionError("a task holds too much")
            return solve(values, wanted)

        return run

    monkeypatch.setattr(expanding, "_solver", watched)
    got = expanding_quantile(df, "x", 0.9, "q", pos=F.col("t"), include_current=current, size=4096, block=2048)
    mine = {r["t"]: r["q"] for r in got.collect()}
    line = []
    for i, x in enumerate(v):
        if current and i % 17:
            bisect.insort(line, x)
        if i % 501 == 0 or i == n - 1:
            assert mine[i] == (pytest.approx(np.quantile(line, 0.9)) if line else None)
        if not current and i % 17:
            bisect.insort(line, x)


def test_counted_buckets_spread_ticks_of_one_hour(spark):
    n = 50_000
    ticks = spark.range(n).select(F.lit("a").alias(KEY), F.timestamp_micros(F.col("id") * 70_000).alias(TS), (F.col("id") % 5).alias("m"))
    left, right = ticks.where("m <> 0").select(KEY, TS), ticks.where("m = 0").select(KEY, TS, F.col(TS).alias("seen"))
    got = joins.asof_backward(left, right, ["seen"], rows=500)
    wrong = got.where(F.unix_micros("seen") != F.floor(F.unix_micros(TS) / 350_000) * 350_000)
    assert got.count() == left.count() and wrong.count() == 0 and got.where("seen IS NULL").count() == 0
    base = ticks.withColumn("_run_pos", F.unix_micros(TS))
    per = counted_buckets(base, [KEY], 500).groupBy("_run_b").agg(F.count(F.lit(1)).alias("n"), F.min("_run_pos").alias("a"), F.max("_run_pos").alias("z")).orderBy("_run_b").collect()
    assert len(per) >= 100 and max(r["n"] for r in per) <= 500 and all(x["z"] < y["a"] for x, y in zip(per, per[1:]))
    gaps = dedupe.stamp_gaps(ticks.unionByName(ticks), rows=700)
    assert gaps.count() == n and gaps.where("gap_seconds IS NULL").count() == 1


def test_fills_and_interpolation(hourly):
    df = hourly({"a": [None, 1, None, None, 4, None]})
    assert [x[0] for x in values(fills.ffill(df, ["price"]), "price")] == [None, 1, 1, 1, 4, 4]
    assert [x[0] for x in values(fills.bfill(df, ["price"]), "price")] == [1, 1, 4, 4, 4, None]
    assert [x[0] for x in values(fills.ffill_bfill(df, ["price"]), "price")] == [1, 1, 1, 1, 4, 4]
    assert [x[0] for x in values(fills.interpolate(df, "price"), "price")] == [1, 1, 2, 3, 4, 4]


def test_missing_runs(hourly):
    df = hourly({"a": [None, None, 1, None, 2, None, None, None]})
    got = dedupe.missing_runs(df, "price").orderBy("run_start").collect()
    assert [r["run_length"] for r in got] == [2, 1, 3]


def test_past_features_ignore_the_future(hourly):
    base = walk(60, 5, 0)
    changed = base[:40] + [v + 999 for v in base[40:]]
    ex = {**lag_exprs("price", (1, 24), "p"), **rolling_exprs("price", (24,), "p")}
    a = values(over_buckets(hourly({"a": base}), ex, back=24, size=10), *ex)
    b = values(over_buckets(hourly({"a": changed}), ex, back=24, size=10), *ex)
    assert a[:41] == b[:41] and a[42:] != b[42:]


def test_result_does_not_depend_on_partitions(hourly):
    df = hourly({"a": walk(100), "b": walk(50)})
    ex = rolling_exprs("price", (24,), "p")
    want = values(over_buckets(df, ex, back=24), *ex)
    for n in (1, 4, 16):
        got = values(over_buckets(df.repartition(n).orderBy(F.rand(1)), ex, back=24, size=30), *ex)
        assert len(got) == len(want)
        for g, p in zip(got, want):
            assert g == pytest.approx(p, nan_ok=True)


def test_fixed_windows_and_overlap(hourly):
    w = grid.window_rows(hourly({"a": range(25)}), 10, 5)
    starts = sorted(r["price"] for r in w.where("offset = 0").collect())
    assert starts == [0, 5, 10, 15]
    six = hourly({"a": range(6)})
    two = grid.window_rows(six, 4, 2).withColumn("price", F.when(F.col("window_id") == 0, 10.0).otherwise(20.0))
    assert [x[0] for x in values(grid.overlap_average(six, two, "price"), "price")] == [10, 10, 15, 15, 20, 20]


def test_origin_windows(hourly):
    got = grid.origin_windows(hourly({"a": range(40)}), ["price"], ["price"], lookback=10, horizon=5).collect()
    assert len(got) == 40 - 10 - 5 + 1
    for r in got:
        p, f = [x["price"] for x in r["past"]], [x["price"] for x in r["future"]]
        assert p == list(np.arange(10) + p[0]) and f == list(np.arange(5) + p[-1] + 1)


def test_rolling_tail_risk(hourly):
    x = walk(30, 7, 0)
    got = values(shaped_profit(hourly({"a": x}, "profit"), "profit", window=8), "rolling_cvar", "shaped_profit")
    for i, (c, s) in enumerate(got):
        h = np.array(x[max(0, i - 7): i + 1])
        if len(h) < 4:
            assert c is None and s == x[i]
        else:
            tail = h[h <= np.quantile(h, 0.05)].mean()
            assert c == pytest.approx(tail) and s == pytest.approx(x[i] - 0.1 * max(0, -tail))


def test_keep_one_and_spine(spark, hourly):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, seq int, v string")
    assert {r["v"] for r in dedupe.keep_one(df, ["k"], "seq", last=True).collect()} == {"y", "z"}
    assert {r["v"] for r in dedupe.keep_one(df, ["k"], "seq", last=False).collect()} == {"x", "z"}
    full = hourly({"a": range(10)})
    back = grid.reindex(full.where("price NOT IN (3, 4)"))
    assert back.count() == 10 and back.where("price IS NULL").count() == 2
