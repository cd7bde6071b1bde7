import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.schemas import KEY, TS
from panelcast.session import scratch_path
from panelcast.streaming import operators as S
from panelcast.streaming.feeds import in_slices, run_available, stream_folder

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def day(n, hours=0):
    return START + dt.timedelta(days=n, hours=hours)


def batches(spark, schema, *parts):
    """A stream with one micro-batch for each list of rows."""
    path = scratch_path(spark, "batches")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return stream_folder(spark, path, files_per_batch=1)


def test_state_of_a_silent_key_goes(spark):
    schema = f"{KEY} string, horizon_h int, origin_ts timestamp, q10 double, q90 double, y double"
    miss = lambda k, n: (k, 1, day(n), 0.0, 1.0, 5.0)
    parts = [[miss("a", 0), miss("a", 1)], [miss("b", 2)], [miss("b", 40)], [miss("b", 41)], [miss("a", 42)]]
    for keep, last in ((dt.timedelta(days=10), 0.4), (dt.timedelta(days=300), 1.2)):
        got = run_available(S.online_conformal(batches(spark, schema, *parts), gamma=0.5, keep=keep), "silent")
        deltas = {(r[KEY], r["origin_ts"].day, r["origin_ts"].month): r["delta"] for r in got.collect()}
        assert deltas[("a", 2, 1)] == pytest.approx(0.8) and deltas[("a", 12, 2)] == pytest.approx(last)


def test_ring_goes_on_over_batches(spark):
    x = [float((7 * i) % 23 - 11) for i in range(60)]
    df = spark.createDataFrame([("a", day(0, i), v) for i, v in enumerate(x)], f"{KEY} string, {TS} timestamp, profit double")
    got = run_available(S.risk_monitor(in_slices(df, TS, "ring", 4), window=10, alpha=0.3), "risk").orderBy(TS).collect()
    for i, r in enumerate(got):
        frame = pd.Series(x[max(0, i - 9) : i + 1])
        if len(frame) < 4:
            assert r["rolling_cvar"] is None and r["shaped_profit"] == x[i]
        else:
            assert r["rolling_cvar"] == pytest.approx(frame[frame <= frame.quantile(0.3)].mean())


def test_last_per_key_over_batches(spark):
    schema = f"{KEY} string, {TS} timestamp, seq long, v int"
    parts = [[("a", day(0), 1, 1), ("a", day(0), 3, 3), ("b", day(0), 5, 5)], [("a", day(0), 2, 2), ("b", day(0), 6, None), ("b", day(0), 2, 4)], [("c", day(9), 1, 0)], [("a", day(0), 9, 9)]]
    got = run_available(S.last_per_key(batches(spark, schema, *parts), "seq"), "last").select(KEY, "seq", "v").collect()
    assert sorted(tuple(r) for r in got) == [("a", 3, 3), ("b", 6, None)]
    assert run_available(S.last_per_key(in_slices(spark.createDataFrame([], schema), TS, "none"), "seq"), "none").count() == 0
