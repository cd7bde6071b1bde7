import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions import timefeatures as tf
from panelcast.functions.bundles import Bundle, build_features, resolve_order
from panelcast.functions.fundamentals import clip, net_imports, residual_load
from panelcast.functions.predicates import split_label
from panelcast.operators import constraints as K
from panelcast.schemas import CITIES, KEY, TS, WEATHER_VARIABLES
from panelcast.sources import feeds
from panelcast.streaming import operators as S
from panelcast.streaming.feeds import run_available, stream_folder

UTC = dt.timezone.utc


def stamps(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp").alias(TS), "t")


def test_easter_and_holidays(spark):
    y = spark.createDataFrame([(1995,), (2000,), (2019,), (2024,), (2025,), (2038,)], "y int")
    got = [str(r[0]) for r in y.select(tf.easter_sunday(F.col("y"))).collect()]
    assert got == ["1995-04-16", "2000-04-23", "2019-04-21", "2024-03-31", "2025-04-20", "2038-04-25"]
    flags = {r["t"]: r["h"] for r in stamps(spark, "2024-03-29", "2024-04-01", "2024-05-09", "2024-05-20", "2024-10-03", "2024-10-31", "2017-10-31", "2024-12-24").select("t", tf.is_holiday().alias("h")).collect()}
    assert flags == {"2024-03-29": 1, "2024-04-01": 1, "2024-05-09": 1, "2024-05-20": 1, "2024-10-03": 1, "2024-10-31": 0, "2017-10-31": 1, "2024-12-24": 0}


def test_solar_night(spark):
    df = stamps(spark, "2024-06-01 00:00:00", "2024-06-01 12:00:00", "2024-06-01 23:00:00").withColumn("gen_solar", F.lit(100.0))
    assert [r["gen_solar"] for r in K.solar_night(df).orderBy(TS).collect()] == [0.0, 100.0, 0.0]


def test_flows_and_imports(spark):
    df = spark.createDataFrame([(500.0, 200.0), (0.0, 100.0), (1000.0, 1500.0), (5.0, 5.0), (None, 3.0)], "FR_to_DELU double, DELU_to_FR double")
    got = [tuple(r) for r in K.coherent_flows(df).coalesce(1).collect()]
    assert got == [(500.0, 0.0), (0.0, 100.0), (0.0, 1500.0), (5.0, 0.0), (None, 3.0)]
    n = spark.createDataFrame([(100.0, 30.0), (200.0, 80.0), (50.0, 70.0)], "FR_to_DELU double, DELU_to_FR double")
    assert [r[0] for r in n.coalesce(1).select(*[c for c in net_imports(n).values()]).collect()] == [70.0, 120.0, -20.0]


def test_null_guards(spark):
    df = spark.createDataFrame([(None, 0.0), (5.0, 10.0)], "gen_solar double, load double")
    assert [r[0] for r in df.coalesce(1).select(clip(F.col("gen_solar"), 0.0, 1.0)).collect()] == [None, 1.0]
    r = df.coalesce(1).select(*[c.alias(n) for n, c in residual_load(df).items()]).collect()
    assert (r[0]["residual_load"], r[0]["renewable_penetration"], r[1]["residual_load"]) == (None, 0.0, 5.0)


def test_zero_after_cutoff(spark):
    df = stamps(spark, "2023-04-15", "2023-04-16", "2023-04-17").withColumn("gen_nuclear", F.lit(None).cast("double"))
    assert [r["gen_nuclear"] for r in K.zero_after(df, "gen_nuclear", "2023-04-15").orderBy(TS).collect()] == [None, 0.0, 0.0]


def test_constraints_need_raw(spark):
    with pytest.raises(ValueError):
        K.apply_constraints(stamps(spark, "2023-01-01"))


def test_violations(spark):
    rows = [("a", dt.datetime(2024, 6, 1, 12), g, a, b) for g, a, b in [(-100.0, 5.0, 5.0), (0.0, 0.0, 5.0), (50.0, 5.0, 0.0), (-1.0, 0.5, 5.0), (200.0, 9.0, 9.0)]]
    df = spark.createDataFrame(rows, "series_key string, ts timestamp, gen_wind_onshore double, FR_to_DELU double, DELU_to_FR double")
    got = {r["rule"]: r["n"] for r in K.violation_counts(df).collect()}
    assert got == {"negative_generation:gen_wind_onshore": 2, "both_directions_positive:FR_to_DELU": 2}


def test_split_has_2160_test_hours(hourly):
    df = hourly({"a": [0] * (24 * 456)}, start=dt.datetime(2024, 1, 1))
    s = df.withColumn("split", split_label({"train": (None, "2024-01-01"), "val": ("2024-01-01", "2025-01-01"), "test": ("2025-01-01", "2025-04-01")}))
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect() if r["split"]} == {"val": 8784, "test": 2160}


def test_bundles(hourly):
    assert resolve_order(["spike", "calendar", "fundamentals"]) == ["fundamentals", "spike", "calendar"]
    with pytest.raises(KeyError):
        resolve_order(["nope"])
    with pytest.raises(ValueError):
        resolve_order(["a"], {"a": Bundle(lambda d: d, ("b",)), "b": Bundle(lambda d: d, ("a",))})
    df = hourly({"a": range(30)}).withColumn("load", F.col("price"))
    assert {"price_lag24h", "load_lag24h", "hour_sin", "residual_load", "is_renewable_scarcity"} <= set(build_features(df, ["price_lags", "calendar", "spike"]).columns)


def test_bundles_on_a_daily_panel_and_canonical_weather(hourly):
    days = hourly({"a": range(9000)}, step=86400).withColumn("load", F.col("price"))
    got = build_features(days, ["price_lags"], step=86400).orderBy(TS).collect()
    assert [r["price_lag168h"] for r in got] == [None] * 168 + [float(i) for i in range(9000 - 168)]
    wide = days.limit(400).withColumns({f"{c}_{v}": F.col("price") + i for i, c in enumerate(CITIES) for v in WEATHER_VARIABLES})
    out = build_features(wide, ["load_weather"], step=86400)
    assert {"weather_mean_temperature_2m", "weather_max_wind_speed_100m", "heating_degree", "weather_mean_shortwave_radiation_lag24h", "munich_wind_speed_10m_lag168h"} <= set(out.columns)
    with pytest.raises(KeyError):
        build_features(days, ["weather"])


def document(series, ns="urn:iec62325.351:tc57wg16:451-3:publicationdocument:7:3"):
    return f'<Publication_MarketDocument xmlns="{ns}">{series}</Publication_MarketDocument>'


def series(points, tag="price.amount", res="PT60M", start="2024-01-01T00:00Z", psr=None):
    p = "".join(f"<Point><position>{i}</position>" + (f"<{tag}>{v}</{tag}>" if v is not None else "") + "</Point>" for i, v in points)
    k = f"<MktPSRType><psrType>{psr}</psrType></MktPSRType>" if psr else ""
    return f"<TimeSeries>{k}<Period><timeInterval><start>{start}</start><end>x</end></timeInterval><resolution>{res}</resolution>{p}</Period></TimeSeries>"


def parsed(spark, *docs):
    df = spark.createDataFrame([(d,) for d in docs], "xml string")
    return [(r["ts"].strftime("%H:%M"), r["psr_type"], r["value"]) for r in feeds.parse_documents(df).orderBy(TS, "psr_type").collect()]


def test_documents(spark, tmp_path):
    hourly = document(series([(1, 50.10), (2, 48.25), (3, 61.0)]))
    assert parsed(spark, hourly) == [("00:00", None, 50.1), ("01:00", None, 48.25), ("02:00", None, 61.0)]
    assert parsed(spark, document(series([(1, 1), (2, 2), (3, 3), (4, 4)], res="PT15M"))) == [("00:00", None, 1.0), ("00:15", None, 2.0), ("00:30", None, 3.0), ("00:45", None, 4.0)]
    assert parsed(spark, document(series([(1, 7)], "quantity", start="2024-01-01T01:00+01:00"))) == [("00:00", None, 7.0)]
    assert parsed(spark, document(series([(1, 1)], "quantity", psr="B16") + series([(1, 2)], "quantity", psr="B19"))) == [("00:00", "B16", 1.0), ("00:00", "B19", 2.0)]
    assert parsed(spark, document(series([(1, 5), (1, 6), (2, None)]))) == [("00:00", None, 5.0)]
    assert parsed(spark, document("")) == []
    (tmp_path / "a.xml").write_text(hourly)
    assert feeds.read_documents(spark, str(tmp_path)).count() == 3


def test_json_quotes(spark):
    df = spark.createDataFrame([('{"unix_seconds": [1704067200, 1704070800, 1704153600], "price": [1.0, 2.0, 3.0]}',)], "json string")
    assert [r["price"] for r in feeds.daily_last_quotes(df).orderBy(TS).collect()] == [2.0, 3.0]


def test_online_state_across_batches(spark, tmp_path):
    """Two files in two micro-batches give the same as one pass; 20 misses raise the correction, 50 hits bring it back."""
    t0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [("a", 1, t0 + dt.timedelta(hours=i), 0.0, 1.0, 9.0 if i < 20 else 0.5) for i in range(320)]
    folder = str(tmp_path / "in")
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, "series_key string, horizon_h int, origin_ts timestamp, q10 double, q90 double, y double").coalesce(1).write.mode("append").parquet(folder)
    out = run_available(S.online_conformal(stream_folder(spark, folder, files_per_batch=1)), "t5").orderBy("origin_ts").collect()
    delta = 0.0
    assert len(out) == 320
    for r, (_, _, _, lo, hi, y) in zip(out, rows):
        err = 1.0 if y < lo - delta or y > hi + delta else 0.0
        delta = max(0.0, delta + 0.005 * (err - 0.2))
        assert r["delta"] == pytest.approx(delta, abs=1e-12)
    assert out[19]["delta"] > 0 and out[-1]["delta"] == 0


def test_risk_monitor_equals_batch(spark, hourly, tmp_path):
    from panelcast.operators.rolling import shaped_profit

    x = [float((i * 37) % 23 - 11) for i in range(60)]
    df = hourly({"a": x, "b": x[::-1]}, "profit")
    folder, cut = str(tmp_path / "in"), F.lit("2023-01-02").cast("timestamp")
    df.where(F.col(TS) < cut).coalesce(1).write.mode("append").parquet(folder)
    df.where(F.col(TS) >= cut).coalesce(1).write.mode("append").parquet(folder)
    got = run_available(S.risk_monitor(stream_folder(spark, folder, files_per_batch=1), window=12), "risk").orderBy(KEY, TS).collect()
    want = shaped_profit(df, "profit", window=12).orderBy(KEY, TS).collect()
    assert len(got) == 120
    for g, w in zip(got, want):
        assert g["shaped_profit"] == pytest.approx(w["shaped_profit"]) and g["rolling_cvar"] == pytest.approx(w["rolling_cvar"])
