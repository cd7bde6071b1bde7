"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelcast.schemas import KEY, TS
from panelcast.streaming.feeds import WATERMARK


def _flat(windowed: DataFrame) -> DataFrame:
    return windowed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in windowed.columns if c != "window"])


def tumbling(stream: DataFrame, aggs: dict[str, Column], *, keys=(KEY,), width: str = "1 hour") -> DataFrame:
    w = stream.withWatermark(TS, WATERMARK).groupBy(F.window(TS, width), *keys)
    return _flat(w.agg(*[c.alias(n) for n, c in aggs.items()]))


def sliding(stream: DataFrame, aggs: dict[str, Column], *, keys=(KEY,), width: str = "24 hours", every: str = "1 hour") -> DataFrame:
    w = stream.withWatermark(TS, WATERMARK).groupBy(F.window(TS, width, every), *keys)
    return _flat(w.agg(*[c.alias(n) for n, c in aggs.items()]))


def sessions(stream: DataFrame, *, keys=(KEY,), gap: str = "2 hours") -> DataFrame:
    """Bursts separated by more than ``gap``; a session ends ``gap`` after its last row."""
    w = stream.withWatermark(TS, WATERMARK).groupBy(F.session_window(TS, gap).alias("window"), *keys)
    return _flat(w.agg(F.count(F.lit(1)).alias("n")))


def first_per_key(stream: DataFrame, keys=(KEY, TS)) -> DataFrame:
    """Suppress repeats of a key inside the watermark delay (the first one seen stays)."""
    return stream.withWatermark(TS, WATERMARK).dropDuplicatesWithinWatermark(list(keys))


def enrich(stream: DataFrame, static: DataFrame, on) -> DataFrame:
    return stream.join(static, on, "left")


def score_on_arrival(forecasts: DataFrame, actuals: DataFrame, *, keys=(KEY,), reach: str = "25 hours") -> DataFrame:
    """Forecast and actual streams joined at the target stamp; state is bounded by the time range."""
    f = forecasts.withWatermark("target_ts", WATERMARK).alias("f")
    a = actuals.withWatermark(TS, WATERMARK).alias("a")
    cond = F.expr(f"f.target_ts = a.{TS} AND a.{TS} >= f.origin_ts AND a.{TS} <= f.origin_ts + INTERVAL {reach}")
    for k in keys:
        cond = cond & (F.col(f"f.{k}") == F.col(f"a.{k}"))
    return f.join(a, cond).select("f.*", F.col("a.y"))


def _micros(stamps: pd.Series) -> np.ndarray:
    return stamps.astype("datetime64[us]").astype("int64").to_numpy()


class _Expiring(StatefulProcessor):
    """Typed state per key that goes ``keep`` of event time after the key's newest row.

    One timer a key: each batch puts it off, so a silent key's state is dropped once the
    watermark passes its newest stamp by ``keep``. Rows not newer than the last are dropped.
    """

    def __init__(self, keys, ts: str, keep: dt.timedelta):
        self._keys, self._ts, self._keep = list(keys), ts, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "last bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def rows(self, pdf: pd.DataFrame) -> dict:
        """Output columns of the new rows in time order; reads and updates the state."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self._last.get()[0] if self._last.exists() else -(2**62)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self._ts, kind="stable")
        pdf = pdf[_micros(pdf[self._ts]) > last].reset_index(drop=True)
        if len(pdf):
            newest = int(_micros(pdf[self._ts])[-1])
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer((newest + self._keep // dt.timedelta(microseconds=1)) // 1000)
            self._last.update((newest,))
        columns = self.rows(pdf)
        yield pd.DataFrame({**{k: pd.Series([v] * len(pdf), dtype=object) for k, v in zip(self._keys, key)}, self._ts: pdf[self._ts], **columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._last.clear()
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, processor: _Expiring, keys, ts: str, fields: str) -> DataFrame:
    names = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    marked = stream.withWatermark(ts, WATERMARK)
    return marked.groupBy(*keys).transformWithStateInPandas(processor, f"{names}, {ts} timestamp, {fields}", "Append", "EventTime")


class _Conformal(_Expiring):
    def __init__(self, keys, ts, keep, alpha: float, gamma: float):
        super().__init__(keys, ts, keep)
        self._alpha, self._gamma = alpha, gamma

    def open(self, handle) -> None:
        self._delta = handle.getValueState("delta", "delta double")

    def forget(self) -> None:
        self._delta.clear()

    def rows(self, pdf: pd.DataFrame) -> dict:
        delta = self._delta.get()[0] if self._delta.exists() else 0.0
        lo, hi, y = (pdf[c].to_numpy(dtype=float) for c in ("q10", "q90", "y"))
        deltas, errs = np.empty(len(pdf)), np.empty(len(pdf))
        for i in range(len(pdf)):  # each correction needs the one before
            errs[i] = 1.0 if y[i] < lo[i] - delta or y[i] > hi[i] + delta else 0.0
            delta = max(0.0, delta + self._gamma * (errs[i] - self._alpha))
            deltas[i] = delta
        if len(pdf):
            self._delta.update((float(delta),))
        return {"q10": lo - deltas, "q90": hi + deltas, "delta": deltas, "err": errs}


def online_conformal(
    stream: DataFrame, *, keys=(KEY, "horizon_h"), ts: str = "origin_ts", alpha: float = 0.2, gamma: float = 0.005, keep: dt.timedelta = dt.timedelta(days=60)
) -> DataFrame:
    """Additive adaptive interval correction kept per key; emits the interval widened by the updated correction.

    Input columns: keys, ``ts``, q10, q90, y. Rows must arrive in order per key;
    older ones are dropped. A key that is silent for ``keep`` starts anew.
    """
    return _stateful(stream, _Conformal(keys, ts, keep, alpha, gamma), list(keys), ts, "q10 double, q90 double, delta double, err double")


class _Risk(_Expiring):
    def __init__(self, keys, ts, keep, value: str, window: int, alpha: float, least: int, risk: float):
        super().__init__(keys, ts, keep)
        self._value, self._window, self._alpha, self._least, self._risk = value, window, alpha, least, risk

    def open(self, handle) -> None:
        self._ring = handle.getListState("ring", "x double")

    def forget(self) -> None:
        self._ring.clear()

    def rows(self, pdf: pd.DataFrame) -> dict:
        old = np.array([x[0] for x in self._ring.get()] if self._ring.exists() else [], dtype=float)
        x = pdf[self._value].to_numpy(dtype=float)
        line = np.concatenate([old, x])
        cvar = np.full(len(x), np.nan)
        for i in range(len(x)):  # a view of the line, not a copy
            frame = line[max(0, len(old) + i + 1 - self._window) : len(old) + i + 1]
            if len(frame) >= self._least:
                cvar[i] = frame[frame <= np.quantile(frame, self._alpha)].mean()
        if len(x):
            self._ring.put([(float(v),) for v in line[-self._window :]])
        return {"rolling_cvar": cvar, "shaped_profit": np.where(np.isnan(cvar), x, x - self._risk * np.maximum(0.0, -np.nan_to_num(cvar)))}


def risk_monitor(
    stream: DataFrame, *, keys=(KEY,), ts: str = TS, value: str = "profit", window: int = 168, alpha: float = 0.05, least: int = 4, risk: float = 0.1,
    keep: dt.timedelta = dt.timedelta(days=60),
) -> DataFrame:
    """Rolling tail mean of the last ``window`` profits per key, and the profit less its penalty; a key silent for ``keep`` starts anew."""
    out = _stateful(stream, _Risk(keys, ts, keep, value, window, alpha, least, risk), list(keys), ts, "rolling_cvar double, shaped_profit double")
    return out.withColumn("rolling_cvar", F.nanvl("rolling_cvar", F.lit(None).cast("double")))


class _Newest(StatefulProcessor):
    """The newest row of a key, given out when the watermark passes the key's stamp."""

    def __init__(self, ts: str, sequence: str, fields: list[str], schema: str):
        self._ts, self._sequence, self._fields, self._schema = ts, sequence, fields, schema
        self._whole = {f.split()[0] for f in schema.split(", ") if f.split()[-1] in ("tinyint", "smallint", "int", "bigint")}

    def _value(self, field: str, v):
        """pandas gives null as NaN, and whole numbers of a column with nulls as floats."""
        if pd.isna(v):
            return None
        return int(v) if field in self._whole else v.item() if hasattr(v, "item") else v

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._row = handle.getValueState("row", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        stamp = int(_micros(pdf[self._ts])[0]) // 1000
        if stamp < timerValues.getCurrentWatermarkInMs():
            return iter(())  # the key has been given out, or is about to be
        best = pdf.loc[pdf[self._sequence].idxmax()]
        if not self._row.exists():
            self._handle.registerTimer(stamp + 1)
        elif self._row.get()[self._fields.index(self._sequence)] >= best[self._sequence]:
            return iter(())
        self._row.update(tuple(self._value(f, best[f]) for f in self._fields))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._row.exists():
            yield pd.DataFrame([self._row.get()], columns=self._fields)
            self._row.clear()

    def close(self) -> None:
        pass


def last_per_key(stream: DataFrame, sequence: str, *, keys=(KEY, TS), ts: str = TS) -> DataFrame:
    """One row per key with the largest ``sequence``, when the watermark has passed the key's ``ts`` (one of the keys).

    Later rows of that key are late. ``sequence`` must not be null; of equal ones the first seen stays.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    marked = stream.withWatermark(ts, WATERMARK)
    return marked.groupBy(*keys).transformWithStateInPandas(_Newest(ts, sequence, stream.columns, schema), schema, "Append", "EventTime")
