"""Calendar encodings, holidays, local time and segment labels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.schemas import TS

# German national holidays, as (month, day) and as days from Easter Sunday.
FIXED_HOLIDAYS = ((1, 1), (5, 1), (10, 3), (12, 25), (12, 26))
EASTER_HOLIDAYS = (-2, 1, 39, 50)
SINGLE_HOLIDAYS = ("2017-10-31",)
LOCAL_ZONE = "Europe/Berlin"


def _col(ts) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def _cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def calendar(ts=TS, *, month_base: int = 0) -> dict[str, Column]:
    """Cyclic hour, weekday (Monday = 0) and month, and a weekend flag. ``month_base`` is subtracted from the month."""
    t = _col(ts)
    hs, hc = _cycle(F.hour(t), 24)
    ds, dc = _cycle(F.weekday(t), 7)
    ms, mc = _cycle(F.month(t) - month_base, 12)
    return {
        "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc, "month_sin": ms, "month_cos": mc,
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    }


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus, in integer arithmetic."""
    def div(a, b):
        return F.floor(a / b)

    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = div(a + 11 * h, 319)
    r = (2 * e + 2 * i - k - h + m + 32) % 7
    month = div(h - m + r + 90, 25)
    day = (h - m + r + month + 19) % 32
    return F.make_date(year, month.cast("int"), day.cast("int"))


def is_holiday(ts=TS) -> Column:
    """1 on German national holidays, by UTC date. An expression: no holiday table to join."""
    t = _col(ts)
    fixed = F.lit(False)
    for m, d in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month(t) == m) & (F.dayofmonth(t) == d))
    offset = F.datediff(F.to_date(t), easter_sunday(F.year(t)))
    single = F.to_date(t).isin([F.lit(x).cast("date") for x in SINGLE_HOLIDAYS])
    return (fixed | offset.isin(*EASTER_HOLIDAYS) | single).cast("int")


def local_offset_seconds(ts=TS, zone: str = LOCAL_ZONE) -> Column:
    t = _col(ts)
    return F.unix_seconds(F.from_utc_timestamp(t, zone)) - F.unix_seconds(t)


def step_break(w, ts=TS, step: int = 3600) -> Column:
    """1 where the stamp does not follow the previous one by one step (0 on the first row)."""
    t = _col(ts)
    diff = F.unix_seconds(t) - F.unix_seconds(F.lag(t).over(w))
    return F.coalesce((diff != step).cast("int"), F.lit(0))


def dst_change(w, ts=TS, zone: str = LOCAL_ZONE) -> Column:
    """1 where the local UTC offset differs from that of the previous row."""
    off = local_offset_seconds(ts, zone)
    before = local_offset_seconds(F.lag(_col(ts)).over(w), zone)
    return F.coalesce((off != before).cast("int"), F.lit(0))


def season(ts=TS) -> Column:
    m = F.month(_col(ts))
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    )


def hour_group(ts=TS) -> Column:
    h = F.hour(_col(ts))
    return (
        F.when(h.between(6, 9), "morning_peak").when(h.between(10, 16), "midday").when(h.between(17, 20), "evening_peak").otherwise("night")
    )


def day_type(ts=TS) -> Column:
    return F.when(F.weekday(_col(ts)) >= 5, "weekend").otherwise("weekday")


def local(ts=TS, zone: str = LOCAL_ZONE) -> Column:
    """Local wall time, for segmenting by local hour: ``hour_group(local(ts))``."""
    return F.from_utc_timestamp(_col(ts), zone)


def in_range(start: str, end: str, ts=TS) -> Column:
    """1 inside ``[start, end)``; the energy-crisis regime is 2022-03-01 to 2023-03-01."""
    t = _col(ts)
    return ((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp"))).cast("int")


CRISIS = ("2022-03-01", "2023-03-01")


def segments(ts, y: Column, top_threshold: Column | None = None, crisis=CRISIS) -> dict[str, Column]:
    """Boolean segment predicates on the target time and the truth."""
    t = _col(ts)
    peak = F.hour(t).between(8, 20)
    weekend = F.weekday(t) >= 5
    out = {
        "all": F.lit(True), "peak": peak, "off_peak": ~peak, "weekend": weekend, "weekday": ~weekend,
        "crisis_2022": in_range(*crisis, t) == 1, "post_crisis": t >= F.lit(crisis[1]).cast("timestamp"),
        "negative_price": y < 0,
    }
    if top_threshold is not None:
        out["spike_top10pct"] = y >= top_threshold
    return out


def horizon_weight(h: str = "horizon_h", *, until: int = 6, weight: float = 1.5) -> Column:
    return F.when(F.col(h) <= until, F.lit(weight)).otherwise(F.lit(1.0))
