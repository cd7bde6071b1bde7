"""Cost anchors, residual load, weather aggregates, transforms: pure column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.schemas import CITIES, WEATHER_VARIABLES, WIND, existing

# Heat rates (MWh fuel per MWh power) and emission factors (tCO2 per MWh fuel).
GAS_HEAT_RATE, GAS_EMISSIONS = 1.95, 0.20
COAL_HEAT_RATE, COAL_EMISSIONS = 2.46, 0.34


def null_or(c: Column, value: Column) -> Column:
    """``value`` where ``c`` is known: greatest/least skip NULLs, pandas arithmetic does not."""
    return F.when(c.isNotNull(), value)


def clip(c: Column, lo=None, hi=None) -> Column:
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return null_or(c, out)


def cost_anchors(gas: str = "ttf_gas", carbon: str = "carbon_ets") -> dict[str, Column]:
    g, c = F.col(gas), F.coalesce(F.col(carbon), F.lit(0.0))
    return {
        "clean_spark_anchor": g * GAS_HEAT_RATE + c * (GAS_EMISSIONS * GAS_HEAT_RATE),
        "clean_dark_anchor": g * COAL_HEAT_RATE + c * (COAL_EMISSIONS * COAL_HEAT_RATE),
        "gas_carbon_interaction": g * c,
    }


def _plus(columns) -> Column:
    out = None
    for c in columns:
        out = F.col(c) if out is None else out + F.col(c)
    return F.lit(0.0) if out is None else out


def residual_load(df: DataFrame, load: str = "load") -> dict[str, Column]:
    """Residual load and renewable penetration; an unknown part makes the residual unknown."""
    wind, solar, ror = _plus(existing(df, WIND)), _plus(existing(df, ["gen_solar"])), _plus(existing(df, ["gen_hydro_ror"]))
    share = (wind + solar) / F.nullif(F.col(load), F.lit(0.0))
    return {
        "residual_load": F.col(load) - (wind + solar + ror),
        "renewable_penetration": F.coalesce(clip(share, 0.0, 1.0), F.lit(0.0)),
    }


def residual_load_skipping(df: DataFrame, load: str = "load") -> Column:
    """The other definition in use: missing renewable parts count as 0."""
    parts = existing(df, [*WIND, "gen_solar", "gen_hydro_ror"])
    total = F.lit(0.0)
    for c in parts:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return F.col(load) - total


def scarcity(penetration: str = "renewable_penetration", below: float = 0.10) -> Column:
    return (F.col(penetration) < below).cast("int")


def row_mean(columns) -> Column:
    """Mean over the known values of a row."""
    known = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def row_max(columns) -> Column:
    return F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])


def weather_aggregates(df: DataFrame, cities=CITIES, variables=WEATHER_VARIABLES) -> dict[str, Column]:
    out = {}
    for v in variables:
        cols = existing(df, [f"{c}_{v}" for c in cities])
        if cols:
            out[f"weather_mean_{v}"] = row_mean(cols)
            if "wind" in v or "radiation" in v:
                out[f"weather_max_{v}"] = row_max(cols)
    return out


def degree_hours(t: Column, *, heat_below: float = 15.0, cool_above: float = 22.0) -> dict[str, Column]:
    return {
        "heating_degree": null_or(t, F.greatest(F.lit(heat_below) - t, F.lit(0.0))),
        "cooling_degree": null_or(t, F.greatest(t - cool_above, F.lit(0.0))),
    }


def net_imports(df: DataFrame, borders=("FR", "AT", "CH")) -> dict[str, Column]:
    return {
        f"net_import_{b}": F.col(f"{b}_to_DELU") - F.col(f"DELU_to_{b}")
        for b in borders
        if f"{b}_to_DELU" in df.columns and f"DELU_to_{b}" in df.columns
    }


def standardise(c: Column, mean: Column, scale: Column) -> Column:
    return (c - mean) / scale


def unstandardise(c: Column, mean: Column, scale: Column) -> Column:
    return c * scale + mean


def softplus(x: Column) -> Column:
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))


def monotone_quantiles(mid: Column, down: Column, up: Column) -> dict[str, Column]:
    return {"q10": mid - softplus(down), "q50": mid, "q90": mid + softplus(up)}


def repair_crossing(columns=("q10", "q50", "q90")) -> dict[str, Column]:
    """Sort the quantiles of a row."""
    s = F.array_sort(F.array(*[F.col(c) for c in columns]))
    return {c: s[i] for i, c in enumerate(columns)}


def anchor_target(price: Column, anchor: Column) -> Column:
    return F.asinh(price - anchor)


def anchor_inverse(z: Column, anchor: Column) -> Column:
    return F.sinh(z) + anchor


def hashed_uniform(row_key, seed: int) -> Column:
    """A number in (0, 1) drawn from the text of a row's key: the same whatever the partitioning."""
    parts = [F.unix_micros(k).cast("string") if k.endswith("ts") else F.col(k).cast("string") for k in row_key]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def horizon_noise(c: Column, std: float, h: Column, row_key, seed: int) -> Column:
    """Forecast-like noise growing with the square root of the horizon (augmentation), by Box-Muller from hashed draws."""
    normal = F.sqrt(-2 * F.log(hashed_uniform(row_key, seed))) * F.cos(2 * math.pi * hashed_uniform(row_key, seed + 1))
    return c + normal * F.lit(std) * F.sqrt(h)


def solar_elevation(ts="ts", lat: float = 51.0, lon: float = 10.0) -> Column:
    """Solar elevation in degrees (Spencer declination and equation of time, fixed series coefficients)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    hour = F.hour(t) + F.minute(t) / 60.0
    g = (F.dayofyear(t) + hour / 24.0 - 1) * (2 * math.pi / 365)

    def series(const, *terms):
        out = F.lit(const)
        for k, (a, b) in enumerate(terms, start=1):
            out = out + a * F.cos(g * k) + b * F.sin(g * k)
        return out

    decl = series(0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))
    eq = 229.18 * series(0.000075, (0.001868, -0.032077), (-0.014615, -0.040849))
    minutes = F.hour(t) * 60 + F.minute(t) + eq + 4 * lon
    angle = F.radians(minutes / 4 - 180)
    phi = math.radians(lat)
    return F.degrees(F.asin(math.sin(phi) * F.sin(decl) + math.cos(phi) * F.cos(decl) * F.cos(angle)))
