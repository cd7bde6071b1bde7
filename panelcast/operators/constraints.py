"""Physical repairs of a wide market frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.fundamentals import clip, solar_elevation
from panelcast.schemas import FLOW_PAIRS, KEY, NONNEGATIVE_GENERATION, TS, existing

# First quote of the carbon contract, civil twilight.
CARBON_START = "2021-09-29"
NIGHT_ELEVATION = -6.0


def clip_generation(df: DataFrame) -> DataFrame:
    """No negative generation; pumped storage is signed and stays as it is."""
    return df.withColumns({c: clip(F.col(c), 0.0) for c in existing(df, NONNEGATIVE_GENERATION)})


def solar_night(df: DataFrame, column: str = "gen_solar", *, elevation: Column | None = None, night=NIGHT_ELEVATION, twilight=0.0) -> DataFrame:
    """Zero at night, a linear ramp through twilight."""
    if column not in df.columns:
        return df
    elev = solar_elevation() if elevation is None else elevation
    return df.withColumn(column, F.col(column) * clip((elev - night) / (twilight - night), 0.0, 1.0))


def coherent_flows(df: DataFrame, pairs=FLOW_PAIRS) -> DataFrame:
    """A border cannot flow both ways: the smaller direction becomes 0 (the second on a tie)."""
    changes = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            x, y = F.coalesce(F.col(a), F.lit(0.0)), F.coalesce(F.col(b), F.lit(0.0))
            both = (x > 0) & (y > 0)
            changes[a] = F.when(both & (x < y), F.lit(0.0)).otherwise(F.col(a))
            changes[b] = F.when(both & (x >= y), F.lit(0.0)).otherwise(F.col(b))
    return df.withColumns(changes) if changes else df


def null_before(df: DataFrame, column: str = "carbon_ets", start: str = CARBON_START, indicator: str = "carbon_ets_pre_launch") -> DataFrame:
    if column not in df.columns:
        return df
    pre = F.col(TS) < F.lit(start).cast("timestamp")
    return df.withColumns({column: F.when(~pre, F.col(column)), indicator: pre.cast("int")})


def structural_zero(df: DataFrame, raw: DataFrame, column: str = "gen_fossil_coal_gas", keys=(KEY, TS), fill: bool = True) -> DataFrame:
    """Flag (and fill with 0) the cells that are missing in the raw table."""
    flag = f"{column}_structural_zero"
    if column not in raw.columns:
        return df.withColumn(flag, F.lit(0))
    r = raw.select(*keys, F.col(column).isNull().cast("int").alias(flag))
    out = df.join(r, list(keys), "left").fillna(0, subset=[flag])
    return out.withColumn(column, F.coalesce(F.col(column), F.lit(0.0))) if fill else out


def zero_after(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """Missing values become 0 strictly after a shutdown instant."""
    late = F.col(TS) > F.lit(cutoff).cast("timestamp")
    return df.withColumn(column, F.when(late, F.coalesce(F.col(column), F.lit(0.0))).otherwise(F.col(column)))


def apply_constraints(
    df: DataFrame, raw: DataFrame | None = None, *, generation=True, solar=True, flows=True, carbon=True, structural=True
) -> DataFrame:
    """All repairs in their fixed order; the structural flag needs the raw table."""
    if structural and raw is None:
        raise ValueError("raw table needed for the structural-zero flag")
    out = df
    if generation:
        out = clip_generation(out)
    if solar:
        out = solar_night(out)
    if flows:
        out = coherent_flows(out)
    if carbon:
        out = null_before(out)
    if structural:
        out = structural_zero(out, raw, fill=False)
    return out


def violation_counts(df: DataFrame, *, keys=(KEY,), pairs=FLOW_PAIRS, elevation: Column | None = None) -> DataFrame:
    """Counts per rule in one aggregate, as rows (rule, n)."""
    elev = solar_elevation() if elevation is None else elevation
    rules = {f"negative_generation:{c}": F.col(c) < -1e-3 for c in existing(df, NONNEGATIVE_GENERATION)}
    if "gen_solar" in df.columns:
        rules["solar_at_full_night:gen_solar"] = (F.abs("gen_solar") > 1.0) & (elev < NIGHT_ELEVATION)
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            rules[f"both_directions_positive:{a}"] = (F.col(a) > 1.0) & (F.col(b) > 1.0)
    agg = df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules])
    return agg.select(*keys, F.inline(rows))
