"""Table schemas and column groups shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = "series_key"
TS = "ts"
HOUR = 3600
DAY = 86400

# Canonical column groups of the market panel.
CITIES = ("berlin", "cologne", "frankfurt", "hamburg", "munich")
WEATHER_VARIABLES = ("temperature_2m", "wind_speed_10m", "wind_speed_100m", "shortwave_radiation")
NONNEGATIVE_GENERATION = (
    "gen_biomass", "gen_fossil_lignite", "gen_fossil_coal_gas", "gen_fossil_gas",
    "gen_fossil_hard_coal", "gen_fossil_oil", "gen_geothermal", "gen_hydro_ror",
    "gen_hydro_reservoir", "gen_nuclear", "gen_other_renewable", "gen_solar",
    "gen_waste", "gen_wind_offshore", "gen_wind_onshore", "gen_other",
)
WIND = ("gen_wind_onshore", "gen_wind_offshore")
FLOW_PAIRS = (("FR_to_DELU", "DELU_to_FR"), ("AT_to_DELU", "DELU_to_AT"), ("CH_to_DELU", "DELU_to_CH"))
QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}

FORECAST = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField(KEY, T.StringType()),
    T.StructField("origin_ts", T.TimestampType()),
    T.StructField("horizon_h", T.IntegerType()),
    T.StructField("q10", T.DoubleType()),
    T.StructField("q50", T.DoubleType()),
    T.StructField("q90", T.DoubleType()),
])


def existing(df: DataFrame, names) -> list[str]:
    """The given columns that the frame has, in the given order."""
    return [c for c in names if c in df.columns]


def require(df: DataFrame, names) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
