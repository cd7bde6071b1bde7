"""Registration of named queries together with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Means of cents often end exactly on a rounding tie, where the last bit of a sum
# decides. Moving both sides off the tie by the same sliver makes them comparable.
_NUDGE = 0.033


def tidy(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Output form: naive UTC timestamps and doubles rounded (6 places unless told otherwise)."""
    digits = digits or {}
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            places = digits.get(f.name, digits.get("*", 6))
            c = F.round(c + _NUDGE * 10.0**-places, places)
        cols.append(c.alias(f.name))
    return df.select(cols)


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(prepare(spark), folder), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r(expr: str, places: int = 6) -> str:
    """Rounding used on the SQL side (adding 0.0 turns -0.0 into 0.0)."""
    return f"(round({expr} + {_NUDGE * 10.0**-places!r}, {places}) + 0.0)"


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
