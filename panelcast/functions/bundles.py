"""Named feature bundles with dependencies, composed in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import fundamentals as fu
from panelcast.functions import timefeatures as tf
from panelcast.operators.buckets import over_buckets
from panelcast.operators.rolling import lag_exprs, rolling_exprs
from panelcast.schemas import CITIES, HOUR, WEATHER_VARIABLES, existing


@dataclass(frozen=True)
class Bundle:
    """``build`` takes the frame and the step of its clock in seconds."""

    build: Callable[[DataFrame, int], DataFrame]
    needs: tuple[str, ...] = ()


def _lags(df: DataFrame, step: int) -> DataFrame:
    ex = {**lag_exprs("price", (1, 2, 3, 24, 25, 48, 49, 168, 169), "price"), **lag_exprs("load", (24, 48, 168, 336), "load"), **rolling_exprs("price", (24, 168, 336), "price")}
    return over_buckets(df, ex, back=336, step=step)


def _spike(df: DataFrame, step: int) -> DataFrame:
    return df.withColumn("is_renewable_scarcity", fu.scarcity())


def _weather(df: DataFrame, step: int) -> DataFrame:
    """Means and maxima over the cities, degree hours, and lags of the means."""
    means = fu.weather_aggregates(df)
    if not means:
        raise KeyError("the weather bundle found none of its columns <city>_<variable>")
    df = df.withColumns(means)
    if "weather_mean_temperature_2m" in means:
        df = df.withColumns(fu.degree_hours(F.col("weather_mean_temperature_2m")))
    lags = {k: v for c in means if c.startswith("weather_mean_") for k, v in lag_exprs(c, (24, 168), c).items()}
    return over_buckets(df, lags, back=168, step=step)


def _load_weather(df: DataFrame, step: int) -> DataFrame:
    """For load models: lags of every city column and of the degree hours."""
    own = existing(df, [f"{c}_{v}" for c in CITIES for v in WEATHER_VARIABLES]) + existing(df, ["heating_degree", "cooling_degree"])
    return over_buckets(df, {k: v for c in own for k, v in lag_exprs(c, (24, 48, 168), c).items()}, back=168, step=step)


def _fundamentals(df: DataFrame, step: int) -> DataFrame:
    return df.withColumns({**(fu.cost_anchors() if {"ttf_gas", "carbon_ets"} <= set(df.columns) else {}), **fu.residual_load(df)})


BUNDLES: dict[str, Bundle] = {
    "calendar": Bundle(lambda df, step: df.withColumns({**tf.calendar(), "is_holiday": tf.is_holiday()})),
    "price_lags": Bundle(_lags),
    "fundamentals": Bundle(_fundamentals),
    "spike": Bundle(_spike, needs=("fundamentals",)),
    "regime": Bundle(lambda df, step: df.withColumn("crisis_2022_flag", tf.in_range(*tf.CRISIS))),
    "weather": Bundle(_weather),
    "load_weather": Bundle(_load_weather, needs=("weather",)),
}


def resolve_order(names: Iterable[str], registry: dict[str, Bundle] = BUNDLES) -> list[str]:
    """Requested bundles and what they need, each once, needed ones first."""
    done: list[str] = []
    for name in names:
        graph, waiting = {}, [name]
        while waiting:
            n = waiting.pop()
            if n not in registry:
                raise KeyError(f"unknown feature bundle {n!r}")
            if n not in graph:
                graph[n] = registry[n].needs
                waiting += graph[n]
        try:
            done += [n for n in TopologicalSorter(graph).static_order() if n not in done]
        except CycleError as e:
            raise ValueError(f"feature bundles depend on each other in a circle: {e.args[1]}") from e
    return done


def build_features(df: DataFrame, names: Iterable[str], registry: dict[str, Bundle] = BUNDLES, *, step: int = HOUR) -> DataFrame:
    """Add the bundles to a panel whose rows are ``step`` seconds apart."""
    for n in resolve_order(names, registry):
        df = registry[n].build(df, step)
    return df
