"""Linear quantile regression by reweighted least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.schemas import QUANTILES
from panelcast.session import materialize


class LinearQuantiles:
    """One linear model per quantile, all fitted together.

    Each iteration is one pass: every task adds up the weighted normal equations of
    all quantiles over its rows as matrices, and only their sums (a few numbers per
    pair of features, whatever the data size) reach the driver for the solve.
    Iterations go on until no fitted line moves by more than ``tolerance`` of the
    target's spread; a fit that does not settle within ``most`` is an error.
    """

    def __init__(self, features, quantiles: dict[str, float] = QUANTILES, *, tolerance: float = 1e-3, most: int = 200, floor: float = 1e-3, ridge: float = 1e-6):
        self.features, self.quantiles = list(features), dict(quantiles)
        self.tolerance, self.most, self.floor, self.ridge = tolerance, most, floor, ridge
        self.coef: dict[str, np.ndarray] | None = None

    def _terms(self) -> list[Column]:
        return [F.lit(1.0), *[F.col(c).cast("double") for c in self.features]]

    def _line(self, beta) -> Column:
        out = F.lit(0.0)
        for b, t in zip(beta, self._terms()):
            out = out + float(b) * t
        return out

    def _equations(self, used: DataFrame, beta: dict[str, np.ndarray] | None, scale: float) -> dict[str, np.ndarray]:
        """Per quantile the Gram matrix with the right-hand side as its last column."""
        taus, p, floor = self.quantiles, len(self.features) + 1, self.floor

        def run(batches):
            total = {q: np.zeros((p, p + 1)) for q in taus}
            for pdf in batches:
                data = pdf.to_numpy(dtype=float)
                x, y = np.column_stack([np.ones(len(data)), data[:, :-1]]), data[:, -1]
                for q, tau in taus.items():
                    w = np.ones(len(y))
                    if beta is not None:
                        e = y - x @ beta[q]
                        w = np.where(e >= 0, tau, 1 - tau) / np.maximum(np.abs(e), floor * scale)
                    total[q] += (x * w[:, None]).T @ np.column_stack([x, y])
            yield pd.DataFrame({"q": list(total), "cells": [t.ravel() for t in total.values()]})

        parts = used.mapInPandas(run, "q string, cells array<double>")
        rows = parts.select("q", F.posexplode("cells").alias("i", "v")).groupBy("q", "i").agg(F.sum("v").alias("v")).collect()
        out = {q: np.zeros(p * (p + 1)) for q in taus}
        for r in rows:
            out[r["q"]][r["i"]] = r["v"]
        return {q: v.reshape(p, p + 1) for q, v in out.items()}

    def fit(self, df: DataFrame, y: str = "y") -> LinearQuantiles:
        used = df.select(*[F.col(c).cast("double").alias(c) for c in self.features], F.col(y).cast("double").alias("_y")).dropna()
        used = materialize(used)  # read once per iteration instead of recomputed
        p = len(self.features) + 1
        whole = used.agg(F.stddev_pop("_y").alias("_scale"), F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(self.features)]).first()
        if not whole["_n"]:
            raise ValueError("no complete training rows")
        scale = whole["_scale"] or 1.0
        # a line moves by at most about this much per unit of each coefficient
        unit = np.array([1.0, *[whole[f"_s{i}"] or 0.0 for i in range(p - 1)]])
        beta: dict[str, np.ndarray] | None = None
        for step in range(self.most):
            before, beta = beta, {}
            for q, m in self._equations(used, before, scale).items():
                gram, rhs = m[:, :p], m[:, p]
                beta[q] = np.linalg.solve(gram + self.ridge * np.trace(gram) / p * np.eye(p) * 1e-3, rhs)
            if step == 0:
                self._level(used, beta)  # from the mean line to each quantile's level
            elif max(np.abs((beta[q] - before[q])[1:] * unit[1:]).max(initial=0.0) for q in beta) <= self.tolerance * scale:
                break
        else:
            raise ArithmeticError(f"quantile regression did not settle within {self.most} iterations")
        self._level(used, beta)
        self.coef = beta
        return self

    def _level(self, used: DataFrame, beta: dict[str, np.ndarray]) -> None:
        """Move each intercept so that the wanted share of residuals lies below the line."""
        shift = used.agg(*[
            F.percentile_approx(F.col("_y") - self._line(beta[q]), tau, 10000).alias(q) for q, tau in self.quantiles.items()
        ]).first()
        for q in self.quantiles:
            beta[q][0] += shift[q]

    def predict_quantiles(self, df: DataFrame) -> DataFrame:
        """Quantiles per row, sorted so that they do not cross."""
        if self.coef is None:
            raise RuntimeError("fit or load first")
        s = F.array_sort(F.array(*[self._line(self.coef[q]) for q in self.quantiles]))
        return df.withColumn("_s", s).select("*", *[F.col("_s")[i].alias(q) for i, q in enumerate(self.quantiles)]).drop("_s")

    def predict_point(self, df: DataFrame) -> DataFrame:
        return self.predict_quantiles(df).select(*df.columns, F.col("q50").alias("point"))

    def table(self, spark) -> DataFrame:
        rows = [(q, n, float(b)) for q, beta in self.coef.items() for n, b in zip(["_intercept", *self.features], beta)]
        return spark.createDataFrame(rows, "quantile string, term string, coefficient double")

    def save(self, spark, path: str) -> None:
        self.table(spark).write.mode("errorifexists").parquet(path)

    def load(self, spark, path: str) -> LinearQuantiles:
        terms = ["_intercept", *self.features]
        got = {(x["quantile"], x["term"]): x["coefficient"] for x in spark.read.parquet(path).collect()}  # quantiles x features
        self.coef = {q: np.array([got[(q, t)] for t in terms]) for q in self.quantiles}
        return self
