import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import probability as P


def _student(t, v):
    """Two-sided tail by Simpson's rule over the density."""
    x = np.linspace(0, abs(t), 20_001)
    y = np.exp(-(v + 1) / 2 * np.log1p(x * x / v))
    inner = abs(t) / 20_000 / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 1 - 2 * inner * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)


def test_normal(spark):
    zs = [0.0, 1e-9, 0.3, -1.0, 1.959963984540054, 2.9, 4.2, 4.3, -6.5, 9.0, 20.0, 37.0]
    rows = spark.createDataFrame([(z,) for z in [*zs, None, float("nan")]], "z double").select("z", P.normal_two_sided(F.col("z")).alias("p"), P.normal_cdf(F.col("z")).alias("c")).collect()
    for row, z in zip(rows, zs, strict=False):
        assert row["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-10)
        assert row["c"] == pytest.approx(NormalDist().cdf(z), abs=1e-14)
    assert [r["p"] for r in rows[len(zs):]] == [None, None]


def test_normal_quantile(spark):
    ps = [1e-12, 1e-4, 0.01, 0.05, 0.3, 0.4999, 0.5, 0.6, 0.975, 0.99999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select(P.normal_quantile(F.col("p")).alias("z")).collect()
    for row, p in zip(rows, ps, strict=True):
        assert row["z"] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12)
    odd = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (1.1,), (None,)], "p double").select(P.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in odd] == [-math.inf, math.inf, None, None, None]


def test_student(spark):
    cases = [(t, v) for t in (0.0, 0.1, -1.0, 2.5, 7.0) for v in (1, 2, 3, 4, 7, 30, 99, 399, 400, 401, 1000, 20_000)]
    rows = spark.createDataFrame([(float(t), v) for t, v in cases], "t double, v long").select(P.student_two_sided(F.col("t"), F.col("v")).alias("p"), P.student_cdf(F.col("t"), F.col("v")).alias("c")).collect()
    for row, (t, v) in zip(rows, cases, strict=True):
        want = _student(t, v)
        assert row["p"] == pytest.approx(want, abs=2e-9), (t, v)
        assert row["c"] == pytest.approx(1 - want / 2 if t > 0 else want / 2, abs=2e-9)
    assert spark.range(1).select(P.student_two_sided(F.lit(1.0), F.lit(0)).alias("p")).first()["p"] is None


def test_kolmogorov(spark):
    rows = spark.createDataFrame([(0.1, 100, 100), (0.01, 50, 50), (0.9, 500, 500), (None, 5, 5), (0.2, 0, 5)], "d double, a long, b long")
    got = [r["p"] for r in rows.select(P.kolmogorov_two_sample(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.6994, abs=1e-3) and got[1] == 1.0 and got[2] == pytest.approx(0, abs=1e-12) and got[3:] == [None, None]
