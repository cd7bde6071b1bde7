"""Distribution functions as column expressions: normal, inverse normal, Student, Kolmogorov.

Each is a fixed number of steps of a published series, so it stays inside the plan of the
rows that need it. NULL and NaN arguments give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_TERMS = 80  # enough for |x| < 3 in double precision
FRACTION_STEPS = 80  # enough for |x| >= 3
WHOLE_DEGREES = 400  # up to here Student's tail is the finite sum, above it the expansion about the normal


def _known(*columns: Column) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull() & ~F.isnan(c)
    return known


def _down(steps: int) -> Column:
    return F.sequence(F.lit(steps), F.lit(1), F.lit(-1))


def erfc_abs(x: Column) -> Column:
    """Complementary error function of ``abs(x)``: a series of positive terms near zero, a continued fraction beyond."""
    a = F.abs(x.cast("double"))
    square = a * a
    # Horner form of sum((2 x^2)^n / (2n + 1)!!)
    series = F.aggregate(_down(SERIES_TERMS), F.lit(1.0), lambda acc, n: F.lit(1.0) + acc * 2 * square / (2 * n + 1))
    near = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * a * F.exp(-square) * series
    fraction = F.aggregate(_down(FRACTION_STEPS), a, lambda acc, n: a + (n / F.lit(2.0)) / acc)
    far = F.exp(-square) / (F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(_known(a), F.when(a < 3, near).otherwise(far))


def normal_two_sided(z: Column) -> Column:
    """Probability of a standard normal value at least as far from zero as ``z``."""
    return erfc_abs(z / F.lit(math.sqrt(2.0)))


def normal_cdf(z: Column) -> Column:
    tail = normal_two_sided(z) / 2
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution; infinite at 0 and 1, NULL outside.

    Halley steps on the lower tail from the Gaussian bound of the tail, until doubles stop moving.
    """
    p = p.cast("double")
    tail = F.least(p, 1 - p)
    start = -F.sqrt(F.greatest(-2 * F.log(2 * tail), F.lit(0.0)))

    def step(z, _):
        error = (normal_two_sided(z) / 2 - tail) * F.lit(math.sqrt(2 * math.pi)) * F.exp(z * z / 2)
        return z - error / (1 + z * error / 2)

    lower = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)
    inside = F.when(p == 0.5, F.lit(0.0)).when(p < 0.5, lower).otherwise(-lower)
    ends = F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf")))
    return F.when(_known(p) & (p > 0) & (p < 1), inside).otherwise(ends)


def student_two_sided(t: Column, degrees: Column) -> Column:
    """Probability of a Student value at least as far from zero as ``t``, for whole degrees of freedom.

    The finite sum of cosine powers up to ``WHOLE_DEGREES``; above, the expansion that turns t into
    an equivalent normal value, whose error falls with the fourth power of the degrees.
    """
    a, v = F.abs(t.cast("double")), degrees.cast("double")
    whole = v.cast("bigint")
    cosine2 = v / (v + a * a)
    sine, angle = a / F.sqrt(v + a * a), F.atan(a / F.sqrt(v))
    odd = whole % 2 == 1
    # even: 1 + 1/2 c^2 + (1 3)/(2 4) c^4 + ..., odd: 1 + 2/3 c^2 + (2 4)/(3 5) c^4 + ...; the last power is v - 2 or v - 3
    terms = F.when(odd, (whole - 3) / 2).otherwise((whole - 2) / 2).cast("int")
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    down = F.when(terms > 0, F.sequence(F.least(terms, F.lit(WHOLE_DEGREES)), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    powers = F.aggregate(down, F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * ratio(k.cast("double")) * cosine2)
    inner = F.when(odd, F.lit(2 / math.pi) * (angle + F.when(whole > 1, sine * F.sqrt(cosine2) * powers).otherwise(F.lit(0.0)))).otherwise(sine * powers)
    exact = F.greatest(1 - inner, F.lit(0.0))

    shift, scale = v - 0.5, 48 * (v - 0.5) * (v - 0.5)
    z = F.sqrt(shift * F.log1p(a * a / v))
    equal = z + (z**3 + 3 * z) / scale - (4 * z**7 + 33 * z**5 + 240 * z**3 + 855 * z) / (10 * scale * (scale + 0.8 * z**4 + 100))
    return F.when(_known(a, v) & (v >= 1), F.when(whole <= WHOLE_DEGREES, exact).otherwise(normal_two_sided(equal)))


def student_cdf(t: Column, degrees: Column) -> Column:
    tail = student_two_sided(t, degrees) / 2
    return F.when(t > 0, 1 - tail).otherwise(tail)


def kolmogorov_two_sample(distance: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p of the two-sample Kolmogorov-Smirnov distance, by 100 terms of the alternating series."""
    a, b = n1.cast("double"), n2.cast("double")
    x = distance * F.sqrt(a * b / (a + b))
    sign = lambda k: F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + sign(k) * F.exp(-2.0 * k * k * x * x))
    p = F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))
    return F.when(_known(distance, a, b) & (a > 0) & (b > 0), p)
