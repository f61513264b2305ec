"""Two-sided p-value of Student's t as an expression: the regularised incomplete beta function with a fixed number of terms for every df."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TERMS, LIFTS = 80, 40


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): lifted by ``LIFTS`` to where five terms in 1/a are exact in doubles."""
    lifted = F.aggregate(F.sequence(F.lit(0), F.lit(LIFTS - 1)), F.lit(1.0), lambda r, k: r * (a + k) / (a + k + 0.5))
    z = a + LIFTS
    return lifted * F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * F.pow(z, 3)) - 21 / (32768 * F.pow(z, 4)) - 399 / (262144 * F.pow(z, 5)))


def _series(a: Column, y: Column) -> Column:
    """Sum of the power series of the lower part in y: all terms are positive."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def grow(acc, n):
        term = acc["term"] * (a + n + 0.5) / (n + 1.5) * y
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, grow)["sum"]


def _fraction(a: Column, x: Column, y: Column, lead: Column) -> Column:
    """Even part of the continued fraction of the upper part, from its last term back; 1 - x enters as y, so nothing cancels."""
    def partial(n):
        inner = F.when(n > 0, n * (0.5 - n) * x / (a + 2 * n - 1)).otherwise(F.lit(0.0))
        return n + inner + (a + n) / (a + 2 * n + 1) * (lead + 1 + n * (1 + y))

    def back(f, n):
        return partial(n - 1) + (a + n - 1) * (a + n - 0.5) * n * (0.5 - n) * x * x / ((a + 2 * n - 1) * (a + 2 * n - 1)) / f

    steps = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    return F.aggregate(steps, partial(F.lit(TERMS)), back)


def two_sided_p(t: Column, df: Column) -> Column:
    """p of |t|: I_x(df/2, 1/2) at x = df / (df + t^2), at any df with an absolute error below 1e-13."""
    d, square = df.cast("double"), t * t
    a, x, y = d / 2, d / (d + square), square / (d + square)
    front = F.exp(-a * F.log1p(square / d)) * F.sqrt(y) * _gamma_ratio(a) / math.sqrt(math.pi)
    lead = (a + 0.5) * y - 0.5
    near = 1 - 2 * front * _series(a, y)
    p = F.when((lead < 1) & (y <= 0.5), near).otherwise(front / _fraction(a, x, y, lead))
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
