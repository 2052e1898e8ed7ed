"""Null-safe arithmetic. Missing values are null everywhere; NaN and infinity never leave."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b) -> Column:
    """a / b, null when b is zero or either side is null."""
    a, b = col(a), col(b)
    return F.when(b != 0, a / b)


def finite(x) -> Column:
    """x with NaN and infinities mapped to null."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep null, where least/greatest alone would swallow it."""
    x = col(x)
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def none_if_zero(x) -> Column:
    x = col(x)
    return F.when(x != 0, x)


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Sample skewness from the population moment ratio; needs n >= 3."""
    n = n.cast("double")
    return F.when(n >= 3, finite(g1) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population excess; needs n >= 4."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * finite(g2) + 6))


# Rational approximation of the normal tail (Hart 1968, double precision).
HART_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SQRT_2PI = math.sqrt(2.0 * math.pi)


def _poly(z: Column, coefs) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * z + F.lit(c)
    return acc


def norm_pdf(x) -> Column:
    x = col(x)
    return F.exp(-x * x / 2) / F.lit(SQRT_2PI)


def norm_cdf(x) -> Column:
    """Standard normal CDF inside codegen; absolute error below 1e-14."""
    x = col(x)
    z = F.abs(x)
    near = F.exp(-z * z / 2) * _poly(z, HART_NUM) / _poly(z, HART_DEN)
    frac = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + F.lit(0.65)))))
    far = F.exp(-z * z / 2) / (frac * F.lit(SQRT_2PI))
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)
