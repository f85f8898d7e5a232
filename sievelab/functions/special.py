"""Tail of Student's t, for p-values of rank correlations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


MANY = 1e6


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, modified Lentz method."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + numerator * d) or tiny)
            c = (1.0 + numerator / c) or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_tail(rho: float, n: float) -> float:
    """Two-sided p-value of a correlation: t = rho sqrt((n - 2)/(1 - rho^2)) with n - 2 degrees of freedom."""
    if rho is None or n is None or math.isnan(rho) or n < 3:
        return float("nan")
    square = min(rho * rho, 1.0)
    if n > MANY and square < 1.0:
        # the beta function's logarithms would cancel; Wallace's normal deviate of a t value is exact to 1 / n here
        return math.erfc(math.sqrt((n - 2.5) * -math.log1p(-square) / 2.0))
    return incomplete_beta((n - 2.0) / 2.0, 0.5, 1.0 - square)


def spearman_pvalue(rho: Column, n: Column) -> Column:
    """P-value column for a small table of correlations; null where it is undefined."""

    def tail(r: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([correlation_tail(a, b) for a, b in zip(r.astype(float), size.astype(float))])

    value = F.pandas_udf(tail, "double")(rho.cast("double"), n.cast("double"))
    return F.when(~F.isnan(value), value)
