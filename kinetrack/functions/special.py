"""Tail probabilities of the usual test statistics, as Arrow column functions over result tables (a row per test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, d = x + 1 - a, 1 / (x + 1 - a)
    c, value = 1e300, d
    for k in range(1, 100_000):
        top, b = -k * (k - a), b + 2
        d, c = 1 / (top * d + b), b + top / c
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def student_p(t: float, dof: float) -> float:
    """Two-sided p of Student's t; 1 without degrees of freedom."""
    if dof < 1 or math.isnan(t):
        return 1.0
    return 0.0 if math.isinf(t) else beta_tail(dof / 2, 0.5, dof / (dof + t * t))


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3 or math.isnan(r):
        return 1.0
    return 0.0 if abs(r) >= 1 else student_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def chi2_p(x: float, dof: float) -> float:
    return gamma_tail(dof / 2, x / 2) if dof > 0 else 1.0


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_p(gap: float, n: float, m: float) -> float:
    """Asymptotic two-sided p of a two-sample Kolmogorov-Smirnov distance."""
    x = gap * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def column_of(f, *columns: Column | str) -> Column:
    """``f`` of the columns, row by row of an Arrow batch; null where any is null. For result tables, not for points."""

    @F.pandas_udf("double")
    def apply(*parts: pd.Series) -> pd.Series:
        rows = np.stack([p.to_numpy(dtype=float, na_value=np.nan) for p in parts], 1)
        return pd.Series([None if np.isnan(row).any() else f(*row) for row in rows], dtype="Float64")

    return apply(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])
