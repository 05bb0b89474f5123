"""Tails of the normal and Student's t distribution, vectorised by Arrow batches: Spark has no ``erf``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + k * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def student_tail(t: float, df: float) -> float:
    """Two-sided tail."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    out = [student_tail(a, b) if a is not None and b is not None else math.nan for a, b in zip(t.astype(float), df.astype(float), strict=True)]
    return pd.Series(np.where(np.isnan(out), None, out), dtype=object)


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    out = [normal_tail(a) for a in z.astype(float)]
    return pd.Series(np.where(np.isnan(out), None, out), dtype=object)
