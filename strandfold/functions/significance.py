"""Two-sided p-value of a correlation coefficient, as an Arrow-batched column function."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz recurrence)."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    result = d
    for m in range(1, 1000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + numerator / c
            c = c if abs(c) > floor else floor
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return float(front * _beta_fraction(a, b, x) / a)
    return float(1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """P(|R| >= |r|) for n pairs without correlation: Student t with n - 2 degrees of freedom."""

    def one(coefficient, pairs):
        if pd.isna(coefficient) or pairs < 3:
            return None
        return incomplete_beta((pairs - 2) / 2.0, 0.5, max(0.0, 1.0 - coefficient * coefficient))

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")
