"""p-values: normal, Student t and F tails as pandas UDFs. Spark has no error function or incomplete beta."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, evaluated by modified Lentz steps."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d, out = 1e-300, 1.0, 1 - (a + b) * x / (a + 1), 0.0
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def normal_tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_tails(t: float, df: float) -> float:
    return _beta_tail(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_tail(f: float, d1: float, d2: float) -> float:
    return _beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f >= 0 else math.nan


def _mapped(function, *columns: pd.Series) -> pd.Series:
    out = [None if any(v is None or np.isnan(v) for v in row) else function(*row) for row in zip(*columns)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return _mapped(normal_tails, z)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return _mapped(t_tails, t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of F."""
    return _mapped(f_tail, f, d1, d2)
