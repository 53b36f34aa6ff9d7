"""Tail probabilities of the normal, t, F and chi-square distributions.

Scalars on the driver, arrays inside pandas UDFs that run on group summaries. The
incomplete beta and gamma functions use their usual continued fractions and series.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
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


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * front
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    out = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _missing(*values) -> bool:
    return any(v is None or (isinstance(v, float) and math.isnan(v)) for v in values)


def t_two_sided(t: float, df: float) -> float | None:
    if _missing(t, df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float | None:
    if _missing(f, d1, d2) or d1 <= 0 or d2 <= 0:
        return None
    if math.isinf(f):
        return 0.0
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float | None:
    if _missing(x, df) or df <= 0:
        return None
    return gamma_upper(df / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float | None:
    return None if _missing(z) else math.erfc(abs(z) / math.sqrt(2.0))


def _series(fn, *cols) -> pd.Series:
    return pd.Series([fn(*[float(v) if v is not None else None for v in row]) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided_col(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_tail_col(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series(f_tail, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_tail_col(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(chi2_tail, x, df)


@F.pandas_udf(T.DoubleType())
def normal_two_sided_col(z: pd.Series) -> pd.Series:
    return _series(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def normal_cdf_col(z: pd.Series) -> pd.Series:
    return _series(lambda v: None if _missing(v) else normal_cdf(v), z)
