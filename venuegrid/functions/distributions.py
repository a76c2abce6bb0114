"""Tail probabilities for the few test rows that aggregates produce."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_PRECISION = 1e-15
_MAX_TERMS = 100_000
_LARGE = 10_000.0  # beyond, differences of log-gamma lose digits and expansions are exact to the digits kept
#: First coefficients in eta of the uniform expansion of the incomplete gamma function (Temme 1979)
_TEMME_0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600, 1 / 25515)
_TEMME_1 = (-1 / 540, -1 / 288, 1 / 378, -77 / 77760, 1 / 4860)


def _continued_fraction(first: float, terms) -> float:
    """``first + n1/(d1 + n2/(d2 + ...))``, evaluated forwards."""
    value = first or _TINY
    upper, lower = value, 0.0
    for numerator, denominator in terms:
        upper = denominator + numerator / upper or _TINY
        lower = 1.0 / (denominator + numerator * lower or _TINY)
        change = upper * lower
        value *= change
        if abs(change - 1.0) < _PRECISION:
            return value
    raise ArithmeticError(f"no result after {_MAX_TERMS} terms")


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)

    def terms():
        for m in range(1, _MAX_TERMS):
            k = m // 2
            if m % 2:
                yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
            else:
                yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    log_front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(log_front) / (a * _continued_fraction(1.0, terms()))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    if a > _LARGE:
        return _gamma_tail_large(a, x)
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, _MAX_TERMS):
            term *= x / (a + n)
            total += term
            if term < total * _PRECISION:
                return 1.0 - math.exp(log_front) * total
        raise ArithmeticError(f"no result after {_MAX_TERMS} terms")
    terms = ((-n * (n - a), x + 2 * n + 1 - a) for n in range(1, _MAX_TERMS))
    return math.exp(log_front) / _continued_fraction(x + 1.0 - a, terms)


def _gamma_tail_large(a: float, x: float) -> float:
    """``gamma_tail`` by the uniform expansion around ``x = a``: a normal tail and a correction."""
    off = (x - a) / a
    if abs(off) < 0.1:
        half_square = math.fsum((-off) ** k / k for k in range(2, 20))  # off - log(1 + off) without cancelling
    else:
        half_square = off - math.log(x / a)
    eta = math.copysign(math.sqrt(2.0 * half_square), off)
    if abs(eta) < 0.1:
        first = sum(c * eta ** k for k, c in enumerate(_TEMME_0))
        second = sum(c * eta ** k for k, c in enumerate(_TEMME_1))
    else:
        first = 1.0 / off - 1.0 / eta
        second = 1.0 / eta ** 3 - 1.0 / off ** 3 - 1.0 / off ** 2 - 1.0 / (12.0 * off)
    correction = math.exp(-a * half_square) / math.sqrt(2.0 * math.pi * a) * (first + second / a)
    return 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + correction


def _normal_of_t(t: float, df: float) -> float:
    """The normal deviate with the tail of ``t``, for many degrees of freedom (Hill 1970)."""
    a = df - 0.5
    b = 48.0 * a * a
    square = a * math.log1p(t / df * t)
    z = math.sqrt(square)
    last = (((4.0 * square + 33.0) * square + 240.0) * square + 855.0) / (10.0 * b * (b + 0.8 * square * square + 100.0))
    return z * (1.0 + (square + 3.0) / b - last)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t; missing input or no degrees of freedom gives NaN."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > _LARGE:
        return math.erfc(_normal_of_t(abs(t), df) / math.sqrt(2.0))
    return beta_share(df / (df + t * t), df / 2.0, 0.5)


def chi2_tail(x: float, df: float) -> float:
    if math.isnan(x) or math.isnan(df) or df <= 0:
        return math.nan
    return gamma_tail(df / 2.0, x / 2.0)


def _by_row(function, left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = zip(left.astype("float64"), right.astype("float64"))
    return pd.Series([function(x, y) for x, y in pairs], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _by_row(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return _by_row(chi2_tail, x, df)
