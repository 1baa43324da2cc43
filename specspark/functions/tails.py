"""Tail probabilities without a statistics library, for scalars and small columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d or tiny)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + step * d) or tiny)
            c = (1.0 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def kolmogorov(d: float, n: float, m: float) -> float:
    """Asymptotic two-sided p of a two-sample distance."""
    z = d * math.sqrt(n * m / (n + m))
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


# Coefficients of the complementary error function's Chebyshev fit, relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Steps of Simpson's rule over the normal range and over the scale; largest df with a scale; halvings of [0, TOP].
STEPS, SCALED_DF, HALVINGS, TOP = 96, 5000, 40, 100.0


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * a)
    half = 0.5 * t * np.exp(-a * a + np.polynomial.polynomial.polyval(t, ERFC))
    return np.where(x >= 0, 1 - half, half)


def _simpson(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of Simpson's rule."""
    k = np.arange(STEPS + 1)
    weights = np.where(k % 2 == 1, 4.0, 2.0)
    weights[[0, -1]] = 1.0
    return lo + (hi - lo) * k / STEPS, weights * (hi - lo) / STEPS / 3


def _scales(df: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of the scale and the weight of each: that of the rule times the density."""
    if df > SCALED_DF:
        return np.ones(1), np.ones(1)
    spread = 8 / math.sqrt(2 * df)
    s, w = _simpson(max(1e-6, 1 - spread), 1 + spread + (2.0 if df < 4 else 0.0))
    log_c = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    return s, w * np.exp(log_c + (df - 1) * np.log(s) - df * s * s / 2)


def studentised_range_upper(q: float, groups: int, df: float) -> float:
    """P(Q > q) of the studentised range, by Simpson's rule over the scale and the normal range."""
    (z, wz), (s, ws) = _simpson(-8.0, 8.0), _scales(df)
    density = wz * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = _normal_cdf(z)[None, :] - _normal_cdf(z[None, :] - q * s[:, None])
    return max(0.0, 1.0 - float(ws @ (groups * inner ** (groups - 1) @ density)))


def studentised_range_critical(alpha: float, groups: int, df: float) -> float:
    lo, hi = 0.0, TOP
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if studentised_range_upper(mid, groups, df) > alpha else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def range_critical(alpha: pd.Series, groups: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(d) or d <= 0 or g < 2 else studentised_range_critical(a, int(g), float(d)) for a, g, d in zip(alpha, groups, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else f_upper(a, b, c) for a, b, c in zip(f, d1, d2, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else kolmogorov(a, b, c) for a, b, c in zip(d, n, m, strict=True)], dtype="float64")
