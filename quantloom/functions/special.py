"""Distribution functions without scipy: columns where a closed form exists, Arrow-batched pandas UDFs elsewhere."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def xlogy(x: Column, y: Column) -> Column:
    """x * ln(y), 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def chi2_sf_2(x: Column) -> Column:
    return F.exp(-x / 2)




@F.pandas_udf(DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi2_sf_1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0) / 2)))


def norm_ppf(p: float) -> float:
    """Inverse of the normal distribution function, by bisection on erfc."""
    if not 0 < p < 1:
        return math.nan
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_cf(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * beta_inc(nu / 2, 0.5, nu / (nu + x * x))
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, nu: float) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, nu) < p else (lo, mid)
    return (lo + hi) / 2


def binom_cdf(k: int, n: int, p: float = 0.5) -> float:
    """P(X <= k) for X binomial, by log-gamma sums."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return 1 - beta_inc(k + 1, n - k, p)


@F.pandas_udf(DoubleType())
def binom_greater(k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= k), p = 1/2."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else 1 - binom_cdf(int(a) - 1, int(b)) for a, b in zip(k, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def mcnemar_exact(n01: pd.Series, n10: pd.Series) -> pd.Series:
    """Two-sided exact p of discordant counts; 1 without any."""
    return pd.Series([min(1.0, 2 * binom_cdf(int(min(a, b)), int(a + b))) if a + b else 1.0 for a, b in zip(n01, n10, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def corr_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation coefficient by Student's t."""

    def one(a: float, m: int):
        if pd.isna(a) or m < 3:
            return None
        t = abs(a) * math.sqrt((m - 2) / max(1 - a * a, 1e-300))
        return 2 * (1 - t_cdf(t, m - 2))

    return pd.Series([one(a, m) for a, m in zip(r, n, strict=True)], dtype="float64")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Binomial interval; null for n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p, d = k / m, 1 + z * z / m
    mid, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    return mid - half, mid + half


def deflated_sharpe(sharpe: float, n: int, skew: float, kurt: float, sd_trials: float, n_trials: int) -> float:
    """Probability that a per-period Sharpe ratio beats the expected best of n_trials with deviation sd_trials."""
    gamma = 0.5772156649015329
    best = sd_trials * ((1 - gamma) * norm_ppf(1 - 1 / n_trials) + gamma * norm_ppf(1 - 1 / (n_trials * math.e))) if n_trials > 1 else 0.0
    z = (sharpe - best) * math.sqrt(n - 1) / math.sqrt(max(1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2, 1e-12))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def t_var_es(sigma: np.ndarray, nu: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """VaR and ES of a Student t of unit variance, scaled by sigma; nu is at least 2.05."""
    nu = max(nu, 2.05)
    q, scale = t_ppf(alpha, nu), math.sqrt((nu - 2) / nu)
    density = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + q * q / nu) ** (-(nu + 1) / 2)
    return sigma * scale * q, -sigma * scale * density * (nu + q * q) / ((nu - 1) * alpha)
