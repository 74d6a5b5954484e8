"""Scoring rules and forecast combinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qlike(rv: Column, forecast: Column) -> Column:
    """x - ln x - 1 with x = rv/forecast; null unless both are positive."""
    x = rv / F.nullif(forecast, F.lit(0.0))
    return F.when((rv > 0) & (forecast > 0), x - F.ln(x) - 1)


def fz0(y: Column, var: Column, es: Column, alpha: float) -> Column:
    """Joint VaR/ES loss; null unless es < var < 0."""
    hit = F.when(y <= var, 1.0).otherwise(0.0)
    e = F.when((es < var) & (var < 0) & y.isNotNull(), es)
    return -hit * (var - y) / (alpha * e) + var / e + F.ln(-e) - 1


#: Lower normal quantiles and densities there.
NORMAL = {0.01: (-2.3263478740408408, 0.026652142203457996), 0.025: (-1.9599639845400545, 0.058445069805035), 0.05: (-1.6448536269514729, 0.10313564037537139)}


def normal_var_es(sigma: Column, alpha: float) -> tuple[Column, Column]:
    z, density = NORMAL[alpha]
    return sigma * z, -sigma * (density / alpha)


def geo_mix(parts: list[tuple[float, Column]]) -> Column:
    """Weighted geometric mean; null if a part isn't positive."""
    total = F.lit(0.0)
    for w, f in parts:
        total = total + w * F.when(f > 0, F.ln(f))
    return F.exp(total)


def vincentize(parts: list[tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for w, f in parts:
        total = total + w * f
    return total


def softmax(theta: Column) -> Column:
    e = F.transform(theta, lambda x: F.exp(x - F.array_max(theta)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def vol_target_leverage(sigma: Column, target: float, cap: float) -> Column:
    return F.least(target / F.nullif(sigma, F.lit(0.0)), F.lit(cap))


def hedge_ratio(rho: Column, sigma_spot: Column, sigma_future: Column) -> Column:
    return rho * sigma_spot / F.nullif(sigma_future, F.lit(0.0))


def risk_free_daily(annual_percent: Column) -> Column:
    return F.pow(1 + annual_percent / 100, 1 / 252) - 1
