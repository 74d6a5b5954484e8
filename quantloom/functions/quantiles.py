"""Quantile vectors as arrays: rearrangement, moments, interpolation and tail means by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 21 levels.
LEVELS = (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)


def levels(u=LEVELS) -> Column:
    return F.array(*(F.lit(float(x)) for x in u))


def rearranged(q: Column) -> Column:
    return F.array_sort(q)


def crossed(q: Column) -> Column:
    return q != F.array_sort(q)


def _knots(q: Column, u: tuple[float, ...], tail: str) -> tuple[Column, list[float]]:
    """q and u with the ends at 0 and 1: flat repeats the end values, linear extends the end segments."""
    n = len(u)
    at = lambda i: F.get(q, i)
    lo, hi = at(0), at(n - 1)
    if tail == "linear":
        lo = lo - u[0] * (at(1) - at(0)) / (u[1] - u[0])
        hi = hi + (1 - u[-1]) * (at(n - 1) - at(n - 2)) / (u[-1] - u[-2])
    return F.concat(F.array(lo), q, F.array(hi)), [0.0, *u, 1.0]


def moments(q: Column, u=LEVELS, tail: str = "linear") -> tuple[Column, Column]:
    """(mean, variance) of the piecewise-linear quantile function, exactly."""
    a, v = _knots(q, tuple(u), tail)
    du = F.array(*(F.lit(y - x) for x, y in zip(v, v[1:], strict=False)))
    n = len(v)
    lo, hi = F.slice(a, 1, n - 1), F.slice(a, 2, n - 1)
    ab = F.zip_with(lo, hi, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    total = lambda f: F.aggregate(F.zip_with(ab, du, lambda p, d: d * f(p.x, p.y)), F.lit(0.0), lambda s, x: s + x)
    m1 = total(lambda x, y: (x + y) / 2)
    m2 = total(lambda x, y: (x * x + x * y + y * y) / 3)
    return m1, F.greatest(m2 - m1 * m1, F.lit(0.0))


def at(q: Column, v: Column | float, u=LEVELS, tail: str = "linear") -> Column:
    """Q(v), extended beyond the end levels by the end segments (linear) or values (flat)."""
    v = F.lit(float(v)) if isinstance(v, (int, float)) else v
    n, g = len(u), levels(u)
    j = F.least(F.greatest(F.size(F.filter(g, lambda x: x <= v)) - 1, F.lit(0)), F.lit(n - 2))
    lo, hi, a, b = F.get(q, j), F.get(q, j + 1), F.get(g, j), F.get(g, j + 1)
    out = lo + (v - a) / (b - a) * (hi - lo)
    if tail == "flat":
        out = F.when(v < u[0], F.get(q, 0)).when(v > u[-1], F.get(q, n - 1)).otherwise(out)
    return out


def var_es(q: Column, alpha: float, u=LEVELS, tail: str = "linear") -> tuple[Column, Column]:
    """(VaR, ES): Q(alpha) and the mean of Q below alpha."""
    var, q0 = at(q, alpha, u, tail), F.get(q, 0)
    slope = (F.get(q, 1) - q0) / (u[1] - u[0]) if tail == "linear" else F.lit(0.0)
    if alpha <= u[0]:
        return var, q0 + slope * (alpha / 2 - u[0])
    total = q0 * u[0] - slope * (u[0] ** 2 / 2)
    inner = [x for x in u if x < alpha]
    values = [F.get(q, k) for k in range(len(inner))] + [var]
    for k, (a, b) in enumerate(zip(inner, [*inner[1:], alpha], strict=True)):
        total = total + (b - a) * (values[k] + values[k + 1]) / 2
    return var, total / alpha


def mean_exp(q: Column, u=LEVELS, points: int = 199) -> Column:
    """E[exp X] on a midpoint grid with flat tails."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: (i + 0.5) / points)
    return F.aggregate(F.transform(grid, lambda v: F.exp(at(q, v, u, "flat"))), F.lit(0.0), lambda s, x: s + x) / points


def cdf_at_zero(q: Column, u=LEVELS) -> Column:
    """Level at which Q crosses 0, by interpolation; the end levels outside."""
    n, g = len(u), levels(u)
    j = F.size(F.filter(q, lambda x: x <= 0))
    lo, hi, a, b = F.get(q, j - 1), F.get(q, j), F.get(g, j - 1), F.get(g, j)
    return F.when(j == 0, float(u[0])).when(j == n, float(u[-1])).otherwise(F.when(hi > lo, a + (0 - lo) / (hi - lo) * (b - a)).otherwise(a))


def pinball(q: Column, y: Column, u=LEVELS) -> Column:
    """Mean over levels of max(tau*e, (tau-1)*e)."""
    each = F.zip_with(q, levels(u), lambda x, t: F.greatest(t * (y - x), (t - 1) * (y - x)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / len(u)
