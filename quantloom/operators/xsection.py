"""Cross-sections: ranks, standardisation, leave-one-out residuals and portfolio weights, date by date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import cross_section


def pct_rank(x: str, by: str = "date") -> Column:
    """Average-tie percentile rank of the non-null x of a date (rank of the mean of equal values, over their number)."""
    low = F.rank().over(Window.partitionBy(by).orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(by, x))
    return F.when(F.col(x).isNotNull(), (low + (ties - 1) / 2.0) / F.count(x).over(cross_section(by)))


def standardized(rank: str, by: str = "date") -> Column:
    """Centred and divided by the sample deviation; a constant date is 0."""
    w = cross_section(by)
    centred, sd = F.col(rank) - F.avg(rank).over(w), F.stddev_samp(rank).over(w)
    return F.when(sd > 0, centred / sd).otherwise(centred * 0.0)


def leave_one_out(x: str, by: str = "date") -> Column:
    """x less the mean of the date's other values; null where there are no others but fewer than three names."""
    w = cross_section(by)
    n = F.count(x).over(w)
    return F.when(n > 2, F.col(x) - (F.sum(x).over(w) - F.col(x)) / F.greatest(n - 1, F.lit(1)))


def equal_weight(flag: Column, by: str = "date") -> Column:
    n = F.sum(flag.cast("int")).over(cross_section(by))
    return F.when(flag & (n > 0), 1.0 / n).otherwise(0.0)


def inverse_vol(variance: str, by: str = "date") -> Column:
    inv = F.when(F.col(variance) > 0, 1.0 / F.sqrt(F.col(variance)))
    return inv / F.sum(inv).over(cross_section(by))


def long_short(rank: str, beta: str | None = None, by: str = "date", least: int = 10) -> Column:
    """Centred ranks with gross weight 1; with beta, their residuals on a constant and beta. Few names: 0."""
    w = cross_section(by)
    both = F.col(rank).isNotNull() & (F.col(beta).isNotNull() if beta else F.lit(True))
    z = F.when(both, F.col(rank))
    raw = z - F.avg(z).over(w)
    if beta:
        b = F.when(both, F.col(beta))
        raw = z - (F.regr_intercept(z, b).over(w) + F.regr_slope(z, b).over(w) * b)
    gross = F.sum(F.abs(raw)).over(w)
    return F.when((F.count(z).over(w) >= least) & both & (gross > 0), raw / gross).otherwise(0.0)


def top_quantile(rank: str, q: float = 0.2, by: str = "date") -> Column:
    return equal_weight(F.coalesce(F.col(rank) > 1 - q, F.lit(False)), by)
