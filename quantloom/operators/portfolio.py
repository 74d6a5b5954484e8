"""Books from signals, volatility targeting and the staggered back-test in closed form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import series


def ewma_pairs(panel: DataFrame, keep: float = 0.97, least: int = 60) -> DataFrame:
    """(date, i, j, rho): recursive correlations of every pair i <= j; missing returns count as 0."""
    from quantloom.operators.windows import ewm

    x = panel.select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("r"), F.count("ret").over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    a = x.select("date", F.col("ticker").alias("i"), F.col("r").alias("ri"), F.col("n").alias("ni"))
    b = x.select("date", F.col("ticker").alias("j"), F.col("r").alias("rj"), F.col("n").alias("nj"))
    s = ewm(a.join(b, "date").where("i <= j").withColumn("x", F.col("ri") * F.col("rj")), "x", "s", keep, 1, ["i", "j"], "date", seed=0.0)
    d = s.where("i = j").select("date", F.col("i").alias("k"), F.greatest("s", F.lit(1e-16)).alias("v"))
    out = s.join(d.select("date", F.col("k").alias("i"), F.col("v").alias("vi")), ["date", "i"]).join(d.select("date", F.col("k").alias("j"), F.col("v").alias("vj")), ["date", "j"])
    known = (F.col("ni") >= least) & (F.col("nj") >= least)
    return out.select("date", "i", "j", F.when(known, F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("s") / F.sqrt(F.col("vi") * F.col("vj")))).alias("rho"))


def vol_target_overlay(book: DataFrame, variance: DataFrame, corr: DataFrame, steps: int, target: float = 0.1, cap: float = 1.0) -> DataFrame:
    """(date, ticker, w): the book scaled to a forecast annual volatility of `target`, by at most `cap`; 0 on dates
    where a held name lacks a variance or a correlation."""
    held = book.where("w <> 0").join(variance, ["date", "ticker"], "left")
    side = lambda k: held.select("date", F.col("ticker").alias(k), F.col("w").alias(f"w{k}"), F.sqrt("variance").alias(f"d{k}"))
    full = corr.unionByName(corr.where("i <> j").select("date", F.col("j").alias("i"), F.col("i").alias("j"), "rho"))
    pairs = side("i").join(side("j"), "date").join(full, ["date", "i", "j"], "left")
    x = F.col("wi") * F.col("wj") * F.col("di") * F.col("dj") * F.col("rho")
    by = pairs.groupBy("date").agg(F.when(F.every(x.isNotNull()), F.sqrt(F.greatest(F.sum(x), F.lit(1e-16)) * 252 / steps)).alias("vol"))
    out = book.join(by, "date", "left")
    return out.select("date", "ticker", F.coalesce(F.col("w") * F.least(F.lit(cap), target / F.col("vol")), F.lit(0.0)).alias("w"))


def backtest(books: DataFrame, returns: DataFrame, exec_lag: int = 1, tranches: int = 5, cost_bps: float = 0.0, borrow: float = 0.0) -> DataFrame:
    """(date, gross, cost, borrow, turnover, long_exp, short_exp, net) of staggered, drifting books.

    books (date, ticker, w; null w: no book), returns (date, ticker, R), both dense on one calendar. Tranche k trades
    on rows i = k modulo the number of tranches that have a book, and holds until the next. Between trades a position
    is its weight times the product of 1+R, so every segment follows from windows: no day waits for the day before."""
    days = returns.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    grid = returns.join(F.broadcast(days), "date").select("ticker", "i", "date", F.coalesce("R", F.lit(0.0)).alias("R"))
    target = books.join(F.broadcast(days), "date").select("ticker", (F.col("i") + exec_lag).alias("i"), "w")
    has = target.groupBy("i").agg(F.max(F.col("w").isNotNull().cast("int")).alias("book"))
    rows = grid.join(target, ["ticker", "i"], "left").join(F.broadcast(has), "i", "left")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tranches - 1))))
    trade = (F.col("i") % tranches == F.col("k")) & (F.coalesce("book", F.lit(0)) == 1)
    w = Window.partitionBy("ticker", "k").orderBy("i")
    rows = rows.withColumns({"trade": trade, "g": F.sum(F.log1p("R")).over(w), "new": F.when(trade, F.coalesce("w", F.lit(0.0)))})
    rows = rows.withColumn("at", F.when(F.col("trade"), F.struct("new", "g")))
    before = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("b", before)
    # positions at the last close, after today's drift, and after today's trade
    start = F.coalesce(F.col("b.new") * F.exp(F.col("g") - F.log1p("R") - F.col("b.g")), F.lit(0.0))
    rows = rows.withColumn("h0", start).withColumn("h1", F.col("h0") * (1 + F.col("R"))).withColumn("h", F.when(F.col("trade"), F.col("new")).otherwise(F.col("h1")))
    s = lambda x: F.sum(x) / tranches
    moved = F.when(F.col("trade"), F.abs(F.col("new") - F.col("h1"))).otherwise(0.0)
    out = rows.groupBy("date").agg(s(F.col("h0") * F.col("R")).alias("gross"), (s(moved) * (cost_bps / 1e4)).alias("cost"), (s(F.greatest(-F.col("h0"), F.lit(0.0))) * (borrow / 252)).alias("borrow"), s(moved).alias("turnover"), s(F.greatest("h", F.lit(0.0))).alias("long_exp"), s(F.greatest(-F.col("h"), F.lit(0.0))).alias("short_exp"))
    return out.withColumn("net", F.col("gross") - F.col("cost") - F.col("borrow"))


#: Added to the variances, of mean 1: with fewer days than names a covariance is singular, and has no one solution.
RIDGE = 1e-10


def min_variance_weights(cov: np.ndarray, long_only: bool = True) -> np.ndarray:
    """Global minimum-variance weights with sum 1; long-only by an active set: the name of least slope joins, weights
    move towards the minimum over the names held as far as none gets negative, until no slope is below the variance.
    Every step lowers the variance; singular covariances have a solution too."""
    n = len(cov)
    cov = cov / np.mean(np.diag(cov)) + RIDGE * np.eye(n)

    def least(held: np.ndarray) -> np.ndarray:
        x, w = np.linalg.solve(cov[np.ix_(held, held)], np.ones(held.sum())), np.zeros(n)
        w[held] = x / x.sum()
        return w

    if not long_only:
        return least(np.ones(n, bool))
    held = np.arange(n) == np.argmin(np.diag(cov))
    w = held.astype(float)
    for _ in range(10 * n):
        slope = cov @ w
        free = np.where(held, np.inf, slope)
        if free.min() >= w @ slope - 1e-10:
            break
        held[np.argmin(free)] = True
        z = least(held)
        while (out := held & (z <= 0)).any():
            w += np.min(w[out] / np.maximum(w[out] - z[out], 1e-300)) * (z - w)
            held &= w > 1e-14
            w = np.where(held, w, 0) / w[held].sum()
            z = least(held)
        w = z
    return w


def min_variance_book(variance: DataFrame, corr: DataFrame, least: int = 10, long_only: bool = True) -> DataFrame:
    """(date, ticker, w): one small problem a date, names with variance and correlations; fewer than `least`: no rows."""
    side = lambda k: variance.where("variance > 0").select("date", F.col("ticker").alias(k), F.sqrt("variance").alias(f"d{k}"))
    pairs = corr.where("rho is not null").join(side("i"), ["date", "i"]).join(side("j"), ["date", "j"]).select("date", "i", "j", (F.col("rho") * F.col("di") * F.col("dj")).alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.i) | set(pdf.j))
        if len(names) < least:
            return pd.DataFrame({"date": [], "ticker": [], "w": []}, dtype=object)
        at = {n: k for k, n in enumerate(names)}
        c = np.zeros((len(names), len(names)))
        for i, j, v in zip(pdf.i, pdf.j, pdf.c, strict=True):
            c[at[i], at[j]] = c[at[j], at[i]] = v
        return pd.DataFrame({"date": pdf.date.iloc[0], "ticker": names, "w": min_variance_weights(c, long_only)})

    return pairs.groupBy("date").applyInPandas(solve, "date date, ticker string, w double")
