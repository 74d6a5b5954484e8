"""Tests and regressions from sufficient statistics: sums in Spark, small solves per group or on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.special import xlogy
from quantloom.operators.windows import cross_section


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; null without spread (where ANSI arithmetic would raise)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sd = lambda c: F.stddev_pop(F.when(both, F.col(c)))
    return F.covar_pop(x, y) / F.nullif(sd(x) * sd(y), F.lit(0.0))


def ic_series(panel: DataFrame, signal: str, forward: str, least: int = 10, by: str = "date") -> DataFrame:
    """(date, ic): Spearman correlation over names with both values, where there are at least `least`."""
    from quantloom.operators.xsection import pct_rank

    both = panel.where(F.col(signal).isNotNull() & F.col(forward).isNotNull())
    ranked = both.withColumns({"_s": pct_rank(signal, by), "_f": pct_rank(forward, by)})
    return ranked.groupBy(by).agg(safe_corr("_s", "_f").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least).select(by, "ic")


def newey_west(x: DataFrame, col: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean, se, t) with Bartlett weights; lags run over the rows with a value, which are one a date and series."""
    by = by or []
    rows = x.where(F.col(col).isNotNull()).select(*by, order, F.col(col).cast("double").alias("_x"))
    whole = Window.partitionBy(*by)
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_m": F.avg("_x").over(whole)}).withColumn("_e", F.col("_x") - F.col("_m"))
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumns({f"_l{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    n = F.first("_n")
    s = F.sum(F.col("_e") * F.col("_e")) / n
    for k in range(1, lags + 1):
        s = s + F.coalesce(2 * (1 - k / (lags + 1)) * F.sum(f"_l{k}") / n, F.lit(0.0))
    out = rows.groupBy(*by).agg(n.alias("n"), F.first("_m").alias("mean"), F.sqrt(F.greatest(s, F.lit(0.0)) / n).alias("se"))
    few = F.col("n") < 3
    out = out.withColumns({"mean": F.when(~few, F.col("mean")), "se": F.when(~few, F.col("se"))})
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def moments(x: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """(by, n, xx array, xy array, yy): sums of products with a constant first; rows with a null are left out."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    ok = x.dropna(subset=[y, *xs])
    pair = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.array(*pair).alias("xx"), F.array(*(F.sum(c * F.col(y)) for c in cols)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))


def solve_moments(n: float, xx: list[float], xy: list[float]) -> np.ndarray:
    k = len(xy)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = xx
    a = a + np.triu(a, 1).T
    return np.linalg.lstsq(a, np.array(xy), rcond=None)[0]


def grouped_ols(x: DataFrame, y: str, xs: list[str], by: list[str], least: int) -> DataFrame:
    """(by, n, const, each of xs): coefficients of one regression a group, solved from its moments in Arrow batches."""
    m = moments(x, y, xs, by).where(F.col("n") >= least)
    names = ["const", *xs]
    schema = m.select(*by).schema.add("n", "long")
    for c in names:
        schema = schema.add(c, "double")

    def run(batches):
        for pdf in batches:
            b = [solve_moments(r.n, r.xx, r.xy) for r in pdf.itertuples()]
            out = pdf[[*by, "n"]].copy()
            for i, c in enumerate(names):
                out[c] = [v[i] for v in b]
            yield out

    return m.mapInPandas(run, schema)


def fama_macbeth(panel: DataFrame, forward: str, signals: list[str], lags: int, least: int = 15, order: str = "date") -> DataFrame:
    """(signal, n, mean, se, t) of the daily cross-sectional slopes."""
    slopes = grouped_ols(panel, forward, signals, [order], least)
    long = slopes.unpivot([order], ["const", *signals], "signal", "slope")
    return newey_west(long, "slope", order, lags, ["signal"])


def driscoll_kraay(panel: DataFrame, y: str, xs: list[str], lags: int, order: str = "date") -> pd.DataFrame:
    """Pooled OLS (coef, se, t) with standard errors from daily sums of scores.

    Two passes over the panel: pooled moments, then one score vector a date; those (dates x coefficients) come to
    the driver."""
    ok = panel.dropna(subset=[y, *xs])
    m = moments(ok, y, xs, []).first()
    b = solve_moments(m["n"], m["xx"], m["xy"])
    cols = [F.lit(1.0), *(F.col(c) for c in xs)]
    e = F.col(y) - sum((float(v) * c for v, c in zip(b[1:], cols[1:], strict=True)), F.lit(float(b[0])))
    s = ok.groupBy(order).agg(*(F.sum(c * e).alias(f"s{i}") for i, c in enumerate(cols))).orderBy(order).toPandas()
    h = s[[f"s{i}" for i in range(len(cols))]].to_numpy()
    a = np.zeros((len(cols), len(cols)))
    a[np.triu_indices(len(cols))] = m["xx"]
    a = a + np.triu(a, 1).T
    omega = h.T @ h
    for k in range(1, min(lags, len(h) - 1) + 1):
        g = h[k:].T @ h[:-k]
        omega += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(a)
    se = np.sqrt(np.diag(inv @ omega @ inv))
    return pd.DataFrame({"term": ["const", *xs], "coef": b, "se": se, "t": b / se})


def giacomini_white(losses: DataFrame, a: str, b: str, instrument: str, lags: int, order: str = "date") -> DataFrame:
    """(n, stat, p) of T z'W^-1 z for z = (1, instrument) * (a - b): sums of lagged products and a 2 x 2 closed form."""
    d = F.col(a) - F.col(b)
    rows = losses.dropna(subset=[a, b, instrument]).select(order, d.alias("z0"), (d * F.col(instrument)).alias("z1"))
    w = Window.orderBy(order)  # a row a date
    pairs = [("z0", "z0"), ("z0", "z1"), ("z1", "z0"), ("z1", "z1")]
    rows = rows.withColumns({f"g{k}_{i}": F.col(x) * F.lag(y, k).over(w) for k in range(1, lags + 1) for i, (x, y) in enumerate(pairs)})
    n = F.count("*")
    total = lambda i: sum((F.coalesce((1 - k / (lags + 1)) * F.sum(f"g{k}_{i}") / n, F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    s = rows.agg(n.alias("n"), F.avg("z0").alias("m0"), F.avg("z1").alias("m1"), (F.avg(F.col("z0") * F.col("z0")) + 2 * total(0)).alias("s00"), (F.avg(F.col("z0") * F.col("z1")) + total(1) + total(2)).alias("s01"), (F.avg(F.col("z1") * F.col("z1")) + 2 * total(3)).alias("s11"))
    det = F.col("s00") * F.col("s11") - F.col("s01") * F.col("s01")
    stat = F.col("n") * (F.col("m0") * F.col("m0") * F.col("s11") - 2 * F.col("m0") * F.col("m1") * F.col("s01") + F.col("m1") * F.col("m1") * F.col("s00")) / F.nullif(det, F.lit(0.0))
    return s.select("n", stat.alias("stat"), F.exp(-stat / 2).alias("p"))


def kupiec_lr(n: Column, x: Column, alpha: float) -> Column:
    p = x / F.nullif(n, F.lit(0))
    ll0 = xlogy(n - x, F.lit(1 - alpha)) + xlogy(x, F.lit(alpha))
    return -2 * (ll0 - (xlogy(n - x, 1 - p) + xlogy(x, p)))


def coverage(hits: DataFrame, alpha: float, by: list[str], order: str = "date") -> DataFrame:
    """(by, n, hits, rate, lr_uc, lr_ind, lr_cc) of a 0/1 column `hit`, null where there is no test."""
    w = Window.partitionBy(*by).orderBy(order)
    h = hits.where("hit is not null").withColumn("_a", F.lag("hit").over(w))
    c = lambda a, b: F.sum(((F.col("_a") == a) & (F.col("hit") == b)).cast("long")).alias(f"n{a}{b}")
    g = h.groupBy(*by).agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"), c(0, 0), c(0, 1), c(1, 0), c(1, 1))
    n00, n01, n10, n11 = (F.coalesce(f"n{k}", F.lit(0)) for k in ("00", "01", "10", "11"))
    p01, p11 = n01 / F.greatest(n00 + n01, F.lit(1)), n11 / F.greatest(n10 + n11, F.lit(1))
    p = (n01 + n11) / F.greatest(n00 + n01 + n10 + n11, F.lit(1))
    ind = -2 * (xlogy(n00 + n10, 1 - p) + xlogy(n01 + n11, p) - (xlogy(n00, 1 - p01) + xlogy(n01, p01) + xlogy(n10, 1 - p11) + xlogy(n11, p11)))
    uc = kupiec_lr(F.col("n"), F.col("hits"), alpha)
    return g.select(*by, "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), uc.alias("lr_uc"), ind.alias("lr_ind"), (uc + ind).alias("lr_cc"))


def acerbi_szekely(y: Column, var: Column, es: Column, alpha: float) -> Column:
    """Aggregate: sum of y below var over T*alpha*(-es), plus 1."""
    ok = y.isNotNull() & var.isNotNull() & (es < 0)
    return F.sum(F.when(ok, F.when(y < var, y).otherwise(0.0) / (alpha * -es))) / F.count(F.when(ok, 1)) + 1


def benjamini_hochberg(df: DataFrame, p: str, seq: str, out: str, by: list[str] | None = None) -> DataFrame:
    """out: p adjusted within `by`; null p are left out of the family; equal p in the order of seq."""
    fam = [*(by or []), F.col(p).isNull()]
    up = Window.partitionBy(*fam).orderBy(p, seq)
    m, i = F.count(p).over(Window.partitionBy(*fam)), F.row_number().over(up)
    step = df.withColumn("_q", F.col(p) * m / i)
    low = F.min("_q").over(up.rowsBetween(0, Window.unboundedFollowing))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), F.least(low, F.lit(1.0)))).drop("_q")


def holm(df: DataFrame, p: str, seq: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """df with `rejected`: p in ascending order are rejected until the first above alpha/(m-i+1)."""
    up = Window.partitionBy(*(by or [])).orderBy(F.col(p).asc_nulls_last(), seq)
    m, i = F.count("*").over(Window.partitionBy(*(by or []))), F.row_number().over(up)
    step = df.withColumn("_ok", F.coalesce(F.col(p) <= alpha / (m - i + 1), F.lit(False)))
    return step.withColumn("rejected", F.every("_ok").over(up.rowsBetween(Window.unboundedPreceding, 0))).drop("_ok")


def performance(returns: DataFrame, by: list[str], r: str = "r", rf: str | None = None, order: str = "date", periods: int = 252) -> DataFrame:
    """(by, n, ann_ret, ann_vol, sharpe, sortino, max_dd, cvar5, skew, kurt) of daily simple returns.

    All but the drawdown are of the excess over rf; skew and kurtosis are of the population, the latter not in excess."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = returns.where(F.col(r).isNotNull()).withColumn("_x", F.col(r) - (F.coalesce(rf, F.lit(0.0)) if rf else 0.0))
    x = x.withColumn("_eq", F.exp(F.sum(F.log1p(r)).over(w))).withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    x = x.withColumn("_q", F.percentile("_x", F.lit(0.05)).over(Window.partitionBy(*by)))
    mean, sd, root = F.avg("_x"), F.stddev_samp("_x"), periods**0.5
    down = F.stddev_samp(F.when(F.col("_x") < 0, F.col("_x")))
    return x.groupBy(*by).agg(F.count("*").alias("n"), (mean * periods).alias("ann_ret"), (sd * root).alias("ann_vol"), F.when(sd > 0, mean / sd * root).alias("sharpe"), F.when(down > 0, mean / down * root).alias("sortino"), F.min("_dd").alias("max_dd"), F.avg(F.when(F.col("_x") <= F.col("_q"), F.col("_x"))).alias("cvar5"), F.skewness("_x").alias("skew"), (F.kurtosis("_x") + 3).alias("kurt"))


def performance_fee(pairs: DataFrame, a: str, b: str, gamma: float, periods: float) -> DataFrame:
    """(n, delta, fee_bps): the fee that makes a's mean quadratic utility equal b's; the root nearest to 0."""
    k = gamma / (2 * (1 + gamma))
    wa, wb = 1 + F.col(a), 1 + F.col(b)
    s = pairs.dropna(subset=[a, b]).agg(F.count("*").alias("n"), F.avg(wa).alias("ma"), F.avg(wa * wa).alias("ma2"), F.avg(wb - k * wb * wb).alias("ub"))
    lin, const = 2 * k * F.col("ma") - 1, F.col("ma") - k * F.col("ma2") - F.col("ub")
    disc = lin * lin + 4 * k * const
    # the root nearest to 0, in the form without cancellation
    delta = F.when(disc >= 0, 2 * const / (-lin + F.signum(-lin) * F.sqrt(F.greatest(disc, F.lit(0.0)))))
    return s.select("n", delta.alias("delta"), (delta * periods * 1e4).alias("fee_bps"))


def hedge_effectiveness(unhedged: str, hedged: str) -> Column:
    both = F.col(unhedged).isNotNull() & F.col(hedged).isNotNull()
    return 1 - F.var_pop(F.when(both, F.col(hedged))) / F.var_pop(F.when(both, F.col(unhedged)))


def block_bootstrap(x: DataFrame, cols: list[str], order: str, fn, replicates: int = 200, block: int = 10, seed: int = 0) -> DataFrame:
    """(replicate, value): fn(array) of stationary block resamples of a daily series.

    The series (a row a date) is one broadcast array; replicates are spread over tasks, each with a seed of its own."""
    spark = x.sparkSession
    a = spark.sparkContext.broadcast(x.dropna(subset=cols).orderBy(order).select(*cols).toPandas().to_numpy(float))

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                rng, n = np.random.default_rng([seed, int(k)]), len(a.value)
                new = rng.random(n) < 1 / block
                new[0] = True
                start = rng.integers(0, n, n)
                last = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                out.append(float(fn(a.value[(start[last] + np.arange(n) - last) % n])))
            yield pd.DataFrame({"replicate": pdf["id"], "value": out})

    return spark.range(replicates).mapInPandas(run, "replicate long, value double")


def permutation_ic(panel: DataFrame, signal: str, forward: str, n: int, seed: int = 0, least: int = 10) -> DataFrame:
    """(trial, ic): mean daily IC of signals shuffled within each date, n times.

    Shuffled ranks need no signal, only how many names a date has; a month's dates make their n shuffles in one
    group, which returns n partial sums, so that no row is repeated n times."""
    from quantloom.operators.xsection import pct_rank

    both = panel.where(F.col(signal).isNotNull() & F.col(forward).isNotNull()).select("date", forward)
    ranked = both.withColumn("f", pct_rank(forward)).select("date", "f", F.trunc("date", "month").alias("_month"))

    def shuffle(pdf: pd.DataFrame) -> pd.DataFrame:
        total, days = np.zeros(n), np.zeros(n, int)
        for day, g in pdf.groupby("date"):
            f = np.sort(g["f"].to_numpy(float))
            if len(f) < least or f[0] == f[-1]:
                continue
            f = (f - f.mean()) / f.std()
            a = np.random.default_rng([seed, day.toordinal()]).permuted(np.tile(np.arange(len(f), dtype=float), (n, 1)), axis=1)
            total += (a - a.mean(1, keepdims=True)) @ f / (len(f) * a[0].std())
            days += 1
        return pd.DataFrame({"trial": np.arange(n), "s": total, "n": days})

    sums = ranked.groupBy("_month").applyInPandas(shuffle, "trial long, s double, n long")
    return sums.groupBy("trial").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("ic"))


def block_permute(panel: DataFrame, block: int, seed: int = 0) -> DataFrame:
    """panel (pos, ...) with whole blocks of rows in shuffled order; the incomplete last block is dropped."""
    n = panel.agg(F.max("pos")).first()[0] + 1
    blocks = panel.select(F.expr(f"pos div {block}").alias("_b")).distinct().where(F.col("_b") < n // block)
    new = blocks.withColumn("_k", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "_b"))) - 1)
    out = panel.withColumn("_b", F.expr(f"pos div {block}")).join(F.broadcast(new), "_b")
    return out.withColumn("pos", F.col("_k") * block + F.expr(f"pos % {block}")).drop("_b", "_k")


def demean(x: str, by: str = "date") -> Column:
    return F.col(x) - F.avg(x).over(cross_section(by))
