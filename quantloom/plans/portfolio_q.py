"""Books, overlays and back-tests; the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import panel as pn, portfolio as pf
from quantloom.operators import windows as wn
from quantloom.operators import xsection as xs
from quantloom.plans.base import DENSE, panel, query, r, w


def low_vol_book(spark, d, history: int, least: int, floor: int):
    """Equal weights of the calmest fifth of the eligible names, from prices to weights."""
    p = panel(spark, d)
    p = p.withColumns({"vol": -wn.rolling_std(F.col("ret"), 60, least), "ok": pn.eligible(history=history)})
    p = p.withColumn("sig", F.when(F.col("ok"), F.col("vol"))).withColumn("pr", xs.pct_rank("sig"))
    n = F.count("sig").over(wn.cross_section())
    return p.withColumn("wt", F.when(n >= floor, xs.top_quantile("pr", 0.2)).otherwise(0.0))


def flagship(spark, d):
    return low_vol_book(spark, d, 20, 10, 5).where("wt > 0").select("date", "ticker", r("sig").alias("signal"), r("pr").alias("rank"), r("wt").alias("weight"))


SIG = f"el as (select *, coalesce(count(ret) over (partition by ticker order by date rows unbounded preceding) >= 250 and case when count(value) over {w(60)} >= 30 then quantile_cont(value, 0.5) over {w(60)} end >= 0 and not stale and close is not null, false) as ok, case when count(ret) over {w(60)} >= 40 then -stddev_samp(ret) over {w(60)} end as vol from p), s0 as (select *, case when ok then vol end as sig from el), rs as (select *, case when sig is not null then (rank() over (partition by date order by sig nulls last) + (count(sig) over (partition by date, sig) - 1) / 2.0::double) / count(sig) over (partition by date) end as pr, count(sig) over (partition by date) as nn from s0)"


@query("with " + DENSE + ", " + SIG + ", k as (select *, sum(case when pr > 0.8 then 1 else 0 end) over (partition by date) as c from rs) select date, ticker, round(sig, 6) as signal, round(pr, 6) as rank, round(1.0::double / c, 6) as weight from k where nn >= 10 and pr > 0.8")
def t05_low_vol_top_quintile(spark, d):
    b = low_vol_book(spark, d, 250, 40, 10).where("wt > 0")
    return b.select("date", "ticker", r("sig").alias("signal"), r("pr").alias("rank"), r("wt").alias("weight"))


RK = "rr as (select date, ticker, ret, case when ret is not null then (rank() over (partition by date order by ret nulls last) + (count(ret) over (partition by date, ret) - 1) / 2.0::double) / count(ret) over (partition by date) end as pr from p), zz as (select *, pr - avg(pr) over (partition by date) as z, count(pr) over (partition by date) as n from rr), bk as (select date, ticker, case when n >= 10 and z is not null then z / sum(abs(z)) over (partition by date) else 0 end as w from zz)"


@query("with " + DENSE + ", " + RK + " select date, ticker, round(w, 9) as w from bk")
def b01_long_short_rank(spark, d):
    p = panel(spark, d).withColumn("pr", xs.pct_rank("ret"))
    return p.select("date", "ticker", r(xs.long_short("pr"), 9).alias("w"))


@query("with " + DENSE + ", " + RK + f", bt as (select date, ticker, case when count(ret) over {w(60)} >= 20 then stddev_samp(ret) over {w(60)} end as beta from p), jj as (select rr.date, ticker, case when beta is not null then pr end as z, case when pr is not null then beta end as b from rr join bt using (date, ticker)), rg as (select *, z - (regr_intercept(z, b) over (partition by date) + regr_slope(z, b) over (partition by date) * b) as e, count(case when z is not null and b is not null then 1 end) over (partition by date) as n from jj) select date, ticker, case when n >= 10 and e is not null then round(e / sum(abs(e)) over (partition by date), 5) else 0 end as w from rg")
def b01_beta_neutral(spark, d):
    """Ranks less their regression on an exposure (here each name's volatility)."""
    p = panel(spark, d).withColumns({"pr": xs.pct_rank("ret"), "beta": wn.rolling_std(F.col("ret"), 60, 20)})
    return p.select("date", "ticker", r(xs.long_short("pr", "beta"), 5).alias("w"))


@query("with " + DENSE + f", v as (select date, ticker, not stale and close is not null as ok, case when count(ret) over {w(20)} >= 10 then var_samp(ret) over {w(20)} end as v from p) select date, ticker, case when ok then round(1.0::double / sum(case when ok then 1 else 0 end) over (partition by date), 6) else 0 end as eq, round(case when v > 0 then 1 / sqrt(v) end / sum(case when v > 0 then 1 / sqrt(v) end) over (partition by date), 6) as iv from v")
def b02_b03_equal_and_inverse_vol(spark, d):
    p = panel(spark, d)
    p = p.withColumns({"ok": ~F.col("stale") & F.col("close").isNotNull(), "v": wn.gated(F.var_samp("ret"), F.col("ret"), wn.trailing(20), 10)})
    return p.select("date", "ticker", r(xs.equal_weight(F.col("ok"))).alias("eq"), r(xs.inverse_vol("v")).alias("iv"))


BT = """dy as (select date, row_number() over (order by date) - 1 as i from (select distinct date from p)), gd as (select p.ticker, i, p.date, coalesce(exp(p.ret) - 1, 0) as R from p join dy using (date)),
tg as (select ticker, i + 1 as i, w from bk join dy using (date)), hs as (select i, max(case when w is not null then 1 else 0 end) as book from tg group by 1),
rw as (select gd.*, tg.w, coalesce(book, 0) as book, k from gd left join tg using (ticker, i) left join hs using (i) cross join range(5) t(k)),
tr as (select *, i % 5 = k and book = 1 as trade, sum(ln(1 + R)) over (partition by ticker, k order by i) as g from rw),
sg as (select *, max(case when trade then i end) over (partition by ticker, k order by i rows between unbounded preceding and 1 preceding) as at from tr),
ps as (select a.*, coalesce(b.w, 0) * exp(a.g - ln(1 + a.R) - b.g) as h0 from sg a left join tr b on a.ticker = b.ticker and a.k = b.k and a.at = b.i),
pp as (select *, coalesce(h0, 0) as h, coalesce(h0, 0) * (1 + R) as h1 from ps)"""


@query("with " + DENSE + ", " + RK + ", " + BT + " select date, round(sum(h * R) / 5, 6) as gross, round(sum(case when trade then abs(coalesce(w, 0) - h1) else 0 end) / 5, 6) as turnover, round(sum(case when trade then greatest(coalesce(w, 0), 0) else greatest(h1, 0) end) / 5, 6) as long_exp from pp group by 1")
def b05_g25_backtest(spark, d):
    p = panel(spark, d).withColumn("pr", xs.pct_rank("ret"))
    book = p.select("date", "ticker", xs.long_short("pr").alias("w"))
    out = pf.backtest(book, p.select("date", "ticker", F.expm1("ret").alias("R")), 1, 5, 10.0, 0.1)
    return out.select("date", r("gross").alias("gross"), r("turnover").alias("turnover"), r("long_exp").alias("long_exp"))


@query("with " + DENSE + ", " + RK + ", " + BT + ", dd as (select date, sum(h * R) / 5 as gross, sum(case when trade then abs(coalesce(w, 0) - h1) else 0 end) / 5 as turnover from pp group by 1) select round(avg(gross) / avg(turnover) * 10000, 2) as breakeven_bps from dd")
def r23_cost_breakeven(spark, d):
    p = panel(spark, d).withColumn("pr", xs.pct_rank("ret"))
    book = p.select("date", "ticker", xs.long_short("pr").alias("w"))
    out = pf.backtest(book, p.select("date", "ticker", F.expm1("ret").alias("R")))
    return out.agg(r(F.avg("gross") / F.avg("turnover") * 10000, 2).alias("breakeven_bps"))


@query()
def b04_w27_vol_target_overlay(spark, d):
    """An equal book of all names scaled by recursive correlations."""
    p = panel(spark, d)
    book = p.select("date", "ticker", (1 / F.count("*").over(wn.cross_section())).alias("w"))
    v = p.select("date", "ticker", (5 * wn.gated(F.var_samp("ret"), F.col("ret"), wn.trailing(20), 5)).alias("variance"))
    return pf.vol_target_overlay(book, v, pf.ewma_pairs(p, least=10), 5)


@query()
def b06_b08_min_variance(spark, d):
    p = panel(spark, d)
    v = p.select("date", "ticker", wn.gated(F.var_samp("ret"), F.col("ret"), wn.trailing(20), 5).alias("variance"))
    return pf.min_variance_book(v, pf.ewma_pairs(p, least=10), least=3)


@query("with " + DENSE + f", a as (select date, ticker, ret, avg(ret) over (partition by date) as m from p), b as (select *, case when count(ret) over {w(60)} >= 20 then covar_samp(ret, m) over {w(60)} / nullif(var_samp(m) over {w(60)}, 0) end as h from a) select date, ticker, round(h, 5) as hedge, round(ret - lag(h) over (partition by ticker order by date) * m, 5) as hedged from b")
def b10_hedged_returns(spark, d):
    t = wn.trailing(60)
    p = panel(spark, d).withColumn("m", F.avg("ret").over(wn.cross_section()))
    h = F.when(F.count("ret").over(t) >= 20, F.covar_samp("ret", "m").over(t) / F.nullif(F.stddev_samp("m").over(t) * F.stddev_samp("m").over(t), F.lit(0.0)))
    p = p.withColumn("h", h)
    return p.select("date", "ticker", r("h", 5).alias("hedge"), r(F.col("ret") - F.lag("h").over(wn.series()) * F.col("m"), 5).alias("hedged"))
