"""Rolling, expanding, recursive and cross-sectional windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import panel as pn
from quantloom.operators import windows as wn
from quantloom.operators import xsection as xs
from quantloom.plans.base import DENSE, PX, panel, prices, query, r, w

MK = "mk as (select date, avg(ret) as m, count(ret) as n from p group by 1)"


def gate(agg: str, x: str, n: int, least: int, lag: int = 0, d: int = 6) -> str:
    return f"case when count({x}) over {w(n, lag)} >= {least} then round({agg} over {w(n, lag)}, {d}) end"


@query("with " + DENSE + f" select date, ticker, round(ret, 6) as ret, {gate('sum(ret)', 'ret', 231, 200, 21)} as mom_12_1, {gate('-sum(ret)', 'ret', 5, 5)} as rev_5d, round(-ret, 6) as rev_1d, {gate('-stddev_samp(ret)', 'ret', 60, 40)} as lowvol from p")
def w01_w05_w07_classic_signals(spark, d):
    x = F.col("ret")
    p = panel(spark, d)
    return p.select("date", "ticker", r(x).alias("ret"), r(wn.rolling_sum(x, 231, 200, lag=21)).alias("mom_12_1"), r(-wn.rolling_sum(x, 5, 5)).alias("rev_5d"), r(-x).alias("rev_1d"), r(-wn.rolling_std(x, 60, 40)).alias("lowvol"))


@query("with " + PX + ", n as (select date, count(close) as prints from px group by 1), m as (select *, quantile_cont(prints, 0.5) over (order by date rows between 10 preceding and 10 following) as typical from n) select px.date, ticker, close from px join m using (date) where prints >= 0.7 * typical")
def w03_thin_days(spark, d):
    return pn.drop_thin_days(prices(spark, d), 0.7).select("date", "ticker", "close")


@query("with " + DENSE + f" select date, ticker, coalesce(count(ret) over (partition by ticker order by date rows unbounded preceding) >= 250 and case when count(value) over {w(60)} >= 30 then quantile_cont(value, 0.5) over {w(60)} end >= 1000000 and not stale and close is not null, false) as eligible from p")
def w04_pit_universe(spark, d):
    return panel(spark, d).select("date", "ticker", pn.eligible(floor=1_000_000).alias("eligible"))


@query("with " + DENSE + f" select date, ticker, case when count(value) over {w(60)} >= 30 and quantile_cont(value, 0.5) over {w(60)} > 0 then round(ln(quantile_cont(value, 0.5) over {w(60)}), 6) end as size from p")
def w08_size(spark, d):
    m = wn.rolling_quantile(F.col("value"), 0.5, 60, 30)
    return panel(spark, d).withColumn("m", m).select("date", "ticker", r(F.when(F.col("m") > 0, F.ln("m"))).alias("size"))


@query("with " + DENSE + f""", q as (select *, lag(ret) over (partition by ticker order by date) as l from p),
z as (select *, ret * l as rl, avg(ret) over {w(250)} as mu, avg(l) over {w(250)} as ml, count(ret) over {w(250)} as n, var_pop(ret) over {w(250)} as v from q),
y as (select *, avg(rl) over {w(250)} - mu * ml as cv from z), u as (select *, greatest(least(cv / nullif(v, 0), 0.99), -0.99) as phi from y)
select date, ticker, case when n >= 120 then round(phi, 6) end as phi, case when n >= 120 then round(5 * mu + (phi + phi * phi + phi ** 3 + phi ** 4 + phi ** 5) * (ret - mu), 6) end as ar1 from u""")
def w09_ar1(spark, d):
    p = panel(spark, d).withColumn("l", F.lag("ret").over(wn.series())).withColumn("rl", F.col("ret") * F.col("l"))
    t = wn.trailing(250)
    p = p.withColumns({"mu": F.avg("ret").over(t), "n": F.count("ret").over(t), "cv": F.avg("rl").over(t) - F.avg("ret").over(t) * F.avg("l").over(t), "v": F.var_pop("ret").over(t)})
    p = p.withColumn("phi", F.greatest(F.least(F.col("cv") / F.nullif("v", F.lit(0.0)), F.lit(0.99)), F.lit(-0.99)))
    powers = sum((F.pow("phi", F.lit(k)) for k in range(2, 6)), F.col("phi"))
    ok = F.col("n") >= 120
    return p.select("date", "ticker", F.when(ok, r("phi")).alias("phi"), F.when(ok, r(5 * F.col("mu") + powers * (F.col("ret") - F.col("mu")))).alias("ar1"))


@query("with " + DENSE + f" select date, ticker, {gate('var_samp(ret)', 'ret', 20, 20, d=8)} as v20, {gate('avg(ret * ret)', 'ret', 5, 5, d=8)} as har_w, {gate('avg(ret * ret)', 'ret', 22, 22, d=8)} as har_m, {gate('sum(ret)', 'ret', 5, 5)} as block5 from p")
def w10_w12_w37_vol_and_blocks(spark, d):
    x, sq = F.col("ret"), F.col("ret") * F.col("ret")
    return panel(spark, d).select("date", "ticker", r(wn.gated(F.var_samp(x), x, wn.trailing(20), 20), 8).alias("v20"), r(wn.rolling_mean(sq, 5, 5), 8).alias("har_w"), r(wn.rolling_mean(sq, 22, 22), 8).alias("har_m"), r(wn.rolling_sum(x, 5, 5)).alias("block5"))


def ewm_sql(src: str, x: str, keep: str) -> str:
    """ew: src with s, the recursive mean of x from its first value, as a scaled running sum; i counts the values."""
    scaled = f"case when i = 1 then {x} else {x} * (1 - {keep}) * pow({keep}, 1 - i) end"
    return f"ew0 as (select *, count({x}) over (partition by ticker order by date rows unbounded preceding) as i from {src}), ew as (select *, pow({keep}, i - 1) * sum({scaled}) over (partition by ticker order by date rows unbounded preceding) as s from ew0)"


@query("with " + DENSE + ", q as (select *, ret * ret as x from p), " + ewm_sql("q", "x", "0.94::double") + " select date, ticker, case when i >= 20 then round(s, 9) end as ewma from ew")
def w11_vol_ewma(spark, d):
    p = panel(spark, d).select("date", "ticker", (F.col("ret") * F.col("ret")).alias("x"))
    return wn.ewm(p, "x", "ewma", 0.94, 20).select("date", "ticker", r("ewma", 9).alias("ewma"))


@query("with " + DENSE + ", " + MK + f", v as (select *, case when count(m) over (order by date rows between 249 preceding and current row) >= 120 then var_samp(m) over (order by date rows between 249 preceding and current row) end as vm from mk), j as (select p.*, m, vm from p join v using (date)) select date, ticker, case when count(ret * m) over {w(250)} >= 120 then round(covar_samp(ret, m) over {w(250)} / nullif(vm, 0), 6) end as beta from j")
def w13_trailing_betas(spark, d):
    """Pairwise covariance over the variance of the whole market series (one row a date)."""
    p = panel(spark, d)
    m = p.groupBy("date").agg(F.avg("ret").alias("m"))
    wm = Window.orderBy("date").rowsBetween(-249, 0)
    m = m.withColumn("vm", F.when(F.count("m").over(wm) >= 120, F.var_samp("m").over(wm)))
    j = p.join(m, "date")
    return j.select("date", "ticker", r(wn.gated(F.covar_samp("ret", "m"), F.col("ret") * F.col("m"), wn.trailing(250), 120) / F.nullif("vm", F.lit(0.0))).alias("beta"))


RANK = "rk as (select *, case when ret is not null then (rank() over (partition by date order by ret nulls last) + (count(ret) over (partition by date, ret) - 1) / 2.0::double) / count(ret) over (partition by date) end as pr from p)"


@query("with " + DENSE + ", " + RANK + " select date, ticker, round(pr, 6) as pr, round(coalesce((pr - avg(pr) over (partition by date)) / nullif(stddev_samp(pr) over (partition by date), 0), pr * 0), 6) as z from rk")
def w14_w15_rank_standardize(spark, d):
    p = panel(spark, d).withColumn("pr", xs.pct_rank("ret"))
    return p.select("date", "ticker", r("pr").alias("pr"), r(xs.standardized("pr")).alias("z"))


@query("with " + DENSE + " select date, ticker, case when count(ret) over x > 2 then round(ret - (sum(ret) over x - ret) / greatest(count(ret) over x - 1, 1), 6) end as res from p window x as (partition by date)")
def w16_w17_loo_residual(spark, d):
    return panel(spark, d).select("date", "ticker", r(xs.leave_one_out("ret")).alias("res"))


@query("with " + DENSE + f" select date, ticker, {gate('skewness(ret)', 'ret', 60, 30, d=5)} as skew, {gate('kurtosis(ret)', 'ret', 60, 30, d=4)} as kurt, {gate('max(ret)', 'ret', 20, 10)} as hi, {gate('min(ret)', 'ret', 20, 10)} as lo, {gate('avg(ret)', 'ret', 5, 3)} as m5, {gate('stddev_samp(ret)', 'ret', 20, 10)} as s20 from p")
def w18_context_features(spark, d):
    x, t = F.col("ret"), wn.trailing(20)
    return panel(spark, d).select("date", "ticker", r(wn.rolling_skew(x, 60, 30), 5).alias("skew"), r(wn.rolling_kurt(x, 60, 30), 4).alias("kurt"), r(wn.gated(F.max(x), x, t, 10)).alias("hi"), r(wn.gated(F.min(x), x, t, 10)).alias("lo"), r(wn.rolling_mean(x, 5, 3)).alias("m5"), r(wn.rolling_std(x, 20, 10)).alias("s20"))


@query("with " + DENSE + ", q as (select *, ln(1 + value) - lag(ln(1 + value)) over (partition by ticker order by date) as dv from p), g as (select q.*, n_regionkey as sector from q join nation on ticker = n_name)" + f" select date, ticker, {gate('avg(dv)', 'dv', 20, 10)} as dv20, round(avg(ret) over (partition by date, sector), 6) as sector_mean from g")
def w19_f27_covariate_features(spark, d):
    from quantloom.plans.base import table

    n = table(spark, d, "nation").select(F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("sector"))
    p = panel(spark, d).withColumn("dv", F.log1p("value") - F.lag(F.log1p("value")).over(wn.series())).join(F.broadcast(n), "ticker")
    return p.select("date", "ticker", r(wn.rolling_mean(F.col("dv"), 20, 10)).alias("dv20"), r(F.avg("ret").over(wn.cross_section(["date", "sector"]))).alias("sector_mean"))


@query("with " + DENSE + f", f as (select *, avg(ret * ret) over {w(22)} as fc, lead(ret) over (partition by ticker order by date) as nx from p), x as (select date, avg(case when fc > 0 and nx <> 0 then nx * nx / fc end) as ratio from f group by 1) select date, case when count(ratio) over v >= 60 then round(quantile_cont(ratio, 0.5) over v, 6) end as scale from x window v as (order by date rows between 250 preceding and 1 preceding)")
def w20_rolling_vol_scale(spark, d):
    p = panel(spark, d).withColumns({"fc": F.avg(F.col("ret") * F.col("ret")).over(wn.trailing(22)), "nx": F.lead("ret").over(wn.series())})
    x = p.groupBy("date").agg(F.avg(F.when((F.col("fc") > 0) & (F.col("nx") != 0), F.col("nx") * F.col("nx") / F.col("fc"))).alias("ratio"))
    v = Window.orderBy("date").rowsBetween(-250, -1)  # a row a date
    return x.select("date", r(wn.gated(F.percentile("ratio", F.lit(0.5)), F.col("ratio"), v, 60)).alias("scale"))


@query("with " + DENSE + ", " + RANK + ", z as (select *, coalesce((pr - avg(pr) over (partition by date)) / nullif(stddev_samp(pr) over (partition by date), 0), pr * 0) as z from rk), " + ewm_sql("z", "z", "pow(0.5::double, 0.2::double)") + " select date, ticker, round(s, 6) as smooth from ew where i > 0")
def w22_smooth_signal(spark, d):
    p = panel(spark, d).withColumn("pr", xs.pct_rank("ret")).withColumn("z", xs.standardized("pr"))
    s = wn.ewm(p.select("date", "ticker", "z"), "z", "smooth", 0.5 ** (1 / 5))
    return s.where("smooth is not null").select("date", "ticker", r("smooth").alias("smooth"))


STRESS = "lr as (select date, avg(ln(greatest(ret * ret, 1e-10::double))) as m from p where ret is not null group by 1), s5 as (select date, case when count(m) over v >= 5 then avg(m) over v end as s from lr window v as (order by date rows between 4 preceding and current row)), th as (select *, case when count(s) over v >= 120 then quantile_cont(s, 0.9) over v end as thr from s5 window v as (order by date rows between 250 preceding and 1 preceding))"


@query("with " + DENSE + ", " + STRESS + " select date, case when s is null or thr is null then null when s > thr then 1 else 0 end as stress from th")
def w23_stress_indicator(spark, d):
    p = panel(spark, d).where("ret is not null").groupBy("date").agg(F.avg(F.ln(F.greatest(F.col("ret") * F.col("ret"), F.lit(1e-10)))).alias("m"))
    o = Window.orderBy("date")  # a row a date
    p = p.withColumn("s", wn.gated(F.avg("m"), F.col("m"), o.rowsBetween(-4, 0), 5))
    p = p.withColumn("thr", wn.gated(F.percentile("s", F.lit(0.9)), F.col("s"), o.rowsBetween(-250, -1), 120))
    known = F.col("s").isNotNull() & F.col("thr").isNotNull()
    return p.select("date", F.when(known, (F.col("s") > F.col("thr")).cast("int")).alias("stress"))


@query("with " + DENSE + f", h as (select *, case when count(ret) over {w(250, 1)} >= 100 and ret is not null then case when ret < quantile_cont(ret, 0.01) over {w(250, 1)} then 1 else 0 end end as hit from p), n as (select *, case when count(hit) over {w(250)} = 250 then sum(hit) over {w(250)} end as k from h where date >= date '1996-01-01') select date, ticker, cast(k as bigint) as exceptions, case when k is null then null when k <= 4 then 'green' when k <= 9 then 'yellow' else 'red' end as zone from n")
def w24_basel_traffic_light(spark, d):
    p = panel(spark, d)
    q = wn.rolling_quantile(F.col("ret"), 0.01, 250, 100, lag=1)
    h = p.withColumn("q", q).withColumn("hit", F.when(F.col("q").isNotNull() & F.col("ret").isNotNull(), (F.col("ret") < F.col("q")).cast("int"))).where("date >= date'1996-01-01'")
    k = wn.rolling_sum(F.col("hit"), 250, 250)
    return h.withColumn("exceptions", k).select("date", "ticker", "exceptions", F.when(F.col("exceptions") <= 4, "green").when(F.col("exceptions") <= 9, "yellow").when(F.col("exceptions") > 9, "red").alias("zone"))


@query("with " + DENSE + f", q as (select *, case when count(ret) over {w(250)} >= 100 then quantile_cont(ret, 0.05) over {w(250)} end as v, list(ret) filter (ret is not null) over {w(250)} as l from p) select date, ticker, round(v, 6) as var, round(list_avg(list_filter(l, lambda x: x <= v)), 6) as es from q where v is not null")
def w25_hs_var_es(spark, d):
    p = panel(spark, d).withColumns({"v": wn.rolling_quantile(F.col("ret"), 0.05, 250, 100), "l": F.collect_list("ret").over(wn.trailing(250))}).where("v is not null")
    tail = F.filter("l", lambda x: x <= F.col("v"))
    return p.select("date", "ticker", r("v").alias("var"), r(F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)).alias("es"))


@query("with " + DENSE + ", " + MK + ", j as (select p.date, ticker, ret, m, row_number() over (partition by ticker order by date) as i from p join mk using (date) where ret is not null and m is not null), s as (select date, ticker, i, sum(ret * m * pow(0.97::double, -i)) over u as xy, sum(ret * ret * pow(0.97::double, -i)) over u as xx, sum(m * m * pow(0.97::double, -i)) over u as yy from j window u as (partition by ticker order by date rows unbounded preceding)) select date, ticker, round(xy / sqrt(xx * yy), 6) as rho from s where i >= 60")
def w26_ewma_corr(spark, d):
    p = panel(spark, d)
    m = p.groupBy("date").agg(F.avg("ret").alias("m"))
    j = p.join(m, "date").where("ret is not null and m is not null")
    j = j.select("date", "ticker", (F.col("ret") * F.col("m")).alias("xy"), (F.col("ret") * F.col("ret")).alias("xx"), (F.col("m") * F.col("m")).alias("yy"))
    j = wn.ewm(j, ["xy", "xx", "yy"], ["sxy", "sxx", "syy"], 0.97, 60, seed=0.0)
    return j.where("sxy is not null").select("date", "ticker", r(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("rho"))


@query("with " + DENSE + f" select date, ticker, coalesce(abs(ret) > 2 * case when count(ret) over {w(60, 1)} >= 20 then stddev_samp(ret) over {w(60, 1)} end, false) as event from p")
def w28_leader_events(spark, d):
    sd = wn.rolling_std(F.col("ret"), 60, 20, lag=1)
    return panel(spark, d).select("date", "ticker", F.coalesce(F.abs("ret") > 2 * sd, F.lit(False)).alias("event"))


@query("with x as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as step from events) select user_id, event_id, cast(step as int) as step from x")
def w31_step_index(spark, d):
    from quantloom.plans.base import table

    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))


@query("with " + DENSE + f", x as (select *, case when count(value) over {w(60)} >= 30 then quantile_cont(value, 0.5) over {w(60)} end as typical from p), y as (select *, quantile_cont(typical, 0.5) over (partition by date) as mid, case when abs(ret) > 0.5 then 1 else 0 end as shock from x) select date, ticker, cast(typical >= mid as int) as liquid, max(shock) over {w(20)} as shocked, round(lead(ln(close), 5) over (partition by ticker order by date) - ln(close), 6) as after from y")
def w36_w38_liquidity_and_shocks(spark, d):
    p = panel(spark, d).withColumn("typical", wn.rolling_quantile(F.col("value"), 0.5, 60, 30)).withColumn("shock", F.coalesce((F.abs("ret") > 0.5).cast("int"), F.lit(0)))
    mid = F.percentile("typical", F.lit(0.5)).over(wn.cross_section())
    return p.select("date", "ticker", (F.col("typical") >= mid).cast("int").alias("liquid"), F.max("shock").over(wn.trailing(20)).alias("shocked"), r(F.lead(F.ln("close"), 5).over(wn.series()) - F.ln("close")).alias("after"))
