"""Causal models over the panel. Iterative and matrix fits are beyond SQL: tests hold them against loops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import models as md
from quantloom.operators import windows as wn
from quantloom.plans.base import DENSE, panel, query, r, w


def positions(spark, d):
    p = panel(spark, d).withColumn("sq", F.col("ret") * F.col("ret"))
    pos = p.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # a row a date
    return p.join(F.broadcast(pos), "date")


@query("with " + DENSE + " select date, ticker, round(lead(ret, 1) over x + lead(ret, 2) over x + lead(ret, 3) over x, 6) as fwd, round(exp(lead(ret, 1) over x + lead(ret, 2) over x + lead(ret, 3) over x) - 1, 6) as simple from p window x as (partition by ticker order by date)")
def p19_p20_forward_returns(spark, d):
    return panel(spark, d).select("date", "ticker", r(md.forward_sum("ret", [1, 2, 3])).alias("fwd"), r(md.forward_simple_return("ret", [1, 2, 3])).alias("simple"))


@query()
def m10_har(spark, d):
    return md.har(positions(spark, d), "sq", "sq", [1, 2, 3, 4, 5]).where("har is not null").select("date", "ticker", "har")


@query()
def m11_har_log_pooled_market(spark, d):
    p = positions(spark, d)
    return md.har_log(p, "sq", [1, 2, 3, 4, 5], pooled=True, market=True).where("har_log is not null").select("date", "ticker", "har_log")


@query()
def m12_rolling_xs_fit(spark, d):
    p = positions(spark, d).withColumns({"m5": wn.rolling_mean(F.col("ret"), 5, 3), "s20": wn.rolling_std(F.col("ret"), 20, 10), "y": F.lead("ret").over(wn.series())})
    return md.rolling_xs_fit(p, "y", ["m5", "s20"]).where("fit is not null").select("date", "ticker", "fit")


TAIL = f"z0 as (select date, ticker, dense_rank() over (order by date) - 1 as pos, lead(ret) over (partition by ticker order by date) / nullif(case when count(ret) over {w(20)} >= 10 then stddev_samp(ret) over {w(20)} end, 0) as z from p), tt as (select distinct pos as t from z0), bb as (select t, z from z0 join tt on pos <= t - 1 and pos > t - 1 - 250 where z is not null), qq as (select t, quantile_cont(z, 0.05) as q from bb group by 1 having count(*) >= 500)"


@query("with " + DENSE + ", " + TAIL + " select bb.t as pos, round(any_value(q), 6) as q, round(avg(z), 6) as tail from bb join qq on bb.t = qq.t and z <= q group by 1")
def m13_fhs(spark, d):
    z = F.lead("ret").over(wn.series()) / F.nullif(wn.rolling_std(F.col("ret"), 20, 10), F.lit(0.0))
    t = md.pooled_tail(positions(spark, d).withColumn("z", z), "z", 0.05, 1)
    return t.select("pos", r("q").alias("q"), r("tail").alias("tail"))


@query("with " + DENSE + f", c0 as (select dense_rank() over (order by date) - 1 as pos, lead(ret) over (partition by ticker order by date) as y, case when count(ret) over {w(120)} >= 60 then quantile_cont(ret, 0.05) over {w(120)} end as q from p), tt as (select distinct pos as t from c0), bb as (select t, y / abs(q) as x from c0 join tt on pos <= t - 1 and pos > t - 1 - 250 where q < 0 and y is not null) select t as pos, round(-quantile_cont(x, 0.05), 6) as c from bb group by 1 having count(*) >= 500")
def m14_conformal_scale(spark, d):
    p = positions(spark, d).withColumns({"y": F.lead("ret").over(wn.series()), "q": wn.rolling_quantile(F.col("ret"), 0.05, 120, 60)})
    return md.conformal_scale(p, "y", "q", 0.05, 1).select("pos", r("c").alias("c"))


@query()
def m07_m08_garch(spark, d):
    return md.garch(positions(spark, d), "ret", [1, 2, 3, 4, 5])


@query()
def m09_garch_t(spark, d):
    return md.garch(positions(spark, d), "ret", [1], student=True)


@query()
def m15_m17_rolling_mixture(spark, d):
    sq = F.col("sq")
    p = positions(spark, d).withColumns({"y": F.lead("sq").over(wn.series()), "fa": F.avg(sq).over(wn.trailing(5)), "fb": F.avg(sq).over(wn.trailing(22))})
    return md.rolling_mixture(p, "y", ["fa", "fb"], 1).where("mix is not null").select("date", "ticker", "mix")


CTX = "ct as (select ticker, date, ret as last, avg(ret) over (partition by ticker order by date rows between 4 preceding and current row) as mom, row_number() over (partition by ticker order by date) as k from p where ret is not null)"


@query("with " + DENSE + ", " + CTX + " select ticker, date, least(k, 60) as n, round(last, 6) as last, round(mom, 6) as momentum5 from ct where k >= 32")
def m01_m06_contexts_baselines(spark, d):
    b = md.baselines(md.contexts(panel(spark, d), "ret", 60))
    return b.select("ticker", "date", F.size("context").cast("long").alias("n"), r(F.get("last", 0)).alias("last"), r(F.get("momentum5", 0)).alias("momentum5"))


@query()
def m03_m04_forecast(spark, d):
    """All dates before the locked holdout."""
    ctx = md.contexts(panel(spark, d), "ret", 60).where("date < date'2001-01-01'")
    return md.forecast(ctx, md.last_value_forecaster, 3, locked_from="2001-01-01")


@query("with " + DENSE + ", " + f"f as (select date, avg(ret * ret) over {w(5)} as fc, lead(ret) over (partition by ticker order by date) as nx from p), x as (select date, avg(nx * nx / fc) as ratio from f where fc > 0 and nx is not null group by 1) select date, case when count(ratio) over v >= 60 then round(avg(ratio) over v, 5) end as scale from x window v as (order by date rows between 254 preceding and 5 preceding)")
def m26_single_series_scale(spark, d):
    p = panel(spark, d).withColumns({"fc": F.avg(F.col("ret") * F.col("ret")).over(wn.trailing(5)), "nx": F.lead("ret").over(wn.series())})
    x = p.where("fc > 0 and nx is not null").groupBy("date").agg(F.avg(F.col("nx") * F.col("nx") / F.col("fc")).alias("ratio"))
    v = Window.orderBy("date").rowsBetween(-254, -5)  # a row a date
    return x.select("date", r(wn.gated(F.avg("ratio"), F.col("ratio"), v, 60), 5).alias("scale"))
