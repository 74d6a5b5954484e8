"""Further rows of the inventory: selections, comparisons, factor variances, calendars and seeded panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import losses, quantiles as qt, special
from quantloom.operators import models as md
from quantloom.operators import panel as pn
from quantloom.operators import stats as st
from quantloom.operators import windows as wn
from quantloom.plans.base import DENSE, PX, SESSION, bars, panel, prices, query, r, table, w
from quantloom.plans.quantiles_q import Q, vectors
from quantloom.sources import synthetic, tables


@query()
def s27_s28_s29_seeded_panels(spark, d):
    p = synthetic.market_panel(spark, 60, 10)
    return synthetic.inject_burst(p, "T000", "T001", 2, 0.02, 0.05, 0.5).unionByName(synthetic.planted_panel(spark, 60, 10, 0.1), allowMissingColumns=True)


@query("select greatest(m, date '1995-01-15')::date as lo, least(last_day(m), date '1995-04-10')::date as hi from (select unnest(generate_series(date '1995-01-01', date '1995-04-10', interval 1 month))::date as m)")
def k02_k03_month_chunks(spark, d):
    return tables.month_chunks(spark, "1995-01-15", "1995-04-10")


@query("select o_orderpriority as variant, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_key, count(*) as trials from orders group by 1")
def k13_unique_trials(spark, d):
    last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("variant")).agg(last.alias("last_key"), F.count("*").alias("trials"))


@query("with " + DENSE + f", v as (select date, ticker, ret, case when count(ret) over {w(60, 1)} >= 30 then quantile_cont(ret, 0.05) over {w(60, 1)} end as v5, case when count(ret) over {w(60, 1)} >= 30 then 1.3::double * quantile_cont(ret, 0.01) over {w(60, 1)} end as e5 from p), ok as (select *, ret is not null and e5 < v5 and v5 < 0 as ok from v) select date, count(*) filter (ok) as n, round(avg(case when ok then -(case when ret <= v5 then 1 else 0 end) * (v5 - ret) / (0.05 * e5) + v5 / e5 + ln(-e5) - 1 end), 4) as fz0 from ok group by 1")
def p14_p15_fz0_panel(spark, d):
    """Daily mean joint loss over the cells inside the loss's domain."""
    x = F.col("ret")
    p = panel(spark, d).withColumns({"v5": wn.rolling_quantile(x, 0.05, 60, 30, lag=1), "e5": 1.3 * wn.rolling_quantile(x, 0.01, 60, 30, lag=1)})
    p = p.withColumn("loss", losses.fz0(x, F.col("v5"), F.col("e5"), 0.05))
    return p.groupBy("date").agg(F.count("loss").alias("n"), r(F.avg("loss"), 4).alias("fz0"))


@query("with " + DENSE + ", a as (select ticker, avg(abs(ret)) as m, count(ret) as n from p group by 1), b as (select ticker, avg(abs(ret)) as m from p where date < date '1997-01-01' group by 1) select ticker, n, round(a.m - b.m, 6) as delta from a join b using (ticker)")
def j05_j22_compared_metrics(spark, d):
    p = panel(spark, d)
    a = p.groupBy("ticker").agg(F.avg(F.abs("ret")).alias("a"), F.count("ret").alias("n"))
    b = p.where("date < date'1997-01-01'").groupBy("ticker").agg(F.avg(F.abs("ret")).alias("b"))
    return a.join(b, "ticker").select("ticker", "n", r(F.col("a") - F.col("b")).alias("delta"))


@query("with " + DENSE + ", x as (select date, ticker, ret, row_number() over (partition by date order by abs(ret) desc nulls last, ticker) as k from p) select date, any_value(ticker) filter (k = 1) as top, round(min(ret), 6) as lo, round(max(ret), 6) as hi from x where ret is not null group by 1")
def t07_t12_winners(spark, d):
    p = panel(spark, d).where("ret is not null")
    best = F.min_by("ticker", F.struct(-F.abs("ret"), F.col("ticker")))
    return p.groupBy("date").agg(best.alias("top"), r(F.min("ret")).alias("lo"), r(F.max("ret")).alias("hi"))


@query("with q as (select unnest([0.6, 0.7, 0.8, 0.9]::double[]) as pct, unnest(thr) as thr from (select quantile_cont(o_totalprice, [0.6, 0.7, 0.8, 0.9]) as thr from orders where o_orderdate < timestamp '1997-01-01')), f as (select pct, avg(case when o_totalprice > thr then 1.0::double else 0 end) as freq from q, orders where o_orderdate >= timestamp '1997-01-01' group by 1) select pct, round(freq, 6) as freq from f order by abs(freq - 0.125), pct limit 1")
def t08_calibrated_percentile(spark, d):
    """The percentile of the past whose exceedance in the rest is closest to a target; a grid of four broadcast."""
    o = table(spark, d, "orders").select("o_orderdate", "o_totalprice")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    grid = [0.6, 0.7, 0.8, 0.9]
    thr = o.where(F.col("o_orderdate") < cut).agg(*(F.percentile("o_totalprice", F.lit(g)).alias(f"t{i}") for i, g in enumerate(grid)))
    late = o.where(F.col("o_orderdate") >= cut).crossJoin(F.broadcast(thr))
    f = late.agg(*(F.avg((F.col("o_totalprice") > F.col(f"t{i}")).cast("double")).alias(f"f{i}") for i in range(len(grid))))
    rows = f.select(F.explode(F.array(*(F.struct(F.lit(g).alias("pct"), F.col(f"f{i}").alias("freq")) for i, g in enumerate(grid)))).alias("z")).select("z.*")
    return rows.orderBy(F.abs(F.col("freq") - 0.125), "pct").limit(1).select("pct", r("freq").alias("freq"))


@query("with " + SESSION + ", x as (select date, timestamp, ticker, ln(close) - lag(ln(close)) over (partition by ticker order by timestamp, seq) as r from s), pf as (select date, timestamp, sum(0.2::double * coalesce(r, 0)) as v from x group by all) select date, round(sum(v * v), 6) as rv from pf group by 1")
def g15_g18_portfolio_rv(spark, d):
    x = pn.bar_returns(bars(spark, d), tie="seq")
    weights = x.select("date", "ticker").distinct().withColumn("w", F.lit(0.2))
    return pn.portfolio_rv(x, weights).withColumn("rv", r("rv"))


@query("with " + SESSION + ", x as (select date, timestamp, ticker, ln(close) - lag(ln(close)) over (partition by ticker order by timestamp, seq) as r from s), m as (select timestamp, avg(r) as m from x group by 1) select date, ticker, round(sum((coalesce(r, 0) - 0.5 * coalesce(m, 0)) ** 2), 6) as rv from x left join m using (timestamp) group by all having count(r) > 0")
def g16_residual_rv(spark, d):
    x = pn.bar_returns(bars(spark, d), tie="seq")
    betas = x.select("date", "ticker").distinct().withColumn("beta", F.lit(0.5))
    out = pn.residual_rv(x, x.groupBy("timestamp").agg(F.avg("r").alias("m")), betas)
    return out.where("rv is not null").select("date", "ticker", r("rv").alias("rv"))


@query("with " + PX + ", a as (select distinct date from px where ticker = 'NATION_6'), b as (select distinct date from px where ticker = 'NATION_18') select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'both', count(*) from (select * from a intersect select * from b) union all select 'only first', count(*) from (select * from a except select * from b)")
def u02_u03_u04_calendars(spark, d):
    p = prices(spark, d)
    a, b = (p.where(F.col("ticker") == t).select("date").distinct() for t in ("NATION_6", "NATION_18"))
    n = lambda x, k: x.agg(F.lit(k).alias("op"), F.count("*").alias("n"))
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "both")).union(n(a.subtract(b), "only first"))


@query("select event_id, strftime(ts, '%Y-%m') as ym, upper(event_type) as up, starts_with(event_type, 'p') as p, cast(props->>'$.k' as bigint) as k, date_diff('day', date '2024-01-01', ts::date) as age, last_day(ts)::date as month_end from events")
def f23_f24_f28_scalars(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("ym"), F.upper("event_type").alias("up"), F.startswith("event_type", F.lit("p")).alias("p"), F.from_json("props", "k long")["k"].alias("k"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("age"), F.last_day("ts").alias("month_end"))


@query("with " + PX + ", c as (select d::date as date from (select unnest(generate_series(date '1996-01-01', date '1996-03-31', interval 1 day)) as d) where isodow(d) < 6), j as (select c.date, close from c left join px on c.date = px.date and ticker = 'NATION_6') select date, last_value(close ignore nulls) over (order by date rows unbounded preceding) as close from j")
def f26_regular_series(spark, d):
    """Business days with the last close carried on; one series of one row a day."""
    c = spark.sql("select day as date from (select explode(sequence(date'1996-01-01', date'1996-03-31')) as day) where weekday(day) < 5")
    j = c.join(prices(spark, d).where("ticker = 'NATION_6'").select("date", "close"), "date", "left")
    return j.select("date", F.last("close", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("close"))


@query("with " + Q + " select label, round(sum(((q[19] - q[3]) / 2.5631::double) ** 2), 5) as v80, round(sum(q[11]), 5) as med from q group by 1")
def f12_m28_summed_spreads(spark, d):
    q = F.col("q")
    v = F.pow((F.get(q, 18) - F.get(q, 2)) / 2.5631, F.lit(2))
    return vectors(spark, d).groupBy("label").agg(r(F.sum(v), 5).alias("v80"), r(F.sum(F.get(q, 10)), 5).alias("med"))


@query()
def m27_r14_inverse_cdf_draws(spark, d):
    """One draw of each vector's distribution, by a hash of its id; deterministic."""
    u = (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return vectors(spark, d).withColumn("u", u).select("vec_id", qt.at(F.col("q"), F.col("u")).alias("draw"))


@query("with " + DENSE + f", a as (select date, avg(ret) as x, count(ret) as n from p group by 1) select date, case when count(x) over v >= 63 then round(stddev_samp(x) over v, 6) end as te, case when count(x) over u >= 120 then round(avg(x) over u, 6) end as lagged_mean from a window v as (order by date rows between 62 preceding and current row), u as (order by date rows between 254 preceding and 5 preceding)")
def w21_w35_market_windows(spark, d):
    a = panel(spark, d).groupBy("date").agg(F.avg("ret").alias("x"))
    o = Window.orderBy("date")  # a row a date
    return a.select("date", r(wn.gated(F.stddev_samp("x"), F.col("x"), o.rowsBetween(-62, 0), 63)).alias("te"), r(wn.gated(F.avg("x"), F.col("x"), o.rowsBetween(-254, -5), 120)).alias("lagged_mean"))


@query("with " + DENSE + ", m as (select date, avg(ret) as m from p group by 1), s as (select ticker, regr_slope(ret, m) as b, regr_intercept(ret, m) as a, count(*) as n from p join m using (date) where ret is not null and m is not null group by 1) select ticker, n, round(a, 5) as const, round(b, 5) as m from s where n >= 30")
def r03_grouped_ols(spark, d):
    p = panel(spark, d)
    j = p.join(p.groupBy("date").agg(F.avg("ret").alias("m")), "date")
    return st.grouped_ols(j, "ret", ["m"], ["ticker"], 30).select("ticker", "n", r("const", 5).alias("const"), r("m", 5).alias("m"))


@query()
def r21_r38_deflated_sharpe(spark, d):
    m = panel(spark, d).where("ret is not null").groupBy("date").agg((F.avg(F.expm1("ret")) / 20).alias("r")).withColumn("k", F.lit(1))
    s = st.performance(m, ["k"]).first()
    p = special.deflated_sharpe(s["sharpe"] / 252**0.5, s["n"], s["skew"], s["kurt"], 0.02, 16)
    return spark.createDataFrame([(float(p), "pass" if p > 0.95 else "fail")], "dsr double, verdict string")


@query("with g as (select n_name as ticker, n_regionkey as sector, sum(s_acctbal) as v from supplier join nation on s_nationkey = n_nationkey group by all), c as (select *, count(*) over (partition by sector) as n, row_number() over (order by v desc, ticker) as k, count(*) over () as m from g) select ticker, case when n < 3 then 'pooled' else cast(sector as varchar) end as sector_group, case when k <= m // 2 then 'liquid' else 'other' end as half from c")
def m19_groups(spark, d):
    """Sector groups, small ones pooled, and halves by size; one row a name."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    g = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("sector")).agg(F.sum("s_acctbal").alias("v"))
    c = g.withColumns({"n": F.count("*").over(Window.partitionBy("sector")), "k": F.row_number().over(Window.orderBy(F.desc("v"), "ticker")), "m": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return c.select("ticker", F.when(F.col("n") < 3, "pooled").otherwise(F.col("sector").cast("string")).alias("sector_group"), F.when(F.col("k") <= F.expr("m div 2"), "liquid").otherwise("other").alias("half"))


@query("with " + DENSE + " select date, ticker, round(ln(case when count(ret) over x >= 5 then sum(ret * ret) over x end + 1e-7::double), 6) as lrv from p window x as (partition by ticker order by date rows between 4 preceding and current row)")
def m18_log_rv_blocks(spark, d):
    sq = F.col("ret") * F.col("ret")
    return panel(spark, d).select("date", "ticker", r(F.ln(wn.rolling_sum(sq, 5, 5) + 1e-7)).alias("lrv"))


@query("with " + DENSE + ", h as (select ticker, year(date) as y, case when sign(ret) = sign(lead(ret) over (partition by ticker order by date)) then 1.0::double else 0 end as hit from p where ret is not null) select ticker, y as year, round(avg(hit), 6) as accuracy from h group by all")
def c33_accuracy_table(spark, d):
    """The heat map's table: accuracy of each name by period, in rows."""
    return _hits(spark, d).groupBy("ticker", F.col("y").alias("year")).agg(r(F.avg("hit")).alias("accuracy"))


def _hits(spark, d):
    p = panel(spark, d).where("ret is not null")
    return p.select("ticker", F.year("date").alias("y"), F.coalesce((F.signum("ret") == F.signum(F.lead("ret").over(wn.series()))).cast("double"), F.lit(0.0)).alias("hit"))


@query("select cast(floor((o_totalprice - 0) / 10000) as bigint) as bin, count(*) as n from orders group by 1")
def c32_histogram(spark, d):
    return table(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 10000).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("with " + DENSE + f", x as (select date, ticker, ret, lead(ret) over (partition by ticker order by date) as f, year(date) as y, not stale as fresh from p), s as (select 'all' as split, ret, f from x union all select 'year ' || y, ret, f from x union all select 'fresh', ret, f from x where fresh) select split, count(*) as n, round(covar_pop(ret, f) / nullif(stddev_pop(ret) * stddev_pop(f), 0), 5) as rho from s where ret is not null and f is not null group by 1")
def c12_c26_splits(spark, d):
    """One statistic over splits in one pass: a row is repeated for each split that it is in."""
    x = panel(spark, d).withColumn("f", F.lead("ret").over(wn.series())).where("ret is not null and f is not null")
    splits = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("year "), F.year("date").cast("string")), F.when(~F.col("stale"), F.lit("fresh"))))
    return x.select(F.explode(splits).alias("split"), "ret", "f").groupBy("split").agg(F.count("*").alias("n"), r(st.safe_corr("ret", "f"), 5).alias("rho"))


@query()
def c14_regime(spark, d):
    """The stress state with its share of days by year."""
    from quantloom.plans.windows_q import w23_stress_indicator

    return w23_stress_indicator(spark, d).groupBy(F.year("date").alias("year")).agg(F.avg("stress").alias("share"), F.count("stress").alias("n"))


@query()
def m16_tail_mixture(spark, d):
    """Weights of two VaR/ES pairs by their joint loss, one fit for each year's rows."""
    import pandas as pd

    x = F.col("ret")
    p = panel(spark, d)
    p = p.withColumns({"va": wn.rolling_quantile(x, 0.05, 60, 30, lag=1), "vb": -1.645 * wn.rolling_std(x, 60, 30, lag=1)}).where("ret is not null and va < 0 and vb < 0")

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[["va", "vb"]].to_numpy()
        k = md.fit_tail_mix(v, 1.25 * v, pdf["ret"].to_numpy(), 0.05)
        return pd.DataFrame({"year": [key[0]], "wa": [k[0]], "wb": [k[1]], "log_scale": [k[2]]})

    return p.groupBy(F.year("date")).applyInPandas(fit, "year int, wa double, wb double, log_scale double")
