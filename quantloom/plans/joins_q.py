"""Joins: as-of, range, offset, splices and key checks; corporate actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import actions, joins
from quantloom.operators import stats as st
from quantloom.plans.base import DENSE, PX, panel, prices, query, r, table

RATES = "rt as (select o_orderdate::date as date, max(o_totalprice) as rate from orders where day(o_orderdate) = 1 group by 1)"


def _rates(spark, d):
    o = table(spark, d, "orders").where(F.dayofmonth("o_orderdate") == 1)
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("rate"))


@query("select s_suppkey, s_name, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j01_left_equi(spark, d):
    s, n, g = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(g, n.n_regionkey == g.r_regionkey, "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("with " + PX + ", m as (select date, avg(close) as mkt from px group by 1) select date, ticker, round(close / mkt, 6) as rel from px join m using (date)")
def j02_j19_p22_market_join(spark, d):
    """A market series, one row a date, joined to every ticker."""
    p = prices(spark, d)
    m = p.groupBy("date").agg(F.avg("close").alias("mkt"))
    return p.join(m, "date").select("date", "ticker", r(F.col("close") / F.col("mkt")).alias("rel"))


@query("with " + DENSE + " select date, ticker, raw, close, stale from p")
def j09_w02_skeleton_ffill(spark, d):
    return panel(spark, d).select("date", "ticker", "raw", "close", "stale")


@query("with " + PX + ", " + RATES + ", c as (select distinct date from px) select date, rate, round(pow(1 + rate / 1e7, 1 / 252.0::double) - 1, 9) as rf from c asof left join rt using (date)")
def j10_f20_asof_rate(spark, d):
    c = prices(spark, d).select("date").distinct()
    out = joins.asof_backward(c, _rates(spark, d), "date", "rate")
    return out.withColumn("rf", r(F.pow(1 + F.col("rate") / 1e7, F.lit(1 / 252)) - 1, 9))


@query("with a as (select n_name as ticker, o_orderdate::date as date, max(o_orderpriority) as contract from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' group by all), " + PX + " select px.ticker, px.date, a.contract from px asof left join a on px.ticker = a.ticker and px.date >= a.date")
def j11_asof_per_series(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.where("o_orderstatus = 'F'").join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    a = j.groupBy(F.col("n_name").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_orderpriority").alias("contract"))
    return joins.asof_backward(prices(spark, d).select("ticker", "date"), a, "date", "contract", ["ticker"])


@query("with a as (select l_shipdate::date as date, count(*) as n from lineitem group by 1), t as (select distinct o_orderdate::date as date from orders) select t.date, a.n from t asof left join a on t.date > a.date")
def j12_asof_strict(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("n"))
    t = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return joins.asof_backward(t, a, "date", "n", strict=True)


DIVIDENDS = """dv as (select n_name as ticker, o_orderdate::date as record_date, max(o_totalprice) / 10000.0::double as dividend from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderpriority = '1-URGENT' and day(o_orderdate) = 15 group by all),
cal as (select date, lag(date) over (order by date) as prev, lead(date) over (order by date) as nxt from (select distinct date from px)),
ex as (select dv.*, case when cal.nxt is null and record_date > cal.date then null when cal.prev < date '1998-01-01' then cal.prev else coalesce(cal.date, record_date) end as ex_date from dv left join cal on record_date >= cal.date and (cal.nxt is null or record_date < cal.nxt))"""


def _dividends(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    o = o.where("o_orderpriority = '1-URGENT' and dayofmonth(o_orderdate) = 15")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    dv = j.groupBy(F.col("n_name").alias("ticker"), F.to_date("o_orderdate").alias("record_date")).agg((F.max("o_totalprice") / 10000.0).alias("dividend"))
    return actions.ex_dates(dv, prices(spark, d).select("date").distinct(), "1998-01-01")


@query("with " + PX + ", " + DIVIDENDS + " select ticker, record_date, ex_date, round(dividend, 6) as dividend from ex")
def j14_ex_dates(spark, d):
    return _dividends(spark, d).select("ticker", "record_date", "ex_date", r("dividend").alias("dividend"))


@query("with " + PX + ", " + DIVIDENDS + """, pv as (select ex.ticker, ex.ex_date, ex.dividend, px.close as before from ex asof join px on ex.ticker = px.ticker and ex.ex_date > px.date),
fc as (select ticker, ex_date, ln(1 - dividend / before) as lf from pv where before > 0 and 1 - dividend / before > 0)
select px.ticker, px.date, px.close, round(px.close * exp(coalesce(sum(fc.lf), 0)), 6) as close_adj from px left join fc on px.ticker = fc.ticker and px.date < fc.ex_date group by px.ticker, px.date, px.close""")
def j13_b15_adjusted_close(spark, d):
    """The oracle's range join and product are one suffix window here."""
    events = _dividends(spark, d).withColumn("ratio", F.lit(None).cast("double"))
    return actions.adjusted_close(prices(spark, d).select("ticker", "date", "close"), events).withColumn("close_adj", r("close_adj"))


WINDOWS = "wn as (select n_name as ticker, make_date(1995 + (n_nationkey % 5)::int, 3, 1) as lo, make_date(1996 + (n_nationkey % 5)::int, 9, 30) as hi from nation where n_nationkey % 4 <> 0)"


@query("with " + PX + ", " + WINDOWS + " select px.ticker, px.date, px.close from px join wn on px.ticker = wn.ticker and px.date between wn.lo and wn.hi")
def p08_roll_window_filter(spark, d):
    y = F.pmod("n_nationkey", F.lit(5)).cast("int")
    n = table(spark, d, "nation").where("n_nationkey % 4 <> 0")
    windows = n.select(F.col("n_name").alias("ticker"), F.make_date(1995 + y, F.lit(3), F.lit(1)).alias("lo"), F.make_date(1996 + y, F.lit(9), F.lit(30)).alias("hi"))
    return joins.in_windows(prices(spark, d).select("ticker", "date", "close"), F.broadcast(windows), "ticker", "date")


@query("with " + DENSE + """, x as (select ticker, ret as r, dense_rank() over (order by date) as pos from p)
select a.ticker as leader, b.ticker as follower, count(*) as n, round(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0), 6) as rho from x a join x b on b.pos = a.pos + 2 and a.ticker <> b.ticker where a.r is not null and b.r is not null group by all having count(*) >= 30""")
def j16_j17_r28_offset_pairs(spark, d):
    """Lagged cross-correlation of ordered pairs. A market calendar has one row a day."""
    from pyspark.sql import Window

    x = panel(spark, d)
    pos = x.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))
    x = x.join(F.broadcast(pos), "date").where("ret is not null").select("ticker", "pos", F.col("ret").alias("r"))
    j = joins.offset_self_join(x, 2)
    return j.groupBy("leader", "follower").agg(F.count("*").alias("n"), r(st.safe_corr("x_leader", "x_follower")).alias("rho")).where("n >= 30")


@query("with t as (select unnest(range(60, 2400, 21)) as t), " + PX + ", m as (select row_number() over (order by date) - 1 as pos, mkt from (select date, avg(close) as mkt from px group by 1)) select t.t, count(*) as n, round(quantile_cont(mkt, 0.05), 3) as q from t join m on pos <= t - 5 and pos > t - 5 - 250 group by 1")
def j18_causal_range_join(spark, d):
    from pyspark.sql import Window

    t = spark.range(60, 2400, 21).select(F.col("id").alias("t"))
    m = prices(spark, d).groupBy("date").agg(F.avg("close").alias("mkt")).withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    return joins.causal_pairs(F.broadcast(t), m, 5, 250).groupBy("t").agg(F.count("*").alias("n"), r(F.percentile("mkt", F.lit(0.05)), 3).alias("q"))


@query("""with a as (select distinct l_suppkey as k from lineitem where l_shipdate < timestamp '1996-01-01'), b as (select s_suppkey as k, count(*) as n from supplier group by 1)
select (select count(*) from a where k not in (select k from b)) as missing, (select count(*) from b where k not in (select k from a)) as extra, (select count(*) from b where n > 1) as duplicated""")
def j20_c23_key_report(spark, d):
    a = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'1996-01-01'").select(F.col("l_suppkey").alias("k"))
    return joins.key_report(a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])


@query("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000) and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def j21_semi_anti(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").where("o_totalprice > 200000")
    n = table(spark, d, "nation").where("n_regionkey = 1")
    out = c.join(o, c.c_custkey == o.o_custkey, "left_semi").join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left_anti")
    return out.select("c_custkey", "c_mktsegment")


@query("with " + PX + ", a as (select ticker, date, close from px where date < date '1997-01-01'), b as (select ticker, date, close * 1.01::double as close from px where date >= date '1996-01-01') select count(*) filter (a.close is not null and b.close is not null) as both, count(*) filter (b.close is null) as only_left, count(*) filter (a.close is null) as only_right, round(max(abs(a.close - b.close) / abs(b.close)), 6) as max_rel from a full join b using (ticker, date)")
def g23_j04_parity(spark, d):
    p = prices(spark, d)
    a = p.where("date < date'1997-01-01'")
    b = p.where("date >= date'1996-01-01'").withColumn("close", F.col("close") * 1.01)
    return joins.parity(a, b, ["ticker", "date"], "close").withColumn("max_rel", r("max_rel"))


@query("with " + PX + ", t as (select ticker, date, close * 2 as close from px where date >= date '2000-01-01') select * from (select ticker, date, close from px where date < date '2000-01-01' union all select * from t)")
def s20_s21_splice(spark, d):
    """Rows of a span replaced by another source's; unequal keys are refused."""
    p = prices(spark, d).select("ticker", "date", "close")
    late = F.col("date") >= F.lit("2000-01-01").cast("date")
    return joins.splice(p, p.where(late).withColumn("close", F.col("close") * 2), ["ticker", "date"], late)


@query("with " + PX + ", g as (select distinct ticker, date, close from px) select ticker, date, close, round(ln(close), 6) as level from g where date = (select min(date) from px)")
def j06_level_at_anchor(spark, d):
    p = prices(spark, d)
    first = p.agg(F.min("date").alias("date"))
    return p.join(F.broadcast(first), "date").select("ticker", "date", "close", r(F.ln("close")).alias("level"))
