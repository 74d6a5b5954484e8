"""Projections, sessions, calendars, aggregates, pivots, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import actions, joins, panel as pn
from quantloom.operators.windows import series
from quantloom.plans.base import BARS, DENSE, PX, SESSION, bars, panel, prices, query, r, table


@query("with " + PX + " select date, ticker, close, value from px where ticker in ('NATION_6', 'NATION_7', 'NATION_12') and date <= date '1997-06-30'")
def s09_load_long(spark, d):
    """Projection, IN-list and inclusive end date, all reaching the scan or the first filter."""
    return prices(spark, d).where(F.col("ticker").isin("NATION_6", "NATION_7", "NATION_12") & (F.col("date") <= F.lit("1997-06-30").cast("date")))


@query("select page_id, len(regexp_extract_all(html, '<li>')) as items, regexp_extract(html, '<title>([^<]*)', 1) as title from pages")
def s10_scrape_tables(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(h, F.lit("<li>"), F.lit(0))).cast("long").alias("items"), F.regexp_extract(h, "<title>([^<]*)", 1).alias("title"))


@query("select date, ticker, status from (select unnest(generate_series(date '1995-01-01', date '1995-03-01', interval 1 month))::date as date) m cross join (select distinct n_name as ticker from nation) n left join (select distinct date_trunc('month', l_shipdate)::date as date, n_name as ticker, 'cached' as status from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey) c using (date, ticker) where status is null or date = date '1995-03-01'")
def s12_k05_needs_fetch(spark, d):
    """Planned (ticker, month) chunks that aren't cached, and the current month always."""
    months = spark.sql("select explode(sequence(date'1995-01-01', date'1995-03-01', interval 1 month)) as date")
    names = table(spark, d, "nation").select(F.col("n_name").alias("ticker")).distinct()
    have = prices(spark, d).select(F.trunc("date", "month").alias("date"), "ticker").distinct().withColumn("status", F.lit("cached"))
    plan = months.crossJoin(names).join(have, ["date", "ticker"], "left")
    return plan.where(F.col("status").isNull() | (F.col("date") == F.lit("1995-03-01").cast("date")))


@query("select event_type, count(*) as n, count(try_cast(props->>'$.k' as double)) as numeric_n, count(try_cast(props->>'$.k' as double)) = count(props->>'$.k') as lossless from events group by 1")
def p02_numeric_coercion(spark, d):
    k = F.get_json_object("props", "$.k")
    e = table(spark, d, "events").select("event_type", k.alias("k"), k.try_cast("double").alias("x"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("x").alias("numeric_n"), (F.count("x") == F.count("k")).alias("lossless"))


@query("select event_id, ts - interval 5 minute as bar_start, lower(event_type) as metric, cast(ts as date) as date from events")
def p05_bar_start_shift(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", (F.col("ts") - F.expr("interval 5 minutes")).alias("bar_start"), F.lower("event_type").alias("metric"), F.to_date("ts").alias("date"))


@query("with " + SESSION + " select date, ticker, count(*) as n, round(max(close), 6) as hi from s group by all")
def p09_main_session(spark, d):
    return pn.main_session(bars(spark, d)).groupBy("date", "ticker").agg(F.count("*").alias("n"), r(F.max("close")).alias("hi"))


@query("with " + SESSION + " select date, count(*) as bars from s where ticker = 'click' group by 1 having count(*) >= 20")
def g01_trading_calendar(spark, d):
    b = bars(spark, d).where("ticker = 'click'")
    return pn.main_session(b).groupBy("date").agg(F.count("*").alias("bars")).where("bars >= 20")


@query("with " + SESSION + " select date, ticker, arg_max(close, (timestamp, seq)) as close, round(sum(close), 6) as value from s group by all")
def g02_g03_session_close_value(spark, d):
    b = bars(spark, d)
    close = pn.session_close(b, "close", tie="seq")
    value = pn.session_value(b.withColumn("value", F.col("close"))).withColumn("value", r("value"))
    return close.join(value, ["date", "ticker"])


@query("with " + SESSION + ", x as (select date, ticker, ln(close) - lag(ln(close)) over (partition by ticker order by timestamp, seq) as r from s) select date, ticker, round(sum(r * r), 6) as rv from x group by all")
def g04_realized_variance(spark, d):
    b = bars(spark, d)
    days = pn.main_session(b).select("date").distinct()
    return pn.realized_variance(b, days, tie="seq").withColumn("rv", r("rv"))


@query("select event_type as ticker, count(*) as n_rows, count(distinct user_id) as users, min(ts) as first_ts, max(ts) as last_ts from events group by 1")
def g06_build_summary(spark, d):
    return bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("users"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("select user_id, cast(ts as date) as date, arg_max(value, (ts, event_id)) filter (event_type = 'click') as v_click, arg_max(value, (ts, event_id)) filter (event_type = 'purchase') as v_purchase, arg_max(value, (ts, event_id)) filter (event_type = 'view') as v_view from events group by all")
def g07_g08_pivot_last(spark, d):
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    last = F.max_by("value", F.struct("ts", "event_id"))
    out = e.groupBy("user_id", "date").pivot("event_type", ["click", "purchase", "view"]).agg(last)
    return out.select("user_id", "date", *(F.col(c).alias(f"v_{c}") for c in ("click", "purchase", "view")))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def g09_dedupe_keep_last(spark, d):
    return joins.dedupe_last(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("with " + PX + ", m as (select date, round(avg(close), 6) as mkt, count(*) as n from px group by 1) select year(date) as y, count(*) as days, sum(case when n >= 15 then 1 else 0 end) as busy from m group by 1")
def g20_days_by_year(spark, d):
    m = prices(spark, d).groupBy("date").agg(F.count("*").alias("n"))
    return m.groupBy(F.year("date").alias("y")).agg(F.count("*").alias("days"), F.sum((F.col("n") >= 15).cast("long")).alias("busy"))


@query("with " + DENSE + " select ticker, round(count(raw) / count(*)::double, 6) as coverage, sum(case when ret = 0 then 1 else 0 end) as zero_ret, round(max(abs(ret)), 6) as top_move from p group by 1")
def g21_g22_data_checks(spark, d):
    p = panel(spark, d)
    return p.groupBy("ticker").agg(r(F.count("raw") / F.count("*")).alias("coverage"), F.sum(F.when(F.col("ret") == 0, 1).otherwise(0)).alias("zero_ret"), r(F.max(F.abs("ret"))).alias("top_move"))


@query("""with st as (select s_suppkey, case when s_acctbal < 0 then 'negative' when s_nationkey < 3 then 'excluded nation' else 'ok' end as status from supplier)
select status, count(*) as n from st group by 1""")
def g24_status_counts(spark, d):
    why = F.when(F.col("s_acctbal") < 0, "negative").when(F.col("s_nationkey") < 3, "excluded nation").otherwise("ok")
    return table(spark, d, "supplier").groupBy(why.alias("status")).agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as bigint) as qty, grouping(l_returnflag) + 0 as g from lineitem group by cube (l_returnflag, l_linestatus)")
def g99_cube(spark, d):
    """Grouping sets, an addition of the engine."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"), F.grouping("l_returnflag").cast("long").alias("g"))


@query("with " + PX + ", k as (select count(distinct ticker) as n from px), f as (select date, count(*) as n from px group by 1) select px.* from px join f using (date), k where f.n = k.n")
def j07_p18_full_dates(spark, d):
    return pn.full_dates(prices(spark, d))


@query("with " + PX + " select date, round(max(close) filter (ticker = 'NATION_6'), 4) as france, round(max(close) filter (ticker = 'NATION_18'), 4) as china from px group by 1")
def p23_to_wide(spark, d):
    return pn.to_wide(prices(spark, d), "close", ["NATION_6", "NATION_18"]).select("date", F.col("NATION_6").alias("france"), F.col("NATION_18").alias("china"))


@query("""with t as (select ts, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as dow, cast(day(ts) as int) as dom, cast(month(ts) as int) as mon, case when hour(ts) between 10 and 18 then 1 else 0 end as in_session from events)
select hour, dow, dom, mon, in_session, count(*) as n from t group by all""")
def p26_calendar_features(spark, d):
    t = table(spark, d, "events").select(F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), F.dayofmonth("ts").alias("dom"), F.month("ts").alias("mon"), F.when(F.hour("ts").between(10, 18), 1).otherwise(0).alias("in_session"))
    return t.groupBy("hour", "dow", "dom", "mon", "in_session").agg(F.count("*").alias("n"))


@query("select n_name as ticker, r_name as sector, regexp_extract(s_name, '([0-9]{2})$', 1) as code, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def p28_p29_dimension_and_code(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"), F.regexp_extract("s_name", "([0-9]{2})$", 1).alias("code")).agg(F.count("*").alias("n"))


@query("with " + DENSE + ", z as (select *, row_number() over (partition by ticker order by date desc) as k from p where date between date '1996-01-01' and date '1996-12-31') select date, ticker, round(ret, 6) as ret from z where k > 5 and not (date between date '1996-06-01' and date '1996-06-30')")
def p10_p12_spans(spark, d):
    """An inclusive span, less its last five rows, less an excluded window."""
    p = panel(spark, d).where("date between date'1996-01-01' and date'1996-12-31'")
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return p.withColumn("k", k).where("k > 5 and not (date between date'1996-06-01' and date'1996-06-30')").select("date", "ticker", r("ret").alias("ret"))


@query("select count(*) filter (a and b) as both, count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from (select user_id, bool_or(event_type = 'click') as a, bool_or(event_type = 'purchase') as b from events group by 1)")
def u01_u06_set_operations(spark, d):
    e = table(spark, d, "events")
    a, b = (e.where(F.col("event_type") == t).select("user_id").distinct() for t in ("click", "purchase"))
    n = lambda x, c: x.agg(F.count("*").alias(c))
    return n(a.intersect(b), "both").crossJoin(n(a.subtract(b), "only_a")).crossJoin(n(b.subtract(a), "only_b"))


@query("""with x as (select o_orderdate::date as date, o_orderpriority as code, count(*) as volume from orders group by all)
select date, code, volume from (select *, row_number() over (partition by date order by volume desc, code) as n from x) where n = 1""")
def t02_t03_front_month(spark, d):
    x = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("seq")).agg(F.count("*").alias("volume"))
    return actions.front_month(x).select(F.col("timestamp").alias("date"), F.col("seq").alias("code"), "volume")


@query("""with c as (select o_orderstatus as code, date_trunc('month', o_orderdate)::date as contract, min(o_orderdate)::date as first_trade, max(o_orderdate)::date as last_trade from orders where o_orderdate < timestamp '1996-01-01' group by all),
x as (select *, last_trade - 5 as roll, lag(last_trade - 5) over (partition by code order by last_trade, contract) as before from c)
select code, contract, greatest(first_trade, coalesce(before + 1, first_trade), date '1995-02-01')::date as lo, least(roll, date '1995-11-15')::date as hi from x where greatest(first_trade, coalesce(before + 1, first_trade), date '1995-02-01') <= least(roll, date '1995-11-15')""")
def t04_roll_schedule(spark, d):
    o = table(spark, d, "orders").where("o_orderdate < timestamp'1996-01-01'").withColumn("day", F.to_date("o_orderdate"))
    c = o.groupBy(F.col("o_orderstatus").alias("code"), F.trunc("day", "month").alias("contract")).agg(F.min("day").alias("first_trade"), F.max("day").alias("last_trade"))
    day = lambda x: F.lit(x).cast("date")
    return actions.roll_schedule(c, 5, day("1995-02-01"), day("1995-11-15")).select("code", "contract", "lo", "hi")


@query("""with c as (select n_name as ticker, case when n_regionkey = 0 then 'fund' else 'share' end as kind, count(*) as history, sum(cast(round(l_extendedprice * 100) as bigint)) as turnover, count(*) filter (l_discount = 0) / count(*)::double as missing from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all),
q as (select *, case when kind <> 'share' then 'not a share' when history < 100 then 'short history' when missing > 0.2 then 'gaps' end as why from c),
k as (select *, case when why is null then row_number() over (partition by why is null order by turnover desc, ticker) end as rank from q)
select ticker, cast(rank as int) as rank, case when why is not null then why when rank <= 5 then 'selected' else 'below cut' end as status from k""")
def t01_rank_universe(spark, d):
    li, su, na = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    j = li.join(su, li.l_suppkey == su.s_suppkey).join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))
    c = j.groupBy(F.col("n_name").alias("ticker"), F.when(F.col("n_regionkey") == 0, "fund").otherwise("share").alias("kind")).agg(F.count("*").alias("history"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("turnover"), (F.sum((F.col("l_discount") == 0).cast("long")) / F.count("*")).alias("missing"))
    return actions.rank_universe(c, 5, 100, 0.2).select("ticker", "rank", "status")


@query("with " + DENSE + " select date, ticker, round(ret, 6) as ret from p where ret is not null order by abs(ret) desc, date, ticker limit 25")
def t09_top_moves(spark, d):
    return panel(spark, d).where("ret is not null").orderBy(F.desc(F.abs("ret")), "date", "ticker").limit(25).select("date", "ticker", r("ret").alias("ret"))


@query("with " + BARS + ", x as (select date_trunc('day', timestamp) as d, count(*) as n from b group by 1), g as (select row_number() over (order by d) - 1 as i, d, n from x), a as (select i, d from g where i >= 5 and (i - 5) % 3 = 0), k as (select row_number() over (order by i) - 1 as j, count(*) over () as m, d from a) select d::date as date from k where j in (select cast(floor(q * (m - 1) / 4.0) as bigint) from range(5) t(q))")
def t10_walk_forward_anchors(spark, d):
    """Every third day from the sixth on, thinned to five evenly spaced ones. One row a day."""
    x = bars(spark, d).select(F.to_date("timestamp").alias("date")).distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    a = x.where("i >= 5 and (i - 5) % 3 = 0")
    k = a.withColumn("j", F.row_number().over(Window.orderBy("i")) - 1).withColumn("m", F.count("*").over(Window.partitionBy(F.lit(0))))
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda q: F.floor(q * (F.col("m") - 1) / 4.0).cast("int"))
    return k.where(F.array_contains(picks, F.col("j"))).select("date")


@query("select d::timestamp + to_minutes(600 + 30 * k::int) as timestamp from (select unnest(generate_series(date '2024-01-01', date '2024-01-14', interval 1 day)) as d) x cross join range(18) t(k) where isodow(d) < 6")
def f25_session_grid(spark, d):
    return spark.sql(pn.session_grid("2024-01-01", "2024-01-14", 30))


@query("with " + PX + ", c as (select *, lag(ticker) over (partition by date order by value desc, ticker) as x from px), q as (select date, arg_max(ticker, (value, ticker)) as contract from px group by 1) select date, contract, coalesce(contract <> lag(contract) over (order by date), false) as roll from q")
def w29_roll_flag(spark, d):
    """The nation of highest turnover as the contract of the day; a market series has one row a day."""
    q = prices(spark, d).groupBy("date").agg(F.max_by("ticker", F.struct("value", "ticker")).alias("contract")).withColumn("ticker", F.lit("x"))
    return q.withColumn("roll", actions.roll_flag(series())).select("date", "contract", "roll")


@query("with x as (select n_name as ticker, o_orderpriority as contract, o_orderdate::date as date, max(o_totalprice) as close from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all), y as (select ticker, date, arg_max(contract, (close, contract)) as contract, max(close) as close from x group by 1, 2), z as (select *, case when contract = lag(contract) over (partition by ticker order by date) then ln(close) - lag(ln(close)) over (partition by ticker order by date) end as r from y) select ticker, date, contract, round(r, 6) as r, coalesce(abs(r) > 0.2, false) as spike from z")
def w30_w32_same_contract_returns(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    x = j.groupBy(F.col("n_name").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderpriority")).alias("contract"), F.max("o_totalprice").alias("close"))
    x = x.withColumn("r", actions.same_contract_return())
    return x.select("ticker", "date", "contract", r("r").alias("r"), F.coalesce(F.abs("r") > 0.2, F.lit(False)).alias("spike"))
