"""Sources, sinks and pulls: paged services, contracts, dividends, manifests, caches, ledgers, bundles and their audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import actions, models as md, panel as pn
from quantloom.plans.base import DENSE, ORACLE, PX, QUERIES, panel, prices, query, r, table
from quantloom.plans.quantiles_q import Q, vectors
from quantloom.sources import paged, pull, tables
from quantloom.sources.shared import place, written

NAMES = "select unnest(['A', 'B', 'C']) as key"


def _paged(spark, transport: str, keys: str, shape: str, **options):
    spark.dataSource.register(paged.PagedSource)
    r_ = spark.read.format("paged").option("transport", f"quantloom.sources.paged:{transport}").option("keys", keys)
    return r_.options(**options).schema(shape).load()


@query("select key, i, key || i as name from (" + NAMES + "), range(7) t(i)")
def s01_s02_s11_paged_rows(spark, d):
    """A service of pages of three rows that fails the first time each page is asked for: one task a key."""
    return _paged(spark, "demo_service", '["A", "B", "C"]', "key string, i long, name string", pause="0.01")


@query("select time_bucket(interval '10 minutes', ts) as start, event_type as ticker, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as volume from events group by all")
def s03_s04_bars(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    g = e.groupBy(F.window("ts", "10 minutes").alias("w"), F.col("event_type").alias("ticker"))
    return g.agg(F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").alias("volume")).select(F.col("w.start").alias("start"), "ticker", "open", "high", "low", "close", "volume")


@query("select strftime(d, '%Y-%m-%d') as key, i, strftime(d, '%Y-%m-%d') || '#' || i as name from (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as d), range(5) t(i) where i < day(d) % 5")
def s05_daily_positions(spark, d):
    """One request a day, with a guard against answers that the service may have cut."""
    import json
    from datetime import date

    days = [date(2024, 1, k).isoformat() for k in range(1, 32)]
    return _paged(spark, "demo_days", json.dumps(days), "key string, i long, name string", cap="1000")


@query("""with c as (select code || m || '-' || (y % 10) as contract, make_date(y::int, m, 15) as expected from (select unnest(['F', 'O', 'P']) as code), (select unnest([3, 6, 9, 12]) as m), (select unnest(range(1985, 2002)) as y)),
md as (select o_orderstatus || month(o_orderdate) || '-' || (year(o_orderdate) % 10) as contract, max(o_orderdate)::date as last_trade from orders group by 1)
select contract, expected, last_trade, row_number() over (order by expected, contract) as n from c join md using (contract) where abs(date_diff('day', expected, last_trade)) <= 62""")
def s06_s07_h03_contracts(spark, d):
    """Candidate ids of every code, month and year; metadata far from the expected expiry is another decade's."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    known = o.groupBy(actions.contract_id(F.col("o_orderstatus"), F.month("o_orderdate"), F.col("y")).alias("contract")).agg(F.to_date(F.max("o_orderdate")).alias("last_trade"))
    out = actions.resolve_contracts(actions.contract_candidates(spark, ["F", "O", "P"], [3, 6, 9, 12], 1985, 2001), known)
    return out.select("contract", "expected", "last_trade", F.row_number().over(Window.orderBy("expected", "contract")).alias("n"))  # a dimension


PAID = "dv as (select n_name as ticker, o_orderdate::date as record_date, max(o_totalprice) as value from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderpriority = '1-URGENT' and day(o_orderdate) = 15 group by all)"


@query("with " + PAID + " select * from (select * from dv union all select 'NATION_6', date '1996-01-20', 1.5) where not (month(record_date) = 6)")
def s08_dividends(spark, d):
    """A nested dump per name, the manual extras, and without the keys that were never paid."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.where("o_orderpriority = '1-URGENT' and dayofmonth(o_orderdate) = 15").join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    paid = j.groupBy(F.col("n_name").alias("ticker"), F.to_date("o_orderdate").alias("record_date")).agg(F.max("o_totalprice").alias("value"))
    dump = paid.groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(F.struct("record_date", "value")).alias("dividends"))).alias("json"))
    rows = actions.dividends(dump, "json")
    extra = spark.sql("select 'NATION_6' as ticker, date'1996-01-20' as record_date, 1.5D as value")
    unpaid = rows.where("month(record_date) = 6").select("ticker", "record_date")
    return rows.unionByName(extra).join(unpaid, ["ticker", "record_date"], "left_anti")


@query("with " + PX + ", m as (select n_name as ticker, month from nation, (select unnest(generate_series(date '1995-01-01', date '1995-03-01', interval 1 month))::date as month) where n_nationkey < 10 union select n_name, month from nation, (select unnest(generate_series(date '1995-02-01', date '1995-04-01', interval 1 month))::date as month) where n_nationkey between 5 and 14), h as (select distinct ticker, date_trunc('month', date)::date as month from px where value > 20000000) select m.ticker, m.month from m anti join h using (ticker, month)")
def s13_s14_prefetch_manifest(spark, d):
    """The union of what two configurations need, once each, without what is cached."""
    n = table(spark, d, "nation")

    def needs(lo: int, hi: int, first: str, last: str):
        months = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 month)) as month")
        return n.where(F.col("n_nationkey").between(lo, hi)).select(F.col("n_name").alias("ticker")).crossJoin(F.broadcast(months))

    have = prices(spark, d).where("value > 20000000").select("ticker", F.trunc("date", "month").alias("month")).distinct()
    return tables.manifest([needs(0, 9, "1995-01-01", "1995-03-01"), needs(5, 14, "1995-02-01", "1995-04-01")], ["ticker", "month"]).join(have, ["ticker", "month"], "left_anti")


@query("select n_regionkey, count(*) as n from nation group by 1")
def s15_k11_cached_table(spark, d):
    """Built and written on the first read, read on the second, which may not build."""
    path = place(spark, "cached")
    tables.cached(spark, path, lambda: table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return tables.cached(spark, path)


@query("with " + PX + " select t.ticker from (select unnest(['NATION_0', 'NATION_6', 'NATION_98', 'NATION_99']) as ticker) t anti join px using (ticker)")
def s16_missing_tickers(spark, d):
    return tables.missing_tickers(prices(spark, d), ["NATION_0", "NATION_6", "NATION_98", "NATION_99"])


@query("with " + PX + ", m as (select date, 'MARKET' as ticker, round(avg(close), 4) as close from px group by 1), e as (select cast(ts as date) as date, event_type as ticker, max(value) as close from events group by all) select 'shares' as input, count(*) as n, min(date) as lo, max(date) as hi from px union all select 'index', count(*), min(date), max(date) from m union all select 'bars', count(*), min(date), max(date) from e")
def s17_s18_stage_inputs(spark, d):
    """A stage's three inputs by name; one that is absent would be left out."""
    p = prices(spark, d)
    inputs = {
        "shares": p.select("date", "ticker", "close"),
        "index": p.groupBy("date").agg(F.avg("close").alias("close")).withColumn("ticker", F.lit("MARKET")),
        "bars": table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("ticker")).agg(F.max("value").alias("close")),
    }
    return tables.union_of({k: v.agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")) for k, v in inputs.items()}, "input")


@query("with " + Q + " select vec_id, i - 1 as level, round(q[i], 6) as q from q, range(1, 22) t(i)")
def s19_load_preds(spark, d):
    """Stored quantile forecasts, rearranged as they are read."""
    return vectors(spark, d).select("vec_id", F.posexplode("q").alias("level", "q")).select("vec_id", F.col("level").cast("long").alias("level"), r("q").alias("q"))


@query("with x as (select year(o_orderdate) as fold, right(o_orderpriority, 1) as lr, sum(cast(round(o_totalprice) as bigint)) / count(*) as loss from orders group by all) select fold, arg_min(lr, (loss, lr)) as lr, round(min(loss), 3) as loss from x group by 1")
def s22_m22_fold_records(spark, d):
    """JSON records, one a fold with its runs; the learning rate of the least loss."""
    x = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("fold"), F.right("o_orderpriority", F.lit(1)).alias("lr")).agg((F.sum(F.round("o_totalprice").cast("long")) / F.count("*")).alias("loss"))
    path = place(spark, "folds")
    x.groupBy("fold").agg(F.collect_list(F.struct("lr", "loss")).alias("runs")).write.json(path)
    runs = spark.read.schema("fold int, runs array<struct<lr:string,loss:double>>").json(path).select("fold", F.explode("runs").alias("run")).select("fold", "run.*")
    return runs.groupBy("fold").agg(F.min_by("lr", F.struct("loss", "lr")).alias("lr"), r(F.min("loss"), 3).alias("loss"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def s23_csv_round_trip(spark, d):
    path = place(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", "true").csv(path)
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)


@query("select unnest(['bad', 'datasets', 'end', 'start', 'symbols']) as key, unnest(['end: not a date; datasets: ticks is unknown; symbols: empty', 'candles,stats', '1995-04-10', '1995-01-15', 'A,B']) as value")
def s24_s25_h05_config(spark, d):
    """A configuration as rows, and all errors of a bad one at once."""
    good = tables.PullConfig.parse("# pull\n```yaml\nstart: 1995-01-15\nend: 1995-04-10\ndatasets: [candles, stats]\nsymbols: [A, B]\n```")
    try:
        tables.PullConfig.parse("```yaml\nstart: 1995-01-15\nend: soon\ndatasets: [ticks]\nsymbols: []\n```")
        wrong = ""
    except tables.ConfigError as e:
        wrong = "; ".join(x for x in str(e).split("; ") if x != "start is after end")
    rows = [("start", str(good.start)), ("end", str(good.end)), ("datasets", ",".join(good.datasets)), ("symbols", ",".join(good.symbols)), ("bad", wrong)]
    return spark.createDataFrame(rows, "key string, value string")


@query("select n_nationkey, case when n_regionkey = 1 then upper(n_name) || '!' else n_name end as n_name, n_regionkey from nation where not (n_regionkey = 1 and n_nationkey > 20)")
def k01_replaced_partitions(spark, d):
    """A second write replaces the one partition that it holds."""
    n, path = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), place(spark, "chunks")
    tables.write_chunks(n, path, ["n_regionkey"])
    again = n.where("n_regionkey = 1 and n_nationkey <= 20").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    tables.write_chunks(again, path, ["n_regionkey"])
    return spark.read.schema(n.schema).parquet(path)


@query("with " + PX + ", e as (select n_name as ticker, least(date '2001-06-30', date '2001-06-20' - (14 * n_regionkey)::int) as till from nation) select px.ticker, count(*) as n, max(date) as last, any_value(till) as till from px join e using (ticker) where date >= date '1996-01-01' and date <= till group by 1")
def k04_p07_embargoed_period(spark, d):
    """The period of a dataset ends at today's date less its embargo."""
    till = F.least(F.lit("2001-06-30").cast("date"), F.date_sub(F.lit("2001-06-20").cast("date"), 14 * F.col("n_regionkey")))
    e = table(spark, d, "nation").select(F.col("n_name").alias("ticker"), till.alias("till"))
    p = prices(spark, d).join(F.broadcast(e), "ticker").where((F.col("date") >= F.lit("1996-01-01").cast("date")) & (F.col("date") <= F.col("till")))
    return p.groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.first("till").alias("till"))


TASKS = "mo as (select m as m_lo, last_day(m) as m_hi from (select unnest(generate_series(date '1995-01-01', date '2001-12-01', interval 1 month))::date as m)), pl as (select dataset, ticker, m_lo, m_hi from (select unnest(['closes', 'values', 'alerts']) as dataset), (select n_name as ticker from nation union all select 'NATION_99'), mo)"


def _pulled(spark, d):
    p = written(prices(spark, d), "daily")
    months = spark.sql("select explode(sequence(date'1995-01-01', date'2001-12-01', interval 1 month)) as m_lo").withColumn("m_hi", F.last_day("m_lo"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("ticker")).union(spark.sql("select 'NATION_99'"))
    plan = spark.sql("select explode(array('closes', 'values', 'alerts')) as dataset").crossJoin(names).crossJoin(months)
    raw = place(spark, "raw")
    return raw, pull.pull(plan, {"closes": p.select("date", "ticker", "close"), "values": p.where("value > 5000000").select("date", "ticker", "value")}, raw)


@query("with " + PX + ", " + TASKS + ", n as (select 'closes' as dataset, ticker, date_trunc('month', date)::date as m_lo, count(*) as n from px group by all union all select 'values', ticker, date_trunc('month', date)::date, count(*) from px where value > 5000000 group by all) select dataset, ticker, m_lo, m_hi, case when dataset = 'alerts' then 'blocked' when n is null then 'empty' else 'ok' end as status, coalesce(n, 0) as n_rows from pl left join n using (dataset, ticker, m_lo)")
def k06_k07_pull_outcomes(spark, d):
    """Every task of a plan by dataset, name and month, with its outcome."""
    return _pulled(spark, d)[1]


@query("with " + PX + " select 'closes' as dataset, ticker, count(*) as n_rows, min(date) as first, max(date) as last from px group by 2 union all select 'values', ticker, count(*), min(date), max(date) from px where value > 5000000 group by 2")
def k08_k09_processed_summary(spark, d):
    """Processed tables from the written chunks, their summary written and read as CSV."""
    raw, _ = _pulled(spark, d)
    names = ("closes", "values")
    done = tables.union_of({n: pull.summary(spark.read.parquet(f"{raw}/{n}"), ["ticker"]) for n in names}, "dataset")
    path = place(spark, "summary")
    done.select("dataset", "ticker", "n_rows", "first", "last").write.option("header", "true").csv(path)
    return spark.read.option("header", "true").schema("dataset string, ticker string, n_rows long, first date, last date").csv(path)


@query("with " + DENSE + ", ct as (select ticker, date, ret as last, row_number() over (partition by ticker order by date) as k from p where ret is not null) select ticker, date, round(last, 6) as median, case when date < date '1998-01-01' then 'before' else 'resumed' end as run from ct where k >= 32")
def k10_resumed_forecasts(spark, d):
    """Forecasts written up to a date, then those of the dates that are left."""
    ctx = written(md.contexts(panel(spark, d), "ret", 60), "contexts")
    run = lambda c: md.forecast(c, md.last_value_forecaster, 1)
    done = written(run(ctx.where("date < date'1998-01-01'")), "forecasts")
    rest = run(md.resume(done, ctx))
    both = done.withColumn("run", F.lit("before")).unionByName(rest.withColumn("run", F.lit("resumed")))
    return both.select("ticker", "date", r(F.get("q", 10)).alias("median"), "run")


@query("select o_orderpriority as trial, count(*) as n, null::double as mean from orders group by 1 union all select o_orderstatus, null, round(avg(o_totalprice), 2) from orders group by 1")
def k12_h09_ledger(spark, d):
    """Appends whose columns differ, read as one table."""
    o, path = table(spark, d, "orders"), place(spark, "ledger")
    tables.append_trial(o.groupBy(F.col("o_orderpriority").alias("trial")).agg(F.count("*").alias("n")), path)
    tables.append_trial(o.groupBy(F.col("o_orderstatus").alias("trial")).agg(r(F.avg("o_totalprice"), 2).alias("mean")), path)
    return tables.read_ledger(spark, path).select("trial", "n", "mean")


@query("with u as (" + ORACLE["t01_rank_universe"] + ") select rank, '| ' || ticker || ' | ' || rank || ' |' as line from u where status = 'selected'")
def k14_k15_universe_table(spark, d):
    """The selected names as an audit CSV and as lines of a Markdown table."""
    path = place(spark, "universe")
    QUERIES["t01_rank_universe"](spark, d).write.option("header", "true").csv(path)
    u = spark.read.option("header", "true").schema("ticker string, rank int, status string").csv(path).where("status = 'selected'")
    return u.select("rank", F.format_string("| %s | %d |", "ticker", "rank").alias("line"))


@query("with " + PX + " select ticker, count(*) as n, max(date) as last, sha256(string_agg(date || '=' || value, ';' order by date)) as sha from px where date <= date '2000-12-31' group by 1")
def k18_h11_bundle(spark, d):
    """A table cut at a date and checked, with a digest of each name's rows."""
    p = tables.truncated(prices(spark, d), "2000-12-31")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "value"))), lambda x: F.concat_ws("=", x["date"].cast("string"), x["value"].cast("string"))), ";")
    return p.groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.sha2(text, 256).alias("sha"))


@query("select 'written' as first, 'refused' as second, count(*) as n from region")
def k17_single_use(spark, d):
    path, t = place(spark, "test"), table(spark, d, "region")
    n = tables.single_use(spark, path, t).count()
    try:
        tables.single_use(spark, path, t)
        second = "written"
    except tables.EngineError:
        second = "refused"
    return spark.createDataFrame([("written", second, n)], "first string, second string, n long")


@query("select n_regionkey as region, cast(n_nationkey as varchar) as id, n_name as name from nation")
def p01_block_rows(spark, d):
    """{block: {columns, data}} documents to rows."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("data"))
    docs = n.select("region", F.to_json(F.struct(F.struct(F.array(F.lit("id"), F.lit("name")).alias("columns"), "data").alias("rows"))).alias("json"))
    return tables.blocks(docs, "json", "rows").select("region", F.col("row")["id"].alias("id"), F.col("row")["name"].alias("name"))


@query("select event_id, ts - interval 3 hour as utc from events")
def p03_local_to_utc(spark, d):
    """Times without a zone are Moscow's."""
    return table(spark, d, "events").select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Moscow").cast("timestamp_ntz").alias("utc"))


@query("select c_custkey as code, 'long' as side, greatest(c_acctbal, 0) as position, lower(c_mktsegment) as client from customer union all select c_custkey, 'short', greatest(-c_acctbal, 0), lower(c_mktsegment) from customer")
def p04_p06_normalized(spark, d):
    """Selected and renamed columns, and wide positions as rows by side."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.lower("c_mktsegment").alias("client"), F.greatest("c_acctbal", F.lit(0.0)).alias("long"), F.greatest(-F.col("c_acctbal"), F.lit(0.0)).alias("short"))
    return c.unpivot(["code", "client"], ["long", "short"], "side", "position")
