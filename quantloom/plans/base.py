"""Tables as panels, the registry of queries, and the SQL fragments that the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import panel as pn
from quantloom.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; never -0.0."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, close, value): daily average price and turnover in cents of each nation's suppliers."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_suppkey", "l_quantity", cents.alias("cents"))
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    rows = li.join(su, li.l_suppkey == su.s_suppkey).join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))
    out = rows.groupBy("date", "ticker").agg(F.sum("cents").alias("value"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    # whole numbers up to the last division: every engine rounds alike
    return out.select("date", "ticker", (F.expr("(200 * value + q) div (2 * q)") / 10000.0).alias("close"), "value")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense daily panel: raw, close (filled 5 rows), stale, ret, value.

    The daily prices are written once: dates, names and cells all come from them, so that the bars are read once."""
    p = written(prices(spark, sf_dir), "daily")
    return pn.daily_panel(p, p.select("date").distinct())


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as bars: (timestamp, ticker, close, seq, user_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("ticker"), F.col("value").alias("close"), F.col("event_id").alias("seq"), "user_id")


PX = """px as (select cast(l_shipdate as date) as date, n_name as ticker,
  (200 * sum(cast(round(l_extendedprice * 100) as bigint)) + sum(cast(l_quantity as bigint))) // (2 * sum(cast(l_quantity as bigint))) / 10000.0::double as close,
  cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)"""
DENSE = PX + """, sk as (select date, ticker, close as raw, coalesce(value, 0) as value
  from (select distinct date from px) cross join (select distinct ticker from px) left join px using (date, ticker)),
fl as (select *, last_value(raw ignore nulls) over (partition by ticker order by date rows between 5 preceding and current row) as close from sk),
p as (select *, raw is null and close is not null as stale, ln(close) - lag(ln(close)) over (partition by ticker order by date) as ret from fl)"""
BARS = """b as (select ts as timestamp, event_type as ticker, value as close, event_id as seq, user_id from events)"""
SESSION = BARS + """, s as (select *, cast(timestamp as date) as date from b where strftime(timestamp, '%H:%M') between '09:50' and '18:50')"""


def w(n: int, lag: int = 0) -> str:
    """A trailing frame of n rows of a ticker, in SQL."""
    end = "current row" if not lag else f"{lag} preceding"
    return f"(partition by ticker order by date rows between {n - 1 + lag} preceding and {end})"
