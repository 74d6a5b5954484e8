"""Streams over the event table, drained, against the same results in batch SQL; injected functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import models as md
from quantloom.plans.base import DENSE, panel, query, r, table
from quantloom.sources.shared import place, written
from quantloom.streaming import bars as sb


def _events(spark, d):
    """The event table in four files by time, one a trigger."""
    e, path = table(spark, d, "events"), place(spark, "events")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    sb.in_name_order(spark, path)
    return sb.event_stream(spark, path, e.schema)


def _drained(spark, stream, mode="complete"):
    return sb.drain(stream, place(spark, "stream"), place(spark, "stream-state"), mode)


BAR = "count(*) as n, round(sum(value), 4) as value, arg_max(value, (ts, event_id)) as close"


@query("select time_bucket(interval '10 minutes', ts) as start, event_type, " + BAR + " from events group by all")
def x13_tumbling_bars(spark, d):
    out = _drained(spark, sb.bars(_events(spark, d)))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("value", 4).alias("value"), "close")


@query("select time_bucket(interval '10 minutes', ts) - to_minutes(10 * k) as start, event_type, " + BAR + " from events, (select unnest(range(6))::int as k) group by all")
def x13_sliding_bars(spark, d):
    out = _drained(spark, sb.bars(_events(spark, d), "60 minutes", "10 minutes"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("value", 4).alias("value"), "close")


@query("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval 30 minute as end_, count(*) as n from s group by user_id, k")
def x13_sessions(spark, d):
    out = _drained(spark, sb.sessions(_events(spark, d)))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_"), "n")


@query("select cast(ts as date) as day, user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by all")
def x13_keep_last(spark, d):
    out = _drained(spark, sb.deduplicated(_events(spark, d), ["user_id", "event_type"]))
    return out.select(F.to_date("day").alias("day"), "user_id", "event_type", "last.event_id", "last.value")


@query("select cast(ts as date) as day, user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by all")
def x13_upserts(spark, d):
    """Batches merged into a table by day; days that several batches touch keep all their users."""
    s = _events(spark, d).select(F.to_date("ts").alias("day"), "user_id", "ts", "event_id", "value")
    path = place(spark, "upserted")
    sb.upsert(s, path, place(spark, "upsert-state"), ["day"], ["user_id"], ["ts", "event_id"]).awaitTermination()
    return spark.read.schema(s.schema).parquet(path).select("day", "user_id", "event_id", "value")


@query("with q as (select *, event_type as ticker, row_number() over (partition by event_type order by ts, event_id) as i from events where value is not null) select event_type, max(i) as n, round(max(pow(0.94::double, c - 1)) * sum(case when i = 1 then value else value * 0.06 * pow(0.94::double, 1 - i) end), 5) as ewma from (select *, max(i) over (partition by event_type) as c from q where i > 0) group by 1")
def x13_keyed_state(spark, d):
    """The recursive mean after the last trigger, carried in keyed state between them."""
    path, s = place(spark, "states"), sb.ewma_state(_events(spark, d))

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    s.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", place(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("event_type string, n long, ewma double, batch int").parquet(path)
    return out.groupBy("event_type").agg(F.max("n").alias("n"), r(F.max_by("ewma", "batch"), 5).alias("ewma"))


CT = "ct as (select ticker, date, ret as last, row_number() over (partition by ticker order by date) as k from p where ret is not null)"


@query("with " + DENSE + ", " + CT + " select ticker, count(*) as n, round(sum(last), 5) as total, round(sum(sign(round(last, 6))), 1) as up from ct join nation on n_name = ticker where k >= 32 group by 1")
def x14_injected_functions(spark, d):
    """A quantile pipeline called once a date and group, and features from what it returns."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("grp"))
    ctx = md.contexts(panel(spark, d), "ret", 60).join(F.broadcast(n), "ticker")
    f = written(md.forecast(ctx, md.last_value_forecaster, 1, group=["grp"]), "forecasts")
    features = lambda x: x.withColumn("median", F.get("q", 10)).withColumn("up", F.signum(F.round("median", 6)))
    return f.transform(features).groupBy("ticker").agg(F.count("*").alias("n"), r(F.sum("median"), 5).alias("total"), r(F.sum("up"), 1).alias("up"))
