"""The incremental pull: a plan of chunks, a scan for each dataset, written chunks, outcomes and processed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import actions, joins
from quantloom.sources import tables


def pull(plan: DataFrame, scans: dict[str, DataFrame], raw: str) -> DataFrame:
    """Writes the plan's chunks (dataset, ticker, m_lo, m_hi) to raw/<dataset> and returns each task with its status:
    ok, empty, or blocked where the dataset has no scan (no subscription).

    A scan is a table (date, ticker, ...). One job a dataset reads all its chunks at once, partitions by month."""
    done = []
    for name, scan in scans.items():
        tasks = plan.where(F.col("dataset") == name)
        rows = scan.withColumn("month", F.trunc("date", "month"))
        want = tasks.select("ticker", F.trunc("m_lo", "month").alias("month"), "m_lo", "m_hi")
        got = rows.join(F.broadcast(want), ["ticker", "month"]).where(F.col("date").between(F.col("m_lo"), F.col("m_hi"))).drop("m_lo", "m_hi")
        path = f"{raw}/{name}"
        tables.write_chunks(got, path, ["month"])
        back = plan.sparkSession.read.schema(got.schema).parquet(path)
        done.append(back.groupBy(F.lit(name).alias("dataset"), "ticker", "month").agg(F.count("*").alias("n_rows")))
    counts = reduce(DataFrame.unionByName, done)
    out = plan.withColumn("month", F.trunc("m_lo", "month")).join(counts, ["dataset", "ticker", "month"], "left")
    status = F.when(~F.col("dataset").isin(*scans), "blocked").when(F.col("n_rows").isNull(), "empty").otherwise("ok")
    return out.select("dataset", "ticker", "m_lo", "m_hi", status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def finalize(rows: DataFrame, keys: list[str], seq: list[str], period: tuple, windows: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """A processed table from raw rows (date, ticker, close, contract, ...): the period, the contracts' windows, the
    last of repeated rows, the roll flag and the adjusted close, in this order."""
    out = rows.where(F.col("date").between(*(F.lit(x).cast("date") for x in period)))
    if windows is not None:
        out = joins.in_windows(out, F.broadcast(windows), "ticker", "date")
    out = joins.dedupe_last(out, keys, seq)
    out = out.withColumn("roll", actions.roll_flag(Window.partitionBy("ticker").orderBy("date")))
    if events is not None:
        adjusted = actions.adjusted_close(out.select("ticker", "date", "close"), events).select("ticker", "date", "close_adj")
        out = out.join(adjusted, ["ticker", "date"])
    return out


def summary(processed: DataFrame, by: list[str], at: str = "date") -> DataFrame:
    """(by, n_rows, first, last) of a processed table."""
    return processed.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(at).alias("first"), F.max(at).alias("last"))
