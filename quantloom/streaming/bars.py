"""Structured Streaming over event tables: bars, sessions, deduplication, keyed state and incremental sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.joins import dedupe_last
from quantloom.sources.tables import exists


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def in_name_order(spark: SparkSession, path: str) -> None:
    """Gives a table's files modification times in the order of their names, the order in which a stream reads them;
    tasks end in any order, and a stream that meets the latest file first drops the others' rows as late."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(folder) if f.isFile()), key=lambda f: f.getPath().getName())
    latest = max((f.getModificationTime() for f in files), default=0)
    for k, f in enumerate(files):
        fs.setTimes(f.getPath(), latest - 1000 * (len(files) - k), -1)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; event times without one are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def bars(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "14 days") -> DataFrame:
    """(start, event_type, n, value, close): tumbling or sliding bars; rows later than `late` are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = _timed(events, late).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max_by("value", F.struct("ts", "event_id")).alias("close")).select(F.col("w.start").alias("start"), "event_type", "n", "value", "close")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "14 days") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no longer gap."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str] | None = None, late: str = "14 days") -> DataFrame:
    """(day, keys, last): of a day's events with equal keys the one with the latest (ts, event_id), as a struct.

    The day is part of the key, so that the watermark can drop a day's state once it is past."""
    keys = keys or ["event_id"]
    g = _timed(events, late).groupBy(F.window("ts", "1 day").alias("w"), *keys)
    last = F.max_by(F.struct(*(c for c in events.columns if c not in keys)), F.struct("ts", "event_id")).alias("last")
    return g.agg(last).select(F.col("w.start").alias("day"), *keys, "last")


def ewma_state(events: DataFrame, keep: float = 0.94) -> DataFrame:
    """(event_type, n, ewma) after each trigger: the recursion s = keep*s + (1-keep)*value, in event order within a
    trigger, carried in keyed state between triggers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for v in rows["value"].dropna():
            s = v if n == 0 else keep * s + (1 - keep) * v
            n += 1
        state.update((n, float(s)))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "ewma": [float(s)]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, ewma double", "n long, s double", "update", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, path: str, checkpoint: str, partition: list[str], keys: list[str], seq: list[str], once: bool = True):
    """Merges each batch into a partitioned table: of rows with equal keys the last by seq stays.

    Of the table only the partitions that the batch touches are read; what they become is written beside the table
    first, then replaces them, so that a batch that is run again ends the same. Keys lie within a partition."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = batch.select(*partition).distinct()
        old = [spark.read.schema(batch.schema).parquet(path).join(F.broadcast(touched), partition, "left_semi")] if exists(spark, path) else []
        rows = old[0].unionByName(batch) if old else batch
        stage = f"{checkpoint}/merged/{number}"
        dedupe_last(rows, [*partition, *keys], seq).write.mode("overwrite").parquet(stage)
        merged = spark.read.schema(batch.schema).parquet(stage)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
        batch.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its last result, a table at path."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
