"""Scans, incremental chunks, sinks and configuration."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EngineError(Exception):
    """Base of the engine's errors."""


class ConfigError(EngineError):
    """All problems of a configuration at once."""


class CacheMiss(EngineError):
    """A cached input is absent and no fallback is allowed."""


class SubscriptionError(EngineError):
    """The remote service refuses a dataset."""


def load_long(spark: SparkSession, path: str, tickers: list[str] | None = None, columns: list[str] | None = None, end: str | None = None, ts: str = "timestamp") -> DataFrame:
    """A Parquet scan; the projection, the IN-list and the end date (inclusive) reach the reader."""
    df = spark.read.parquet(path)
    if tickers is not None:
        df = df.where(F.col("ticker").isin(*tickers))
    if end is not None:
        df = df.where(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast(df.schema[ts].dataType))
    return df.select(*columns) if columns else df


def missing_tickers(df: DataFrame, tickers: list[str]) -> DataFrame:
    want = df.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    return want.join(df.select("ticker").distinct(), "ticker", "left_anti")


def numeric_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with those string columns as doubles that lose no value by it."""
    counts = df.agg(*(F.count(c).alias(f"a{i}") for i, c in enumerate(columns)), *(F.count(F.col(c).try_cast("double")).alias(f"b{i}") for i, c in enumerate(columns))).first()
    ok = [c for i, c in enumerate(columns) if counts[f"a{i}"] == counts[f"b{i}"]]
    return df.withColumns({c: F.col(c).try_cast("double") for c in ok})


def month_chunks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(lo, hi): calendar months clipped to the period."""
    m = spark.sql(f"select explode(sequence(trunc(date'{start}', 'MM'), date'{end}', interval 1 month)) as m")
    return m.select(F.greatest("m", F.lit(start).cast("date")).alias("lo"), F.least(F.last_day("m"), F.lit(end).cast("date")).alias("hi"))


def effective_end(end: str, today: str, embargo_days: int = 0) -> date:
    return min(date.fromisoformat(end), date.fromordinal(date.fromisoformat(today).toordinal() - embargo_days))


def plan_tasks(datasets: DataFrame, symbols: DataFrame, months: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Every (dataset, symbol, month) to have; with windows (symbol, lo, hi), only months that overlap the symbol's.
    A product of three small dimensions."""
    plan = datasets.crossJoin(F.broadcast(symbols)).crossJoin(F.broadcast(months.withColumnsRenamed({"lo": "m_lo", "hi": "m_hi"})))
    if windows is not None:
        plan = plan.join(F.broadcast(windows), "symbol").where((F.col("m_lo") <= F.col("hi")) & (F.col("m_hi") >= F.col("lo"))).drop("lo", "hi")
    return plan


def stale_tasks(plan: DataFrame, manifest: DataFrame, keys: list[str], current_month: str) -> DataFrame:
    """Tasks that aren't in the manifest, empty chunks counted as present, and those of the current month."""
    done = manifest.where("status in ('ok', 'empty')").select(*keys).distinct()
    now = F.lit(current_month).cast("date").between(F.col("m_lo"), F.col("m_hi"))
    return plan.where(~now).join(done, keys, "left_anti").unionByName(plan.where(now))


def manifest(needs: list[DataFrame], keys: list[str]) -> DataFrame:
    """What several configurations need, each key once."""
    return reduce(DataFrame.unionByName, needs).dropDuplicates(keys)


def union_of(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Tables of equal columns as one, with the name of each in `label`."""
    return reduce(DataFrame.unionByName, (v.withColumn(label, F.lit(k)) for k, v in parts.items()))


def write_chunks(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replaces the partitions that df holds, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def append_trial(df: DataFrame, path: str) -> None:
    """Appends to a ledger whose columns may differ between writes (read it with read_ledger)."""
    df.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build=None) -> DataFrame:
    """The table at path, built and written first if it isn't there; without `build`, CacheMiss."""
    if not exists(spark, path):
        if build is None:
            raise CacheMiss(path)
        build().write.parquet(path)
    return spark.read.parquet(path)


def single_use(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """Writes a result that may be made once; a second time is refused."""
    if exists(spark, path):
        raise EngineError(f"{path} has been evaluated")
    df.write.parquet(path)
    return spark.read.parquet(path)


def truncated(df: DataFrame, cutoff: str, col: str = "date") -> DataFrame:
    """Rows up to the cutoff, checked."""
    out = df.where(F.col(col) <= F.lit(cutoff).cast("date"))
    last = out.agg(F.max(col)).first()[0]
    if last is not None and str(last) > cutoff:
        raise EngineError(f"rows after {cutoff}")
    return out


def to_markdown(df: DataFrame, n: int = 20) -> str:
    rows = df.limit(n).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])


def block_rows(spark: SparkSession, payload: str, block: str) -> DataFrame:
    """Rows of a {block: {columns, data}} document, one string map each."""
    return blocks(spark.createDataFrame([(payload,)], "payload string"), "payload", block).select("row")


def blocks(df: DataFrame, payload: str, block: str) -> DataFrame:
    """df with row, a map from column name to value, for each row of its documents' block; none where it is absent."""
    one = F.from_json(payload, f"`{block}` struct<columns:array<string>,data:array<array<string>>>")[block]
    each = df.withColumn("_b", one).withColumn("_r", F.explode("_b.data"))
    return each.withColumn("row", F.map_from_arrays("_b.columns", "_r")).drop("_b", "_r")


@dataclass(frozen=True)
class PullConfig:
    """Period, datasets, symbols and intervals of a pull, as given in the first YAML-like block of a Markdown file."""

    start: date
    end: date
    datasets: tuple[str, ...]
    symbols: tuple[str, ...]
    options: dict[str, str] = field(default_factory=dict)

    KNOWN = ("candles", "stats", "positions", "alerts")

    @classmethod
    def parse(cls, markdown: str) -> PullConfig:
        """Reads key: value lines (lists in brackets) of the first fenced yaml block; reports all errors together."""
        m = re.search(r"```ya?ml\n(.*?)```", markdown, re.S)
        if not m:
            raise ConfigError("no yaml block")
        values = dict(re.findall(r"^(\w+):\s*(.*?)\s*(?:#.*)?$", m.group(1), re.M))
        wrong: list[str] = []

        def day(key: str) -> date:
            try:
                return date.fromisoformat(values.pop(key, ""))
            except ValueError:
                wrong.append(f"{key}: not a date")
                return date.min

        lists = {k: tuple(x.strip() for x in values.pop(k, "").strip("[]").split(",") if x.strip()) for k in ("datasets", "symbols")}
        start, end = day("start"), day("end")
        wrong += [f"datasets: {d} is unknown" for d in lists["datasets"] if d not in cls.KNOWN]
        wrong += [f"{k}: empty" for k, v in lists.items() if not v]
        if start > end:
            wrong.append("start is after end")
        if wrong:
            raise ConfigError("; ".join(wrong))
        return cls(start, end, lists["datasets"], lists["symbols"], values)
