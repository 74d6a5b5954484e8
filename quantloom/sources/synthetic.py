"""Seeded panels with planted effects, as plans over spark.range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _grid(spark: SparkSession, dates: int, tickers: int) -> DataFrame:
    g = spark.range(dates * tickers).select((F.col("id") / tickers).cast("long").alias("pos"), (F.col("id") % tickers).alias("k"))
    return g.select("pos", F.date_add(F.lit("2020-01-01").cast("date"), F.col("pos").cast("int")).alias("date"), F.format_string("T%03d", "k").alias("ticker"))


def normal(seed: int, *keys: str):
    """Standard normal draws that depend on the seed and the keys only, not on partitions."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))


def planted_panel(spark: SparkSession, dates: int, tickers: int, ic: float, seed: int = 0, span: int = 5) -> DataFrame:
    """(pos, date, ticker, signal, ret): returns load on the mean of the last `span` signals with correlation ic."""
    g = _grid(spark, dates, tickers).withColumn("signal", normal(seed, "pos", "ticker"))
    w = Window.partitionBy("ticker").orderBy("pos").rowsBetween(-span, -1)
    past = F.coalesce(F.avg("signal").over(w) * span**0.5, F.lit(0.0))
    return g.withColumn("ret", 0.02 * (ic * past + (1 - ic * ic) ** 0.5 * normal(seed + 1, "pos", "ticker")))


def market_panel(spark: SparkSession, dates: int, tickers: int, seed: int = 0, market: float = 0.01, own: float = 0.015) -> DataFrame:
    """(pos, date, ticker, beta, ret): one common factor with betas from 0.5 to 1.5, and noise."""
    g = _grid(spark, dates, tickers).withColumn("beta", 0.5 + F.pmod(F.xxhash64(F.lit(seed), "ticker"), F.lit(1 << 30)) / float(1 << 30))
    return g.withColumn("ret", F.col("beta") * market * normal(seed + 1, "pos") + own * normal(seed + 2, "pos", "ticker"))


def inject_burst(panel: DataFrame, leader: str, follower: str, lag: int, threshold: float, size: float, chance: float, seed: int = 0) -> DataFrame:
    """The follower's return, `lag` rows after leader returns beyond the threshold, becomes size in their direction,
    with the given chance."""
    hit = panel.where((F.col("ticker") == leader) & (F.abs("ret") > threshold)).select((F.col("pos") + lag).alias("pos"), F.signum("ret").alias("_dir"))
    lucky = F.pmod(F.xxhash64(F.lit(seed), "pos"), F.lit(1 << 30)) < chance * (1 << 30)
    j = panel.join(F.broadcast(hit), "pos", "left")
    return j.withColumn("ret", F.when((F.col("ticker") == follower) & F.col("_dir").isNotNull() & lucky, F.col("_dir") * size).otherwise(F.col("ret"))).drop("_dir")
