"""Connected components of an edge table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v) with v < u the least member of u's component, for every u that isn't itself the least.

    edges: two columns of one ordered type; loops and repeated or reversed edges are allowed, nulls are dropped.
    Each round's edges are written to the shared folder; there are as many rounds as the edges need to settle, about
    the logarithm of the longest chain; a round's edges are deleted once the next are written. `rounds` is a guard that raises, not a cap."""
    a, b = edges.columns[:2]
    edges = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            return edges
        done, edges = edges, materialize(_small(_large(edges)), "edges")
        discard(done)
        if (now := mark(edges)) == before:
            return edges
        before = now
    raise RuntimeError("components have not settled")
