"""As-of, range and causal joins, splices and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, on: str, value: str, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """left with the latest right.value at or before (strict: before) left.on, per `by`.

    One union and one window: rows of both sides are sorted together, so that cost is a shuffle by `by` and a sort,
    whatever the number of matches. Without `by`, pre-aggregate to one row a date first."""
    by = by or []
    keep = left.columns
    first, second = F.lit(0), F.lit(1)  # of rows at equal times
    a = left.withColumns({"_side": first if strict else second, "_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(True)})
    b = right.select(*by, on, (second if strict else first).alias("_side"), F.col(value).alias("_v"), F.lit(False).alias("_left"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left").select(*keep, F.col("_v").alias(value))


def in_windows(rows: DataFrame, windows: DataFrame, key: str, at: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows inside one of their key's [lo, hi] windows, once; rows of unknown keys are dropped."""
    w = windows.select(F.col(key).alias("_k"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    return rows.join(w, (F.col(key) == F.col("_k")) & F.col(at).between(F.col("_lo"), F.col("_hi")), "left_semi")


def causal_pairs(dates: DataFrame, rows: DataFrame, horizon: int, window: int) -> DataFrame:
    """rows (pos, ...) for each refit date (t): those with t-horizon-window < pos <= t-horizon."""
    return dates.join(rows, (F.col("pos") <= F.col("t") - horizon) & (F.col("pos") > F.col("t") - horizon - window))


def offset_self_join(panel: DataFrame, lag: int, x: str = "r") -> DataFrame:
    """(pos, leader, follower, x_leader, x_follower at pos+lag) for different tickers."""
    a = panel.select("pos", F.col("ticker").alias("leader"), F.col(x).alias("x_leader"))
    b = panel.select((F.col("pos") - lag).alias("pos"), F.col("ticker").alias("follower"), F.col(x).alias("x_follower"))
    return a.join(b, "pos").where("leader <> follower")


def key_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(missing, extra, duplicated): keys of left that right lacks, of right that left lacks, and that right repeats."""
    a, b = left.select(*keys).distinct(), right.groupBy(*keys).count()
    j = a.withColumn("_l", F.lit(1)).join(b, keys, "full")
    return j.agg(F.coalesce(F.sum(F.when(F.col("count").isNull(), 1)), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("_l").isNull(), 1)), F.lit(0)).alias("extra"), F.coalesce(F.sum(F.when(F.col("count") > 1, 1)), F.lit(0)).alias("duplicated"))


def splice(base: DataFrame, tuned: DataFrame, keys: list[str], span) -> DataFrame:
    """base with the rows of `span` replaced by tuned; refuses tuned rows whose keys aren't exactly those replaced."""
    r = key_report(base.where(span), tuned, keys).first()
    if any(r):
        raise ValueError(f"keys differ: {r['missing']} missing, {r['extra']} extra, {r['duplicated']} duplicated")
    return base.where(~span).unionByName(tuned.select(*base.columns))


def dedupe_last(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last row of each key by an explicit sequence."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def parity(left: DataFrame, right: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(both, only_left, only_right, max_rel): a full outer comparison of one column."""
    j = left.select(*keys, F.col(x).alias("_a")).join(right.select(*keys, F.col(x).alias("_b")), keys, "full")
    rel = F.abs(F.col("_a") - F.col("_b")) / F.nullif(F.abs(F.col("_b")), F.lit(0.0))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return j.agg(n(a & b).alias("both"), n(a & ~b).alias("only_left"), n(~a & b).alias("only_right"), F.max(rel).alias("max_rel"))
