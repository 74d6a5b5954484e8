"""Arms (named forecasts as long tables), their common universe, scores, paired comparisons and selection rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import stats as st
from quantloom.operators.windows import series


def as_arms(panel: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, arm, f): the columns as arms, a row each; nulls are kept, as they gate the universe."""
    return panel.select(*(keys or ["date", "ticker"]), *columns).unpivot(keys or ["date", "ticker"], columns, "arm", "f")


def gates(arm: str = "arm", prefix: str = "mix_") -> Column:
    """Arms that may shrink the universe: all but those made of others."""
    return ~F.startswith(F.col(arm), F.lit(prefix))


def common_universe(arms: DataFrame, keys: list[str] | None = None, gate: Column | None = None) -> DataFrame:
    """(keys): cells that every gating arm forecasts. One aggregation by cell, whatever the number of arms."""
    keys = keys or ["date", "ticker"]
    g = arms.where(gate if gate is not None else gates())
    return g.groupBy(*keys).agg(F.count("f").alias("_f"), F.count("*").alias("_n")).where("_f = _n").select(*keys)


def same_universe(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(lost): cells of the universe before that new arms lose; 0 is what is asked for."""
    return before.join(after, keys or ["date", "ticker"], "left_anti").agg(F.count("*").alias("lost"))


def twin(arm: Column) -> Column:
    """The name of an arm's twin: tuned forecasts against those of the pretrained model."""
    return F.replace(F.replace(arm, F.lit("_tuned"), F.lit("")), F.lit("f_"), F.lit("z_"))


def scores(arms: DataFrame, outcome: DataFrame, loss, keys: list[str] | None = None) -> DataFrame:
    """(date, arm, loss, n): mean loss(y, f) by date over the common universe; outcome (keys, y)."""
    keys = keys or ["date", "ticker"]
    cells = common_universe(arms, keys)
    rows = arms.join(cells, keys).join(outcome.where("y is not null"), keys)
    return rows.groupBy("date", "arm").agg(F.avg(loss(F.col("y"), F.col("f"))).alias("loss"), F.count("*").alias("n"))


def against(daily: DataFrame, base: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """(arm, by, n, mean, se, t) of each arm's daily loss less that of the arm `base`, with Bartlett weights.

    Each date's base is a value of the date's own window, not a join."""
    w = Window.partitionBy("date", *(by or []))
    x = daily.withColumn("_d", F.col("loss") - F.max(F.when(F.col("arm") == base, F.col("loss"))).over(w)).where(F.col("arm") != base)
    return st.newey_west(x, "_d", "date", lags, ["arm", *(by or [])])


def head_to_head(daily: DataFrame, pairs: list[tuple[str, str]], lags: int) -> DataFrame:
    """(a, b, n, mean, se, t) of loss a less loss b for listed pairs of arms."""
    spark = daily.sparkSession
    p = F.broadcast(spark.createDataFrame(pairs, "a string, b string"))
    wide = daily.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("arm", "loss"))).alias("m"))  # as many as there are arms
    x = wide.crossJoin(p).select("date", "a", "b", (F.col("m")[F.col("a")] - F.col("m")[F.col("b")]).alias("d"))
    return st.newey_west(x, "d", "date", lags, ["a", "b"])


def autocorrelation(x: str, lag: int, least: int = 30, by: str = "ticker") -> Column:
    """Aggregate over rows with `_lag`, made by with_lag: correlation with the value `lag` rows before."""
    return F.when(F.count(F.when(F.col("_lag").isNotNull(), F.col(x))) >= least, st.safe_corr(x, "_lag"))


def with_lag(df: DataFrame, x: str, lag: int) -> DataFrame:
    return df.withColumn("_lag", F.lag(x, lag).over(series()))


def power(stats: DataFrame, margin: float, z: float = 1.645) -> DataFrame:
    """stats (n, mean, se) with the half width of the interval, the rows that would show `margin`, and the verdict."""
    need = F.ceil(F.col("n") * F.pow(z * F.col("se") / margin, F.lit(2)))
    return stats.withColumns({"lo": F.col("mean") - z * F.col("se"), "hi": F.col("mean") + z * F.col("se"), "rows_needed": need, "non_inferior": F.col("mean") + z * F.col("se") < margin})


def claims(tests: DataFrame, claim: str = "claim", t: str = "t", critical: float = -1.645) -> DataFrame:
    """(claim, worst_t, holds): a claim over several uses holds if the weakest of its tests rejects."""
    return tests.groupBy(claim).agg(F.max(t).alias("worst_t"), F.count("*").alias("uses")).withColumn("holds", F.col("worst_t") < critical)


def ic_stats(panel: DataFrame, signals: list[str], forward: str, lags: int, least: int = 10) -> DataFrame:
    """(signal, n, mean, se, t) of daily rank correlations, for all signals in one pass over the long table."""
    from quantloom.operators.xsection import pct_rank

    long = panel.select("date", "ticker", forward, *signals).unpivot(["date", "ticker", forward], signals, "signal", "s")
    both = long.where(F.col("s").isNotNull() & F.col(forward).isNotNull()).withColumn("_k", F.struct("date", "signal"))
    ranked = both.withColumns({"_s": pct_rank("s", "_k"), "_f": pct_rank(forward, "_k")})
    ic = ranked.groupBy("date", "signal").agg(st.safe_corr("_s", "_f").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)
    return st.newey_west(ic, "ic", "date", lags, ["signal"])


def duan(fitted: Column, resid: Column) -> Column:
    """Aggregate: the smearing factor that takes a logarithmic fit back to levels without bias."""
    return F.avg(F.exp(F.when(fitted.isNotNull(), resid)))


def realized_by_bar(daily: DataFrame, rows: DataFrame) -> DataFrame:
    """A daily table put onto rows of the same date and name."""
    return rows.join(daily, ["date", "ticker"])


def align(parts: dict[str, DataFrame], calendar: DataFrame, limit: int) -> DataFrame:
    """(date, one column a part): series (date, x) of different calendars on one, each filled forward over the dates of
    all of them, at most `limit` of the calendar's rows; one row a date."""
    every = reduce(DataFrame.union, [p.select("date") for p in parts.values()], calendar.select("date")).distinct()
    out = every.join(calendar.select("date", F.lit(True).alias("_on")), "date", "left")
    for k, p in parts.items():
        out = out.join(p.select("date", F.col("x").alias(k)), "date", "left")
    w = Window.orderBy("date")  # a row a date
    back = w.rowsBetween(-limit, 0)
    return out.withColumns({k: F.last(k, ignorenulls=True).over(back) for k in parts}).where("_on").drop("_on")
