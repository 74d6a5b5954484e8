"""Arms and their evaluation, walk-forward runs, stage compositions and the tables behind the figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import losses, special
from quantloom.operators import evaluation as ev, joins, models as md, panel as pn, stats as st
from quantloom.operators import windows as wn
from quantloom.operators import xsection as xs
from quantloom.plans.base import DENSE, PX, SESSION, bars, panel, prices, query, r, table, w
from quantloom.plans.joins_q import RATES, WINDOWS, _rates
from quantloom.plans.models_q import positions
from quantloom.plans.quantiles_q import Q, vectors
from quantloom.plans.stats_q import VL, loss_panel, nw_sql
from quantloom.plans.windows_q import ewm_sql
from quantloom.sources import jobs, pull, synthetic
from quantloom.sources.shared import place, written

ARMS = ["m5", "m22", "ew", "mix_a"]
ARM_SQL = "q as (select *, ret * ret as x from p), " + ewm_sql("q", "x", "0.94::double") + f""", a0 as (select date, ticker, case when count(x) over {w(5)} >= 5 then avg(x) over {w(5)} end as m5, case when count(x) over {w(22)} >= 22 then avg(x) over {w(22)} end as m22, case when i >= 20 then s end as ew, lead(ret) over (partition by ticker order by date) ** 2 as y from ew),
a1 as (select *, sqrt(m5 * m22) as mix_a from a0), uv as (select date, ticker, y, unnest(['m5', 'm22', 'ew', 'mix_a']) as arm, unnest([m5, m22, ew, mix_a]) as f, m5 is not null and m22 is not null and ew is not null as ok from a1)"""
SCORES = ARM_SQL + ", sc as (select date, arm, avg(case when y > 0 and f > 0 then y / f - ln(y / f) - 1 end) as loss, count(*) as n from uv where ok and y is not null group by all)"


def arm_panel(spark, d) -> DataFrame:
    """The classical volatility arms and a mixture of two, with the next squared return as outcome."""
    p = panel(spark, d).withColumn("x", F.col("ret") * F.col("ret"))
    e = wn.ewm(p.select("date", "ticker", "ret", "x"), "x", "ew", 0.94, 20)
    e = e.withColumns({"m5": wn.rolling_mean(F.col("x"), 5, 5), "m22": wn.rolling_mean(F.col("x"), 22, 22), "y": F.pow(F.lead("ret").over(wn.series()), F.lit(2))})
    return e.select("date", "ticker", "y", "m5", "m22", "ew", F.sqrt(F.col("m5") * F.col("m22")).alias("mix_a"))


def daily_scores(spark, d) -> DataFrame:
    p = written(arm_panel(spark, d), "arms")
    return ev.scores(ev.as_arms(p, ARMS), p.select("date", "ticker", "y"), losses.qlike)


@query("with " + DENSE + ", " + ARM_SQL + " select arm, ticker, count(f) as n, round(avg(f), 7) as mean from uv group by all")
def m23_m24_p13_arms(spark, d):
    """All arms in one table; a selection is a filter on its arm column."""
    return ev.as_arms(arm_panel(spark, d), ARMS).groupBy("arm", "ticker").agg(F.count("f").alias("n"), r(F.avg("f"), 7).alias("mean"))


@query("with " + DENSE + ", " + ARM_SQL + ", u as (select distinct date, ticker from uv where ok) select arm, case arm when 'f_m5_tuned' then 'z_m5' else replace(replace(arm, '_tuned', ''), 'f_', 'z_') end as twin, not starts_with(arm, 'mix_') as gates, (select count(*) from u) as cells, 0::bigint as lost from (select unnest(['m5', 'm22', 'ew', 'mix_a', 'f_m5_tuned']) as arm)")
def p16_p17_p27_gates(spark, d):
    """Arms that gate the universe, their twins' names, and what the others take from it: nothing."""
    arms = written(ev.as_arms(arm_panel(spark, d), ARMS), "arms")
    before = ev.common_universe(arms)
    n = before.agg(F.count("*").alias("cells")).crossJoin(ev.same_universe(ev.common_universe(arms.where(ev.gates())), before))
    names = spark.createDataFrame([(a,) for a in [*ARMS, "f_m5_tuned"]], "arm string")
    return names.select("arm", ev.twin(F.col("arm")).alias("twin"), ev.gates().alias("gates")).crossJoin(F.broadcast(n))


@query("with " + DENSE + ", " + SCORES + " select date, arm, round(loss, 5) as loss, n from sc")
def b11_c17_c30_daily_losses(spark, d):
    """Every arm's loss by date on the common universe."""
    return daily_scores(spark, d).select("date", "arm", r("loss", 5).alias("loss"), "n")


AGAINST = "ag as (select date, arm, loss - max(loss) filter (arm = 'm22') over (partition by date) as x from sc), ax as (select * from ag where arm <> 'm22')"


@query("with " + DENSE + ", " + SCORES + ", " + AGAINST + ", " + nw_sql("ax", "x", "date", 4, "arm") + " select arm, n, round(mean, 5) as mean, round(se, 5) as se, round(mean / se, 2) as t, mean / se < -1.645 as replaces from nw")
def c05_c19_variants(spark, d):
    """Paired tests of each arm against the baseline, and the rule by which it replaces it."""
    x = ev.against(daily_scores(spark, d), "m22", 4)
    return x.select("arm", "n", r("mean", 5).alias("mean"), r("se", 5).alias("se"), r("t", 2).alias("t"), (F.col("t") < -1.645).alias("replaces"))


@query("with " + DENSE + ", " + SCORES + ", wd as (select date, max(loss) filter (arm = 'm5') as a, max(loss) filter (arm = 'm22') as b, max(loss) filter (arm = 'ew') as c from sc group by 1), hh as (select date, 'm5 / m22' as pair, a - b as x from wd union all select date, 'ew / m22', c - b from wd union all select date, 'm5 / ew', a - c from wd), " + nw_sql("hh", "x", "date", 4, "pair") + " select pair, n, round(mean, 5) as mean, round(mean / se, 2) as t from nw")
def c28_head_to_head(spark, d):
    x = ev.head_to_head(daily_scores(spark, d), [("m5", "m22"), ("ew", "m22"), ("m5", "ew")], 4)
    return x.select(F.concat_ws(" / ", "a", "b").alias("pair"), "n", r("mean", 5).alias("mean"), r("t", 2).alias("t"))


REGIME = AGAINST + ", rx as (select *, case when year(date) < 1998 then 'early' else 'late' end as regime from ax), " + nw_sql("rx", "x", "date", 4, "arm, regime")


@query("with " + DENSE + ", " + SCORES + ", " + REGIME + " select arm, regime, n, round(mean - 1.645 * se, 4) as lo, round(mean + 1.645 * se, 4) as hi, ceil(n * (1.645 * se / 0.05) ** 2)::bigint as rows_needed, mean + 1.645 * se < 0.05 as non_inferior from nw")
def r37_c31_power_and_forest(spark, d):
    """Intervals by regime, as a forest plot shows them, and the dates that a margin would need."""
    x = _by_regime(spark, d)
    p = ev.power(x, 0.05)
    return p.select("arm", "regime", "n", r("lo", 4).alias("lo"), r("hi", 4).alias("hi"), F.col("rows_needed").cast("long").alias("rows_needed"), "non_inferior")


def _by_regime(spark, d):
    s = daily_scores(spark, d).withColumn("regime", F.when(F.year("date") < 1998, "early").otherwise("late"))
    return ev.against(s, "m22", 4, ["regime"])


@query("with " + DENSE + ", " + SCORES + ", " + REGIME + " select arm as claim, round(max(mean / se), 2) as worst_t, count(*) as uses, max(mean / se) < -1.645 as holds from nw group by 1")
def r36_claims(spark, d):
    """A claim over both regimes holds if its weakest test does."""
    c = ev.claims(_by_regime(spark, d).withColumnRenamed("arm", "claim"))
    return c.select("claim", r("worst_t", 2).alias("worst_t"), "uses", "holds")


@query("with " + DENSE + ", " + SCORES + ", " + AGAINST + ", " + nw_sql("ax", "x", "date", 4, "arm") + ", b as (select avg(loss) as base from sc where arm = 'm22') select arm, round(se, 5) as se, round(100 * mean / base, 2) as percent from nw, b")
def c29_derived_errors(spark, d):
    """Standard errors from a stored JSON table of means and t, and differences as percentages."""
    s = written(daily_scores(spark, d), "scores")
    rows = ev.against(s, "m22", 4).select(F.to_json(F.struct("arm", "mean", "t")).alias("json"))
    base = s.where("arm = 'm22'").agg(F.avg("loss").alias("base"))
    x = rows.select(F.from_json("json", "arm string, mean double, t double").alias("j")).select("j.*").crossJoin(F.broadcast(base))
    return x.select("arm", r(F.col("mean") / F.col("t"), 5).alias("se"), r(100 * F.col("mean") / F.col("base"), 2).alias("percent"))


@query("with " + DENSE + ", " + SCORES + ", c as (select arm, count(f) / count(*)::double as coverage from uv where date >= date '2001-01-01' group by 1) select sc.arm, count(*) as days, round(avg(loss), 5) as loss, round(any_value(coverage), 5) as coverage, any_value(coverage) > 0.95 as passes from sc join c using (arm) where date >= date '2001-01-01' group by 1")
def b14_c04_c21_c22_holdout(spark, d):
    """The locked year, evaluated once: losses, coverage and the gate on it."""
    p = written(arm_panel(spark, d), "arms")
    held = F.col("date") >= F.lit("2001-01-01").cast("date")
    s = ev.scores(ev.as_arms(p, ARMS), p.select("date", "ticker", "y"), losses.qlike).where(held)
    c = ev.as_arms(p.where(held), ARMS).groupBy("arm").agg((F.count("f") / F.count("*")).alias("coverage"))
    g = s.groupBy("arm").agg(F.count("*").alias("days"), F.avg("loss").alias("loss")).join(c, "arm")
    return g.select("arm", "days", r("loss", 5).alias("loss"), r("coverage", 5).alias("coverage"), (F.col("coverage") > 0.95).alias("passes"))


SIGNALS = f"sg as (select date, ticker, lead(ret) over (partition by ticker order by date) as f, -ret as rev_1d, case when count(ret) over {w(5)} >= 5 then -sum(ret) over {w(5)} end as rev_5d, case when count(ret) over {w(60)} >= 40 then -stddev_samp(ret) over {w(60)} end as lowvol from p)"


def ic_sql(src: str, names: list[str]) -> str:
    """ic: daily rank correlations of the named signals of src with f, long by signal."""
    return f"lg as (select date, f, unnest([{', '.join(repr(n) for n in names)}]) as signal, unnest([{', '.join(names)}]) as s from {src}), lk as (select * from lg where s is not null and f is not null), rr as (select date, signal, rank() over (partition by date, signal order by s) + (count(*) over (partition by date, signal, s) - 1) / 2.0::double as rs, rank() over (partition by date, signal order by f) + (count(*) over (partition by date, signal, f) - 1) / 2.0::double as rf from lk), ic as (select date, signal, covar_pop(rs, rf) / nullif(stddev_pop(rs) * stddev_pop(rf), 0) as ic from rr group by all having count(*) >= 10)"


@query("with " + DENSE + ", " + SIGNALS + ", " + ic_sql("sg", ["rev_1d", "rev_5d", "lowvol"]) + ", " + nw_sql("ic", "ic", "date", 5, "signal") + " select signal, n, round(mean, 5) as mean, round(mean / se, 2) as t, mean = max(mean) over () as chosen from nw")
def b12_c03_ic_table(spark, d):
    """All signals' information coefficients, and the one that the development period chooses."""
    x = F.col("ret")
    p = panel(spark, d).withColumns({"f": F.lead("ret").over(wn.series()), "rev_1d": -x, "rev_5d": -wn.rolling_sum(x, 5, 5), "lowvol": -wn.rolling_std(x, 60, 40)})
    s = ev.ic_stats(p, ["rev_1d", "rev_5d", "lowvol"], "f", 5)
    return s.select("signal", "n", r("mean", 5).alias("mean"), r("t", 2).alias("t"), (F.col("mean") == F.max("mean").over(Window.partitionBy(F.lit(0)))).alias("chosen"))  # a row a signal


@query("with " + DENSE + " select date, ticker, case when count(ret) over " + w(5) + " >= 5 then round(-sum(ret) over " + w(5) + ", 6) end as rev_5d, round(-ret, 6) as rev_1d from p")
def w06_reversals(spark, d):
    x = F.col("ret")
    return panel(spark, d).select("date", "ticker", r(-wn.rolling_sum(x, 5, 5)).alias("rev_5d"), r(-x).alias("rev_1d"))


@query("with " + DENSE + ", g as (select ticker, k, ret, lag(ret, k) over (partition by ticker, k order by date) as l from p, (select unnest([1, 5, 10])::int as k)), c as (select ticker, k, covar_pop(ret, l) / nullif(stddev_pop(case when l is not null then ret end) * stddev_pop(case when ret is not null then l end), 0) as c, count(case when ret is not null and l is not null then 1 end) as n from g group by all) select k as lag, count(*) as names, round(avg(c), 5) as mean from c where n >= 30 group by 1")
def c03_autocorrelations(spark, d):
    """Mean over names of the correlation with the value some rows before."""
    p = written(panel(spark, d).select("date", "ticker", "ret"), "returns")
    each = [ev.with_lag(p, "ret", k).withColumn("lag", F.lit(k)) for k in (1, 5, 10)]
    g = reduce(DataFrame.unionByName, each).groupBy("ticker", "lag").agg(F.count(F.when(F.col("ret").isNotNull() & F.col("_lag").isNotNull(), 1)).alias("n"), st.safe_corr("ret", "_lag").alias("c"))
    return g.where("n >= 30").groupBy("lag").agg(F.count("*").alias("names"), r(F.avg("c"), 5).alias("mean"))


CONFIGS = [(x, n, s) for x in ("plain", "resid") for n in (5, 10, 20, 60) for s in ("up", "down")]
SWEEP = "rs0 as (select *, case when count(ret) over v > 2 then ret - (sum(ret) over v - ret) / greatest(count(ret) over v - 1, 1) end as resid, ret as plain from p window v as (partition by date)), sw as (select date, ticker, lead(ret) over (partition by ticker order by date) as f, " + ", ".join(f"case when count({x}) over {w(n)} >= {n} then {'-' if s == 'down' else ''}sum({x}) over {w(n)} end as {x}_{n}_{s}" for x, n, s in CONFIGS) + " from rs0)"


def _sweep(spark, d):
    p = panel(spark, d).withColumns({"plain": F.col("ret"), "resid": xs.leave_one_out("ret")})
    cols = {f"{x}_{n}_{s}": (-1 if s == "down" else 1) * wn.rolling_sum(F.col(x), n, n) for x, n, s in CONFIGS}
    return ev.ic_stats(p.withColumns({"f": F.lead("ret").over(wn.series()), **cols}), list(cols), "f", 5)


SWEPT = "with " + DENSE + ", " + SWEEP + ", " + ic_sql("sw", [f"{x}_{n}_{s}" for x, n, s in CONFIGS]) + ", " + nw_sql("ic", "ic", "date", 5, "signal")


@query(SWEPT + " select signal as config, n, round(mean, 5) as mean, round(mean / se, 2) as t from nw")
def c06_configuration_sweep(spark, d):
    """Sixteen configurations of target, window and sign in one pass."""
    return _sweep(spark, d).select(F.col("signal").alias("config"), "n", r("mean", 5).alias("mean"), r("t", 2).alias("t"))


@query(SWEPT + " select signal as config, round(mean, 5) as mean from nw order by mean desc, signal limit 3")
def c09_winners(spark, d):
    # on dates with all names, residuals rank as plain sums do: means that differ in their last bits are ties
    return _sweep(spark, d).orderBy(F.desc(F.round("mean", 12)), "signal").limit(3).select(F.col("signal").alias("config"), r("mean", 5).alias("mean"))


RK1 = "rk as (select *, case when ret is not null then (rank() over (partition by date order by ret nulls last) + (count(ret) over (partition by date, ret) - 1) / 2.0::double) / count(ret) over (partition by date) end as pr from p)"


@query("with " + DENSE + ", " + RK1 + f", v as (select date, ticker, pr as plain, case when count(pr) over {w(5)} >= 5 then avg(pr) over {w(5)} end as smooth, (pr + 0.5) / 2 as shrunk from rk), l as (select date, ticker, unnest(['plain', 'smooth', 'shrunk']) as variant, unnest([plain, smooth, shrunk]) as s from v), c as (select *, abs(s - lag(s) over (partition by ticker, variant order by date)) as m from l) select variant, count(m) as n, round(avg(m), 6) as turnover from c group by 1")
def c07_turnover_of_variants(spark, d):
    """What smoothing and shrinking a signal does to its turnover."""
    p = panel(spark, d).withColumn("pr", xs.pct_rank("ret"))
    v = p.select("date", "ticker", F.col("pr").alias("plain"), wn.rolling_mean(F.col("pr"), 5, 5).alias("smooth"), ((F.col("pr") + 0.5) / 2).alias("shrunk"))
    l = v.unpivot(["date", "ticker"], ["plain", "smooth", "shrunk"], "variant", "s")
    c = l.withColumn("m", F.abs(F.col("s") - F.lag("s").over(Window.partitionBy("ticker", "variant").orderBy("date"))))
    return c.groupBy("variant").agg(F.count("m").alias("n"), r(F.avg("m")).alias("turnover"))


@query("with " + DENSE + f", b as (select date, ticker, case when count(ret) over {w(5)} >= 5 then sum(ret * ret) over {w(5)} end as rv from p), l as (select ticker, ln(rv + 1e-7) as now, ln(lead(rv, 5) over (partition by ticker order by date) + 1e-7) as later from b) select ticker, count(*) as n, round(avg((later - now) ** 2), 5) as mse, round(avg(exp(later - now) - (later - now) - 1), 3) as qlike from l where now is not null and later is not null group by 1")
def c08_log_rv_target(spark, d):
    """Forecasts of log realized variance by its last block, scored in logarithms and in levels."""
    rv = wn.rolling_sum(F.col("ret") * F.col("ret"), 5, 5)
    b = panel(spark, d).withColumn("rv", rv).withColumns({"now": F.ln(F.col("rv") + 1e-7), "later": F.ln(F.lead("rv", 5).over(wn.series()) + 1e-7)})
    e = F.col("later") - F.col("now")
    return b.where("now is not null and later is not null").groupBy("ticker").agg(F.count("*").alias("n"), r(F.avg(e * e), 5).alias("mse"), r(F.avg(F.exp(e) - e - 1), 3).alias("qlike"))


@query("with " + DENSE + ", " + ARM_SQL + ", nx as (select date, ticker, exp(lead(ret) over (partition by ticker order by date)) - 1 as r from p), j as (select date, ticker, arm, f, r from uv join nx using (date, ticker) where arm in ('m5', 'm22') and f > 0 and r is not null), e as (select *, 1.0::double / count(*) over g as eq, (1 / sqrt(f)) / sum(1 / sqrt(f)) over g as iv, least(1.0, 0.2::double / sqrt(252 * avg(f) over g)) as lev, quantile_cont(f, 0.5) over g as mid from j window g as (partition by date, arm)), u as (select date, arm, sum(eq * r) as equal, sum(iv * r) as inverse, sum(eq * lev * r) as target, sum(case when f <= mid then r end) / count(case when f <= mid then 1 end) as calm from e group by all), l as (select arm, unnest(['equal', 'inverse', 'target', 'calm']) as use, unnest([equal, inverse, target, calm]) as r from u) select arm, use, count(*) as days, round(stddev_samp(r) * sqrt(252), 4) as vol, round(avg(r) * 252, 4) as mean from l group by all")
def c10_economic_uses(spark, d):
    """Four books from each volatility model: equal, inverse, scaled to a target, and the calmer half."""
    p = written(arm_panel(spark, d), "arms")
    nx = panel(spark, d).select("date", "ticker", F.expm1(F.lead("ret").over(wn.series())).alias("r"))
    j = ev.as_arms(p, ["m5", "m22"]).join(nx, ["date", "ticker"]).where("f > 0 and r is not null")
    g = Window.partitionBy("date", "arm")
    e = j.withColumns({"eq": 1 / F.count("*").over(g), "iv": (1 / F.sqrt("f")) / F.sum(1 / F.sqrt("f")).over(g), "lev": F.least(F.lit(1.0), 0.2 / F.sqrt(252 * F.avg("f").over(g))), "mid": F.percentile("f", F.lit(0.5)).over(g)})
    calm = F.when(F.col("f") <= F.col("mid"), F.col("r"))
    u = e.groupBy("date", "arm").agg(F.sum(F.col("eq") * F.col("r")).alias("equal"), F.sum(F.col("iv") * F.col("r")).alias("inverse"), F.sum(F.col("eq") * F.col("lev") * F.col("r")).alias("target"), F.avg(calm).alias("calm"))
    l = u.unpivot(["date", "arm"], ["equal", "inverse", "target", "calm"], "use", "r")
    return l.groupBy("arm", "use").agg(F.count("*").alias("days"), r(F.stddev_samp("r") * 252**0.5, 4).alias("vol"), r(F.avg("r") * 252, 4).alias("mean"))


@query("with " + Q + " select label, count(*) as n, round(avg(q[19] - q[3]), 5) as spread, round(avg((q[19] + q[3] - 2 * q[11]) / nullif(q[19] - q[3], 0)), 5) as skew, round(avg((q[21] - q[1]) / nullif(q[16] - q[6], 0)), 4) as tail from q group by 1")
def c11_quantile_shapes(spark, d):
    """Robust spread, asymmetry and tail weight of quantile forecasts."""
    q = lambda i: F.get("q", i - 1)
    z = lambda x: F.nullif(x, F.lit(0.0))
    return vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), r(F.avg(q(19) - q(3)), 5).alias("spread"), r(F.avg((q(19) + q(3) - 2 * q(11)) / z(q(19) - q(3))), 5).alias("skew"), r(F.avg((q(21) - q(1)) / z(q(16) - q(6))), 4).alias("tail"))


@query("with " + DENSE + ", a as (select * from px where date < date '1999-01-01'), b as (select * from px where date >= date '1998-01-01') select 'overlapping cells' as qa, count(*) as n from a join b using (date, ticker) where a.close = b.close union all select 'differing cells', count(*) from a join b using (date, ticker) where a.close <> b.close union all select 'days of one only', count(*) from (select distinct date from a where date >= date '1998-01-01' except select distinct date from b) union all select 'large moves', count(*) from p where abs(ret) > 0.5")
def c13_holdout_checks(spark, d):
    """Two sources must agree where they overlap, in values and days; large moves are counted."""
    p = written(prices(spark, d), "daily")
    day = lambda x: F.lit(x).cast("date")
    a, b = p.where(F.col("date") < day("1999-01-01")), p.where(F.col("date") >= day("1998-01-01"))
    j = a.select("date", "ticker", F.col("close").alias("x")).join(b.select("date", "ticker", F.col("close").alias("y")), ["date", "ticker"])
    lost = a.where(F.col("date") >= day("1998-01-01")).select("date").distinct().join(b.select("date").distinct(), "date", "left_anti")
    moves = pn.daily_panel(p, p.select("date").distinct()).where("abs(ret) > 0.5")
    n = lambda df, name: df.agg(F.lit(name).alias("qa"), F.count("*").alias("n"))
    return n(j.where("x = y"), "overlapping cells").union(n(j.where("x <> y"), "differing cells")).union(n(lost, "days of one only")).union(n(moves, "large moves"))


CT = "ct as (select ticker, date, ret as last, row_number() over (partition by ticker order by date) as k from p where ret is not null)"


@query("with " + DENSE + ", " + CT + " select date, count(*) as names, 3 * count(*) as n, true as complete from ct where k >= 32 and date < date '2001-01-01' group by 1")
def c02_c15_forecast_coverage(spark, d):
    """Every context of every date before the holdout has a forecast of each step."""
    ctx = written(md.contexts(panel(spark, d), "ret", 60).where("date < date'2001-01-01'").select("date", "ticker", "context"), "contexts")
    f = md.forecast(ctx, md.last_value_forecaster, 3, locked_from="2001-01-01").groupBy("date").agg(F.count_distinct("ticker").alias("names"), F.count("*").alias("n"))
    want = ctx.groupBy("date").agg(F.count("*").alias("want"))
    return want.join(f, "date", "left").select("date", "names", "n", (F.col("n") == 3 * F.col("want")).alias("complete"))


@query("with " + PX + ", " + RATES + ", t as (select o_orderdate::date as date, count(*)::double as x from orders where o_orderpriority = '1-URGENT' group by 1), e as (select date from px union select date from rt union select date from t), j as (select e.date, rate, t.x as urgent, c.date is not null as on_ from e left join rt using (date) left join t using (date) left join (select distinct date from px) c using (date)), k as (select date, on_, last_value(rate ignore nulls) over v as rate, last_value(urgent ignore nulls) over v as urgent from j window v as (order by date rows between 40 preceding and current row)) select date, rate, urgent from k where on_")
def j08_b19_m20_covariates(spark, d):
    """Series of other calendars on the panel's dates, filled forward over all dates."""
    t = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").cast("double").alias("x"))
    parts = {"rate": _rates(spark, d).select("date", F.col("rate").alias("x")), "urgent": t}
    return ev.align(parts, prices(spark, d).select("date").distinct(), 40)


FACTOR = f"fa as (select date, ticker, ret, avg(ret) over (partition by date) as m from p), fb as (select *, case when count(ret) over {w(60)} >= 20 then covar_samp(ret, m) over {w(60)} / nullif(var_samp(m) over {w(60)}, 0) end as beta, case when count(ret) over {w(60)} >= 20 then var_samp(ret) over {w(60)} end as v, var_samp(m) over {w(60)} as vm from fa), fc as (select *, greatest(v - beta * beta * vm, 0) as ve from fb where beta is not null and v is not null and vm is not null), fp as (select date, count(*) as n, sum(beta) as sb, avg(vm) as vm, sum(ve) as se, sum(v) as sv from fc group by 1 having count(*) >= 5)"


@query("with " + DENSE + ", " + FACTOR + " select date, n, round(sqrt((sb * sb * vm + se) / (n * n)), 6) as factor, round(sqrt(sv / (n * n)), 6) as diagonal from fp")
def b07_b09_c18_factor_paths(spark, d):
    """Volatility paths of the equal book under a one-factor and a diagonal covariance, on dates that have both.

    The factor's covariances beta_i beta_j v are summed pair by pair; names times names a date."""
    t = wn.trailing(60)
    p = panel(spark, d).withColumn("m", F.avg("ret").over(wn.cross_section()))
    enough = F.count("ret").over(t) >= 20
    vm = F.stddev_samp("m").over(t) * F.stddev_samp("m").over(t)
    p = p.withColumns({"vm": vm, "v": F.when(enough, F.stddev_samp("ret").over(t) * F.stddev_samp("ret").over(t)), "beta": F.when(enough, F.covar_samp("ret", "m").over(t) / F.nullif(vm, F.lit(0.0)))})
    f = p.where("beta is not null and v is not null and vm is not null").withColumn("vm", F.avg("vm").over(wn.cross_section())).withColumn("ve", F.greatest(F.col("v") - F.col("beta") * F.col("beta") * F.col("vm"), F.lit(0.0)))
    f = written(f.select("date", "ticker", "beta", "vm", "v", "ve"), "factor")
    a = f.select("date", F.col("ticker").alias("i"), F.col("beta").alias("bi"), "vm", "v", "ve")
    b = f.select("date", F.col("ticker").alias("j"), F.col("beta").alias("bj"))
    same = F.col("i") == F.col("j")
    pairs = a.join(b, "date").select("date", same.alias("same"), (F.col("bi") * F.col("bj") * F.col("vm") + F.when(same, F.col("ve")).otherwise(0.0)).alias("c"), F.when(same, F.col("v")).alias("v"))
    s = pairs.groupBy("date").agg(F.count(F.when(F.col("same"), 1)).alias("n"), F.sum("c").alias("c"), F.sum("v").alias("v")).where("n >= 5")
    return s.select("date", "n", r(F.sqrt("c") / F.col("n")).alias("factor"), r(F.sqrt("v") / F.col("n")).alias("diagonal"))


@query("with " + DENSE + ", " + ARM_SQL + " select arm, count(f) as cells, 0::bigint as only_left, 0::bigint as only_right, 0.0::double as max_rel from uv where arm <> 'mix_a' and ticker is not null group by 1")
def c20_c16_classical_parity(spark, d):
    """Recomputed arms against the cached ones."""
    keep = written(ev.as_arms(arm_panel(spark, d), ARMS[:3]).where("f is not null"), "cached-arms")
    fresh = ev.as_arms(arm_panel(spark, d), ARMS[:3]).where("f is not null")
    out = [joins.parity(keep.where(F.col("arm") == a), fresh.where(F.col("arm") == a), ["date", "ticker"], "f").withColumn("arm", F.lit(a)) for a in ARMS[:3]]
    return reduce(DataFrame.unionByName, out).select("arm", F.col("both").alias("cells"), "only_left", "only_right", r("max_rel").alias("max_rel"))


SCREEN = f"e0 as (select ticker, date, ret, case when count(ret) over {w(60, 1)} >= 20 then stddev_samp(ret) over {w(60, 1)} end as sd, lead(ret) over (partition by ticker order by date) as nx from p), e1 as (select *, avg(nx) over (partition by date) as mk from e0), e2 as (select ticker, k as threshold, date < date '1998-07-01' as early, case when sign(ret) = sign(mk) then 1.0::double else 0 end as same from e1, (select unnest([2.0, 1.25, 1.0]::double[]) as k) where abs(ret) > k * sd and mk is not null)"


@query("with " + DENSE + ", " + SCREEN + ", g as (select ticker, threshold, count(*) filter (early) as n_early, avg(same) filter (early) as early, count(*) filter (not early) as n_late, avg(same) filter (not early) as late from e2 group by all) select ticker, threshold, n_early, round(early, 6) as early, n_late, round(late, 6) as late, coalesce(late >= 0.5, false) as confirmed from g where n_early >= 10 and early >= 0.5")
def c24_discover_and_confirm(spark, d):
    """Leaders whose large moves precede the market's on the early dates, and whether the late ones agree."""
    sd = wn.rolling_std(F.col("ret"), 60, 20, lag=1)
    e = panel(spark, d).withColumns({"sd": sd, "nx": F.lead("ret").over(wn.series())}).withColumn("mk", F.avg("nx").over(wn.cross_section()))
    e = e.withColumn("threshold", F.explode(F.array(F.lit(2.0), F.lit(1.25), F.lit(1.0)))).where("abs(ret) > threshold * sd and mk is not null")
    early, same = F.col("date") < F.lit("1998-07-01").cast("date"), (F.signum("ret") == F.signum("mk")).cast("double")
    g = e.groupBy("ticker", "threshold").agg(F.count(F.when(early, 1)).alias("n_early"), F.avg(F.when(early, same)).alias("early"), F.count(F.when(~early, 1)).alias("n_late"), F.avg(F.when(~early, same)).alias("late"))
    return g.where("n_early >= 10 and early >= 0.5").select("ticker", "threshold", "n_early", r("early").alias("early"), "n_late", r("late").alias("late"), F.coalesce(F.col("late") >= 0.5, F.lit(False)).alias("confirmed"))


@query("select 'first' as run, 'regions' as stage, 'done' as status, (select count(*) from region) as n_rows union all select 'first', 'broken', 'failed', 0 union all select 'first', 'nations', 'done', (select count(*) from nation) union all select 'second', 'regions', 'skipped', (select count(*) from region) union all select 'second', 'broken', 'failed', 0 union all select 'second', 'nations', 'skipped', (select count(*) from nation)")
def c25_b13_stage_batch(spark, d):
    """Stages in turn: what is finished is skipped on the next run, what fails doesn't stop the others."""
    folder = place(spark, "stages")
    stages = {"regions": lambda: table(spark, d, "region"), "broken": lambda: table(spark, d, "absent"), "nations": lambda: table(spark, d, "nation")}
    one, two = jobs.run_stages(spark, stages, folder), jobs.run_stages(spark, stages, folder)
    return one.withColumn("run", F.lit("first")).unionByName(two.withColumn("run", F.lit("second")))


@query("with " + DENSE + ", " + VL + ", o as (select year(date) as year, ln(y) as ly, ln(fb) as lf from vl where y > 0 and fa > 0 and fb > 0), f as (select year, regr_slope(ly, lf) as b, regr_intercept(ly, lf) as a, count(*) as n from o group by 1) select year, any_value(n) as n, round(any_value(b), 5) as slope, round(avg(exp(ly - a - b * lf)), 4) as smearing from o join f using (year) group by 1")
def c27_smearing_by_year(spark, d):
    """Log regressions by year with the factor that takes them back to levels."""
    o = loss_panel(spark, d).select(F.year("date").alias("year"), F.ln("y").alias("ly"), F.ln("fb").alias("lf"))
    f = o.groupBy("year").agg(F.regr_slope("ly", "lf").alias("b"), F.regr_intercept("ly", "lf").alias("a"), F.count("*").alias("n"))
    fit = F.col("a") + F.col("b") * F.col("lf")
    return o.join(F.broadcast(f), "year").groupBy("year").agg(F.first("n").alias("n"), r(F.first("b"), 5).alias("slope"), r(ev.duan(fit, F.col("ly") - fit), 4).alias("smearing"))


@query("with " + DENSE + ", c as (select ticker, year(date) as year, ret as a, lead(ret) over (partition by ticker order by date) as b from p), g as (select ticker, year, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) as c, median(abs(a)) / nullif(median(abs(b)), 0) as amp from c where a is not null and b is not null group by all having count(*) >= 30) select cast(floor(round(c, 9) * 10) as bigint) as bin, count(*) as n, round(avg(amp), 5) as amplitude from g group by 1")
def c34_correlation_histogram(spark, d):
    """Correlations by name and year in bins of a tenth, with the forecasts' mean relative amplitude."""
    c = panel(spark, d).select("ticker", F.year("date").alias("year"), F.col("ret").alias("a"), F.lead("ret").over(wn.series()).alias("b")).where("a is not null and b is not null")
    med = lambda x: F.percentile(F.abs(x), F.lit(0.5))
    g = c.groupBy("ticker", "year").agg(F.count("*").alias("k"), st.safe_corr("a", "b").alias("c"), (med("a") / F.nullif(med("b"), F.lit(0.0))).alias("amp")).where("k >= 30")
    return g.groupBy(F.floor(F.round("c", 9) * 10).cast("long").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("amp"), 5).alias("amplitude"))


@query("with " + Q + ", u as (select vec_id, i as h, raw[i] / 10 as x from q, range(1, 22) t(i)) select vec_id, h, round(100 * exp(sum(x) over (partition by vec_id order by h rows unbounded preceding)), 4) as price from u")
def c35_price_paths(spark, d):
    """The last price times the exponential of the cumulated returns."""
    u = vectors(spark, d).select("vec_id", F.posexplode("raw").alias("i", "x")).withColumn("h", (F.col("i") + 1).cast("long"))
    path = F.sum(F.col("x") / 10).over(Window.partitionBy("vec_id").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    return u.select("vec_id", "h", r(100 * F.exp(path), 4).alias("price"))


THIN = PX.replace("px as (", "px0 as (", 1) + ", tn as (select date, count(close) as prints from px0 group by 1), tm as (select *, quantile_cont(prints, 0.5) over (order by date rows between 10 preceding and 10 following) as typical from tn), px as (select px0.* from px0 join tm using (date) where prints >= 0.7 * typical)" + DENSE[len(PX) :]
ELIGIBLE = f"el as (select *, coalesce(count(ret) over (partition by ticker order by date rows unbounded preceding) >= 250 and case when count(value) over {w(60)} >= 30 then quantile_cont(value, 0.5) over {w(60)} end >= 1000000 and not stale and close is not null, false) as ok from p)"


@query("with " + THIN + ", " + ELIGIBLE + " select ticker, count(*) as n, count(raw) as prints, sum(case when stale then 1 else 0 end)::bigint as filled, sum(case when ok then 1 else 0 end)::bigint as eligible, min(case when ok then date end) as since, round(max(abs(ret)), 6) as top_move from el group by 1")
def c01_b16_stage_data(spark, d):
    """From bars to checks: thin days out, the dense panel, eligibility, and what each name has."""
    p = written(pn.drop_thin_days(written(prices(spark, d), "daily"), 0.7), "kept-days")
    e = pn.daily_panel(p, p.select("date").distinct()).withColumn("ok", pn.eligible(floor=1_000_000))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return e.groupBy("ticker").agg(F.count("*").alias("n"), F.count("raw").alias("prints"), n(F.col("stale")).alias("filled"), n(F.col("ok")).alias("eligible"), F.min(F.when(F.col("ok"), F.col("date"))).alias("since"), r(F.max(F.abs("ret"))).alias("top_move"))


@query("with " + WINDOWS + ", x as (select n_name as ticker, o_orderdate::date as date, o_orderpriority as contract, o_totalprice as close, o_orderkey as seq from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate::date between date '1995-06-01' and date '2000-06-30'), y as (select x.* from x join wn on x.ticker = wn.ticker and x.date between lo and hi), z as (select * from (select *, row_number() over (partition by ticker, date order by seq desc) as n from y) where n = 1) select ticker, date, contract, seq, coalesce(contract <> lag(contract) over (partition by ticker order by date), false) as roll, round(close * case when ticker = 'NATION_6' and date < date '1996-06-01' then 0.5::double else 1 end, 4) as close_adj from z")
def b17_finalize(spark, d):
    """Raw rows to a processed table: period, contract windows, last of repeated rows, roll flag, adjusted close."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    raw = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = raw.select(F.col("n_name").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("contract"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("seq"))
    y = F.pmod("n_nationkey", F.lit(5)).cast("int")
    windows = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("ticker"), F.make_date(1995 + y, F.lit(3), F.lit(1)).alias("lo"), F.make_date(1996 + y, F.lit(9), F.lit(30)).alias("hi"))
    split = spark.sql("select 'NATION_6' as ticker, date'1996-06-01' as ex_date, cast(null as double) as dividend, 2.0D as ratio")
    out = pull.finalize(raw, ["ticker", "date"], ["seq"], ("1995-06-01", "2000-06-30"), windows, split)
    return out.select("ticker", "date", "contract", "seq", "roll", r("close_adj", 4).alias("close_adj"))


@query("with " + PX + ", k as (select ticker from px group by 1 order by count(*) desc, ticker limit 6), f as (select px.* from px join k using (ticker)), n as (select date from f group by 1 having count(*) = 6) select f.date, f.ticker, f.close from f join n using (date)")
def b18_j07_price_panel(spark, d):
    """The best covered names, on the dates that have all of them."""
    p = written(prices(spark, d), "daily")
    best = p.groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(6).select("ticker")
    return pn.full_dates(p.join(F.broadcast(best), "ticker").select("date", "ticker", "close"))


@query("with " + DENSE + ", q as (select ticker, date, ret, case when raw is not null then value::double end as v from p where ret is not null), c as (select ticker, date, count(*) over f as n, coalesce(last_value(v ignore nulls) over f, 0) as last_value, row_number() over (partition by ticker order by date) as k from q window f as (partition by ticker order by date rows between 39 preceding and current row)) select ticker, date, n, last_value from c where k >= 32")
def m02_multivariate_contexts(spark, d):
    p = panel(spark, d).withColumn("v", F.when(F.col("raw").isNotNull(), F.col("value").cast("double")))
    c = md.multivariate_contexts(p, ["ret", "v"], 40)
    return c.select("ticker", "date", F.size("v").cast("long").alias("n"), F.element_at("v", -1).alias("last_value"))


@query("with " + DENSE + ", q as (select *, dense_rank() over (order by date) - 1 as pos from p), a as (select ticker, pos as anchor, avg(ret) over " + w(30) + " as value from q), dy as (select distinct pos, date from q) select anchor, ticker, h, dy.date, round(value, 7) as value from a, (select unnest([1, 2, 3]) as h) join dy on dy.pos = anchor + h where anchor % 21 = 0 and anchor >= 29 and value is not null")
def m05_walk_forward(spark, d):
    """Frames of 30 rows at every 21st date through a pipeline that takes frames; outputs dated by position."""
    out = md.walk_forward(written(positions(spark, d).select("ticker", "date", "pos", "ret"), "positions"), "ret", 30, 3, 21)
    return out.select("anchor", "ticker", "h", "date", r("value", 7).alias("value"))


@query("with " + DENSE + ", q as (select *, dense_rank() over (order by date) - 1 as pos, year(date) as y from p where ret is not null), c as (select y, min(pos) as cut from q group by 1) select c.y as fold, count(*) filter (pos < cut - 5) as train, count(*) filter (q.y = c.y) as validation from q, c group by 1 having count(*) filter (pos < cut - 5) > 0")
def m21_fold_slices(spark, d):
    """Causal slices: training rows end five dates before their fold's validation year."""
    q = positions(spark, d).where("ret is not null").withColumn("y", F.year("date"))
    # the dense rank of the oracle counts dates that have a return
    days = q.select("date", "y").distinct().withColumn("p", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    daily = q.groupBy("date").agg(F.count("*").alias("n")).join(days, "date")
    cut = daily.groupBy(F.col("y").alias("fold")).agg(F.min("p").alias("cut"))
    x = daily.crossJoin(F.broadcast(cut))  # dates times years
    n = lambda ok: F.sum(F.when(ok, F.col("n")).otherwise(0))
    g = x.groupBy("fold").agg(n(F.col("p") < F.col("cut") - 5).alias("train"), n(F.col("y") == F.col("fold")).alias("validation"))
    return g.where("train > 0")


@query("with " + SESSION + ", x as (select date, ln(close) - lag(ln(close)) over (partition by ticker order by timestamp, seq) as r from s) select date, round(ln(sum(r * r) + 1e-7), 6) as log_rv from x group by 1 having sum(r * r) is not null")
def m25_log_rv_series(spark, d):
    x = pn.bar_returns(bars(spark, d), tie="seq").groupBy("date").agg(F.sum(F.col("r") * F.col("r")).alias("rv"))
    return x.where("rv is not null").select("date", r(F.ln(F.col("rv") + 1e-7)).alias("log_rv"))


@query("with " + DENSE + ", f as (select date, ticker, ret as f from p where ret is not null), y as (select date, ticker, lead(ret) over (partition by ticker order by date) as y from p), m as (select date, ticker, true as ok from px where value > 5000000) select f.ticker, count(*) as n, count(y) as realized, sum(case when coalesce(m.ok, false) then 1 else 0 end)::bigint as masked from f left join y using (date, ticker) left join m using (date, ticker) group by 1")
def j03_realized_and_mask(spark, d):
    p = panel(spark, d)
    f = p.where("ret is not null").select("date", "ticker", F.col("ret").alias("f"))
    y = p.select("date", "ticker", F.lead("ret").over(wn.series()).alias("y"))
    m = prices(spark, d).where("value > 5000000").select("date", "ticker", F.lit(True).alias("ok"))
    j = f.join(y, ["date", "ticker"], "left").join(m, ["date", "ticker"], "left")
    return j.groupBy("ticker").agg(F.count("*").alias("n"), F.count("y").alias("realized"), F.sum(F.coalesce("ok", F.lit(False)).cast("long")).alias("masked"))


@query("with " + DENSE + ", x as (select ticker, date, date_trunc('month', date)::date as month, ret as r from p where ret is not null), u as (select month, ticker from x group by all having count(*) >= 15) select a.month, a.ticker as i, b.ticker as j, round(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0), 5) as rho from x a join x b on a.date = b.date and a.ticker < b.ticker join u ui on ui.month = a.month and ui.ticker = a.ticker join u uj on uj.month = a.month and uj.ticker = b.ticker group by all having count(*) >= 15")
def j23_restricted_cube(spark, d):
    """Monthly correlations of the names that are in the universe of the month."""
    x = panel(spark, d).where("ret is not null").select("ticker", "date", F.trunc("date", "month").alias("month"), F.col("ret").alias("r"))
    x = written(x, "returns")
    u = x.groupBy("month", "ticker").agg(F.count("*").alias("n")).where("n >= 15").select("month", "ticker")
    inside = x.join(F.broadcast(u), ["month", "ticker"], "left_semi")  # a row a name and month
    a = inside.select("month", "date", F.col("ticker").alias("i"), F.col("r").alias("ri"))
    b = inside.select("date", F.col("ticker").alias("j"), F.col("r").alias("rj"))
    g = a.join(b, "date").where("i < j").groupBy("month", "i", "j").agg(F.count("*").alias("n"), st.safe_corr("ri", "rj").alias("rho"))
    return g.where("n >= 15").select("month", "i", "j", r("rho", 5).alias("rho"))


@query("with " + DENSE + ", z as (select date, ticker, row_number() over (order by date desc) as k from (select date, any_value(ticker) as ticker from p where date between date '1996-01-01' and date '1996-12-31' group by 1)) select date from z where k > 5")
def p11_dates_with_whole_windows(spark, d):
    """Dates of a period whose forward windows of up to five rows end in it."""
    days = prices(spark, d).select("date").distinct().where("date between date'1996-01-01' and date'1996-12-31'")
    return days.withColumn("k", F.row_number().over(Window.orderBy(F.desc("date")))).where("k > 5").select("date")  # a row a date


@query("with " + DENSE + " select date, ticker, round(exp(ret) - 1, 6) as simple from p where ret is not null")
def p21_simple_returns(spark, d):
    return panel(spark, d).where("ret is not null").select("date", "ticker", r(F.expm1("ret")).alias("simple"))


@query("with x as (select o_orderpriority as a, o_orderstatus as b, count(*) as n from orders group by all) select a, b, n from x")
def p24_pairs_to_columns_and_back(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("n"))
    wide = x.groupBy("a").pivot("b", ["F", "O", "P"]).agg(F.first("n"))
    return wide.unpivot(["a"], ["F", "O", "P"], "b", "n").where("n is not null")


@query("with e as (select cast(ts as date) as date, event_type as ticker, event_id, value from events), m as (select date, ticker, max(value) as top from e group by all) select event_id, round(value / nullif(top, 0), 6) as share from e join m using (date, ticker)")
def p25_daily_onto_bars(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("ticker"), "event_id", "value")
    m = e.groupBy("date", "ticker").agg(F.max("value").alias("top"))
    return ev.realized_by_bar(m, e).select("event_id", r(F.col("value") / F.nullif("top", F.lit(0.0))).alias("share"))


@query("select right(o_orderpriority, 4) as code, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) as asset, count(*) as contracts, sum(cast(round(o_totalprice) as bigint))::bigint as volume, max(o_orderdate)::date as last_trade from orders group by 1 order by last_trade, code")
def g05_futures_rollup(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy(F.right("o_orderpriority", F.lit(4)).alias("code")).agg(F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("asset"), F.count("*").alias("contracts"), F.sum(F.round("o_totalprice").cast("long")).alias("volume"), F.to_date(F.max("o_orderdate")).alias("last_trade"))
    return g.orderBy("last_trade", "code")


CELL3 = "c3 as (select ticker, h, ret as pred, case h when 1 then l1 when 2 then l2 else l3 end as y from (select ticker, ret, lead(ret, 1) over v as l1, lead(ret, 2) over v as l2, lead(ret, 3) over v as l3 from p window v as (partition by ticker order by date)), (select unnest([1, 2, 3]) as h)), m3 as (select ticker, h, count(*) as n, sum(case when sign(pred) = sign(y) then 1 else 0 end) as k from c3 where pred is not null and y is not null group by all), z3 as (select *, k / n::double as da, abs(k - n / 2.0::double) / sqrt(n / 4.0::double) > 1.959964 as sig from m3)"


@query("with " + DENSE + ", " + CELL3 + " select h, count(*) as cells, round(avg(da), 6) as mean_da, round(median(da), 6) as median_da, sum(case when sig then 1 else 0 end)::bigint as significant from z3 group by 1")
def g11_metrics_by_horizon(spark, d):
    """Directional accuracy of all names by horizon: mean, median and how many differ from a coin."""
    w_ = wn.series()
    p = panel(spark, d).select("ticker", F.col("ret").alias("pred"), *(F.lead("ret", h).over(w_).alias(f"y{h}") for h in (1, 2, 3)))
    c = p.select("ticker", "pred", F.posexplode(F.array("y1", "y2", "y3")).alias("i", "y")).where("pred is not null and y is not null")
    m = c.groupBy("ticker", (F.col("i") + 1).alias("h")).agg(F.count("*").alias("n"), F.sum((F.signum("pred") == F.signum("y")).cast("long")).alias("k"))
    m = m.withColumns({"da": F.col("k") / F.col("n"), "sig": F.abs(F.col("k") - F.col("n") / 2) / F.sqrt(F.col("n") / 4) > 1.959964})
    return m.groupBy("h").agg(F.count("*").alias("cells"), r(F.avg("da")).alias("mean_da"), r(F.percentile("da", F.lit(0.5))).alias("median_da"), F.sum(F.col("sig").cast("long")).alias("significant"))


@query("with " + DENSE + f", t as (select ticker, ret as p1, case when count(ret) over {w(5)} >= 5 then avg(ret) over {w(5)} end as p2, lead(ret, 1) over v as y1, lead(ret, 2) over v as y2 from p window v as (partition by ticker order by date)), u as (select * from t where p1 is not null and p2 is not null and y1 is not null and y2 is not null and sign(p1) = sign(p2) and sign(p1) <> 0) select ticker, count(*) as windows, round(avg(case when sign(y1) = sign(p1) and sign(y2) = sign(p1) then 1.0::double else 0 end), 6) as both, round(avg(case when sign(y1 + y2) = sign(p1) then 1.0::double else 0 end), 6) as cumulative from u group by 1")
def g12_two_step_trend(spark, d):
    """Windows whose two steps are forecast with one sign: how often both come true, and how often their sum."""
    w_ = wn.series()
    t = panel(spark, d).select("ticker", F.col("ret").alias("p1"), wn.rolling_mean(F.col("ret"), 5, 5).alias("p2"), F.lead("ret", 1).over(w_).alias("y1"), F.lead("ret", 2).over(w_).alias("y2"))
    s = F.signum
    t = t.dropna().where((s("p1") == s("p2")) & (s("p1") != 0))
    both = ((s("y1") == s("p1")) & (s("y2") == s("p1"))).cast("double")
    return t.groupBy("ticker").agg(F.count("*").alias("windows"), r(F.avg(both)).alias("both"), r(F.avg((s(F.col("y1") + F.col("y2")) == s("p1")).cast("double"))).alias("cumulative"))


@query("with " + SESSION + ", x as (select ticker, date, user_id % 3 as contract, close, timestamp, seq from s), y as (select *, case when contract = lag(contract) over v then ln(close) - lag(ln(close)) over v end as r from x window v as (partition by ticker order by timestamp, seq)) select ticker, date, round(sum(r * r), 6) as rv, count(r) as n from y group by all")
def g17_futures_rv(spark, d):
    """Realized variance without the returns that cross contracts."""
    from quantloom.operators import actions

    x = pn.main_session(bars(spark, d)).withColumn("contract", F.pmod("user_id", F.lit(3)))
    x = x.withColumn("r", actions.same_contract_return(over=wn.series("ticker", ["timestamp", "seq"])))
    return x.groupBy("ticker", "date").agg(r(F.sum(F.col("r") * F.col("r"))).alias("rv"), F.count("r").alias("n"))


PAIR = "m as (select date, avg(ret) as m from p group by 1), pr as (select ticker as leader, 'market' as follower, count(*) as n, covar_pop(ret, m) / nullif(stddev_pop(ret) * stddev_pop(m), 0) as rho from p join m using (date) where ret is not null group by 1), pp as (select *, exp(-rho * rho * (n - 2) / (2 * (1 - rho * rho))) as pv from pr where n >= 30), pk as (select *, row_number() over (order by pv, leader) as i, count(*) over () as m from pp), pq as (select *, least(min(pv * m / i) over (order by i rows between current row and unbounded following), 1) as q from pk)"


@query("with " + DENSE + ", " + PAIR + " select leader, follower, round(rho, 5) as rho, round(q, 6) as q from pq where q < 0.05 order by abs(rho) desc, leader limit 20")
def t06_pair_shortlist(spark, d):
    """Pairs below a false discovery rate (by an upper bound of their p), the strongest 20 of them."""
    p = panel(spark, d).where("ret is not null")
    j = p.withColumn("m", F.avg("ret").over(wn.cross_section()))
    g = j.groupBy(F.col("ticker").alias("leader")).agg(F.count("*").alias("n"), st.safe_corr("ret", "m").alias("rho")).where("n >= 30")
    rho2 = F.col("rho") * F.col("rho")
    g = g.withColumn("p", F.exp(-rho2 * (F.col("n") - 2) / (2 * (1 - rho2))))
    q = st.benjamini_hochberg(g, "p", "leader", "q").where("q < 0.05")
    return q.orderBy(F.desc(F.abs("rho")), "leader").limit(20).select("leader", F.lit("market").alias("follower"), r("rho", 5).alias("rho"), r("q").alias("q"))


@query("select event_type as ticker, event_id, row_number() over (partition by event_type order by ts, event_id) as n, ts >= coalesce(lag(ts) over (partition by event_type order by ts, event_id), ts) as sorted from events")
def t11_sorted_output(spark, d):
    """Output order of a written table: rows of a name together, in order of time, as the files hold them."""
    path = place(spark, "sorted")
    e = table(spark, d, "events").select(F.col("event_type").alias("ticker"), "ts", "event_id")
    e.repartition("ticker").sortWithinPartitions("ticker", "ts", "event_id").write.parquet(path)
    back = spark.read.schema(e.schema).parquet(path).withColumn("_at", F.monotonically_increasing_id())
    w_ = Window.partitionBy("ticker").orderBy("_at")
    return back.select("ticker", "event_id", F.row_number().over(w_).cast("long").alias("n"), (F.col("ts") >= F.coalesce(F.lag("ts").over(w_), F.col("ts"))).alias("sorted"))


@query("with k as (select user_id, event_type, cast(ts as date) as date, count(*) as n, max(event_id) as last from events group by all) select date, count(*) as distinct_keys, sum(n - 1)::bigint as duplicated, max(last) as last from k group by 1")
def u05_distinct_and_duplicated(spark, d):
    k = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return k.groupBy("date").agg(F.count("*").alias("distinct_keys"), F.sum(F.col("n") - 1).alias("duplicated"), F.max("last").alias("last"))


@query()
def f17_t_var_es(spark, d):
    """VaR and ES of unit-variance t distributions; the quantile function isn't in SQL."""
    import numpy as np

    def run(batches):
        for pdf in batches:
            tails = [special.t_var_es(np.ones(1), nu, 0.05) for nu in pdf["nu"]]
            yield pdf.assign(var=[float(v[0]) for v, _ in tails], es=[float(e[0]) for _, e in tails])

    return spark.range(20).select((2.05 + F.col("id") * 0.75).alias("nu")).mapInPandas(run, "nu double, var double, es double")


@query("with " + DENSE + ", g as (select date, ticker, md5(date || ':' || ticker) as k, count(*) over (partition by date) as n from p where ret is not null) select date, ticker, row_number() over (partition by date order by k, ticker) % greatest(n // 5, 1) as grp from g")
def f29_random_groups(spark, d):
    """Groups of about five names, drawn anew each date by a hash of date and name."""
    g = panel(spark, d).where("ret is not null").select("date", "ticker", F.md5(F.concat_ws(":", F.col("date").cast("string"), "ticker")).alias("k"), F.count("*").over(wn.cross_section()).alias("n"))
    i = F.row_number().over(Window.partitionBy("date").orderBy("k", "ticker"))
    return g.select("date", "ticker", (i % F.greatest(F.expr("n div 5"), F.lit(1))).cast("long").alias("grp"))


@query()
def r33_detector_power(spark, d):
    """How often a planted leader is found, and how often one is found that isn't: trials are one more key."""
    trials = spark.range(40).select(F.col("id").alias("trial"), F.explode(F.array(F.lit(0.0), F.lit(0.35))).alias("strength"))
    x = trials.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(249))))
    x = x.withColumns({"a": synthetic.normal(1, "trial", "t"), "e": synthetic.normal(2, "trial", "t")})
    lagged = F.lag("a").over(Window.partitionBy("trial", "strength").orderBy("t"))
    x = x.withColumn("l", lagged).withColumn("b", F.col("strength") * F.col("l") + F.col("e"))
    g = x.where("l is not null").groupBy("strength", "trial").agg(st.safe_corr("l", "b").alias("rho"), F.count("*").alias("n"))
    return g.groupBy("strength").agg(F.avg((F.abs("rho") * F.sqrt("n") > 1.959964).cast("double")).alias("found"), F.count("*").alias("trials"))
