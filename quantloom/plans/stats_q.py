"""Tests, regressions and directional studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import losses, special
from quantloom.operators import stats as st
from quantloom.operators import windows as wn
from quantloom.plans.base import DENSE, panel, query, r, table, w

IC = """sg as (select date, ticker, -ret as s, lead(ret) over (partition by ticker order by date) as f from p), ok as (select * from sg where s is not null and f is not null),
ri as (select date, (rank() over (partition by date order by s) + (count(*) over (partition by date, s) - 1) / 2.0::double) as rs, (rank() over (partition by date order by f) + (count(*) over (partition by date, f) - 1) / 2.0::double) as rf from ok),
ic as (select date, covar_pop(rs, rf) / nullif(stddev_pop(rs) * stddev_pop(rf), 0) as ic from ri group by 1 having count(*) >= 10)"""


def signal_panel(spark, d):
    p = panel(spark, d)
    return p.select("date", "ticker", (-F.col("ret")).alias("s"), F.lead("ret").over(wn.series()).alias("f"))


@query("with " + DENSE + ", " + IC + " select date, round(ic, 6) as ic from ic")
def r01_ic_series(spark, d):
    return st.ic_series(signal_panel(spark, d), "s", "f").select("date", r("ic").alias("ic"))


def nw_sql(src: str, x: str, order: str, lags: int, by: str = "") -> str:
    part, keys = (f"partition by {by} ", f"{by}, ") if by else ("", "")
    lagged = ", ".join(f"e * lag(e, {k}) over ({part}order by {order}) as l{k}" for k in range(1, lags + 1))
    total = " + ".join(f"coalesce(2 * (1 - {k} / {lags + 1}.0::double) * sum(l{k}) / any_value(n), 0)" for k in range(1, lags + 1))
    return f"nw0 as (select {keys}{order}, {x} as x, count(*) over ({part}) as n, avg({x}) over ({part}) as m from {src} where {x} is not null), nw1 as (select *, x - m as e from nw0), nw2 as (select *, {lagged} from nw1), nw as (select {keys}any_value(n) as n, any_value(m) as mean, sqrt(greatest(sum(e * e) / any_value(n) + {total}, 0) / any_value(n)) as se from nw2 {'group by ' + by if by else ''})"


@query("with " + DENSE + ", " + IC + ", " + nw_sql("ic", "ic", "date", 5) + " select n, round(mean, 6) as mean, round(se, 6) as se, round(mean / se, 4) as t from nw")
def r02_w33_newey_west(spark, d):
    x = st.newey_west(st.ic_series(signal_panel(spark, d), "s", "f"), "ic", "date", 5)
    return x.select("n", r("mean").alias("mean"), r("se").alias("se"), r("t", 4).alias("t"))


VL = f"vl as (select date, ticker, lead(ret) over (partition by ticker order by date) ** 2 as y, avg(ret * ret) over {w(5)} as fa, avg(ret * ret) over {w(22)} as fb from p), ls as (select date, avg(y / fa - ln(y / fa) - 1) as la, avg(y / fb - ln(y / fb) - 1) as lb from vl where y > 0 and fa > 0 and fb > 0 group by 1)"


def loss_panel(spark, d):
    p = panel(spark, d)
    sq = F.col("ret") * F.col("ret")
    p = p.select("date", "ticker", F.pow(F.lead("ret").over(wn.series()), F.lit(2)).alias("y"), F.avg(sq).over(wn.trailing(5)).alias("fa"), F.avg(sq).over(wn.trailing(22)).alias("fb"))
    return p.where("y > 0 and fa > 0 and fb > 0")


def loss_series(spark, d):
    p = loss_panel(spark, d)
    return p.groupBy("date").agg(F.avg(losses.qlike(F.col("y"), F.col("fa"))).alias("la"), F.avg(losses.qlike(F.col("y"), F.col("fb"))).alias("lb"))


@query("with " + DENSE + ", " + VL + " select date, round(la, 5) as la, round(lb, 5) as lb from ls")
def r09_g19_vol_loss_panel(spark, d):
    return loss_series(spark, d).select("date", r("la", 5).alias("la"), r("lb", 5).alias("lb"))


@query("with " + DENSE + ", " + VL + ", df as (select date, la - lb as x from ls), " + nw_sql("df", "x", "date", 4) + " select n, round(mean, 5) as mean, round(se, 5) as se, round(mean / se, 3) as t from nw")
def r06_h10_diebold_mariano(spark, d):
    x = st.newey_west(loss_series(spark, d).select("date", (F.col("la") - F.col("lb")).alias("x")), "x", "date", 4)
    return x.select("n", r("mean", 5).alias("mean"), r("se", 5).alias("se"), r("t", 3).alias("t"))


@query()
def r06_r34_one_sided_p(spark, d):
    """One-sided p of the loss difference and of non-inferiority with a margin; the distribution isn't in SQL."""
    x = st.newey_west(loss_series(spark, d).select("date", (F.col("la") - F.col("lb")).alias("x")), "x", "date", 4)
    return x.select("n", special.norm_cdf("t").alias("p_a_better"), special.norm_cdf((F.col("mean") - 0.1) / F.col("se")).alias("p_not_worse"))


@query("with " + DENSE + ", " + VL + " select count(*) as n, round(regr_slope(ln(y), ln(fb)), 5) as slope, round(regr_intercept(ln(y), ln(fb)), 5) as intercept, round(regr_r2(ln(y), ln(fb)), 5) as r2, round(avg(y / fb), 3) as scale from vl where y > 0 and fa > 0 and fb > 0")
def r07_r08_mincer_zarnowitz(spark, d):
    p = loss_panel(spark, d).withColumns({"ly": F.ln("y"), "lf": F.ln("fb")})
    return p.agg(F.count("*").alias("n"), r(F.regr_slope("ly", "lf"), 5).alias("slope"), r(F.regr_intercept("ly", "lf"), 5).alias("intercept"), r(F.regr_r2("ly", "lf"), 5).alias("r2"), r(F.avg(F.col("y") / F.col("fb")), 3).alias("scale"))


HITS = f"ht as (select date, ticker, case when count(ret) over {w(120, 1)} >= 60 and ret is not null then case when ret < quantile_cont(ret, 0.05) over {w(120, 1)} then 1 else 0 end end as hit from p), hl as (select *, lag(hit) over (partition by ticker order by date) as a from ht where hit is not null), hc as (select ticker, count(*) as n, sum(hit) as x, count(*) filter (a = 0 and hit = 0) as n00, count(*) filter (a = 0 and hit = 1) as n01, count(*) filter (a = 1 and hit = 0) as n10, count(*) filter (a = 1 and hit = 1) as n11 from hl group by 1), hp as (select *, n01 / greatest(n00 + n01, 1)::double as p01, n11 / greatest(n10 + n11, 1)::double as p11, (n01 + n11) / greatest(n00 + n01 + n10 + n11, 1)::double as pp, x / n::double as rate from hc)"
XL = lambda a, b: f"case when {a} = 0 then 0 else ({a}) * ln(nullif({b}, 0)) end"


def hits(spark, d):
    q = wn.rolling_quantile(F.col("ret"), 0.05, 120, 60, lag=1)
    p = panel(spark, d).withColumn("q", q)
    return p.select("date", "ticker", F.when(F.col("q").isNotNull() & F.col("ret").isNotNull(), (F.col("ret") < F.col("q")).cast("int")).alias("hit"))


@query("with " + DENSE + ", " + HITS + f" select ticker, n, cast(x as bigint) as hits, round(rate, 6) as rate, round(-2 * ({XL('n - x', '0.95::double')} + {XL('x', '0.05::double')} - ({XL('n - x', '1 - rate')} + {XL('x', 'rate')})), 5) as lr_uc, round(-2 * ({XL('n00 + n10', '1 - pp')} + {XL('n01 + n11', 'pp')} - ({XL('n00', '1 - p01')} + {XL('n01', 'p01')} + {XL('n10', '1 - p11')} + {XL('n11', 'p11')})), 5) as lr_ind from hp")
def r10_r11_r12_coverage(spark, d):
    c = st.coverage(hits(spark, d), 0.05, ["ticker"])
    return c.select("ticker", "n", "hits", r("rate").alias("rate"), r("lr_uc", 5).alias("lr_uc"), r("lr_ind", 5).alias("lr_ind"))


@query()
def r11_r12_coverage_p(spark, d):
    c = st.coverage(hits(spark, d), 0.05, ["ticker"])
    return c.select("ticker", special.chi2_sf_1("lr_uc").alias("p_uc"), special.chi2_sf_1("lr_ind").alias("p_ind"), special.chi2_sf_2(F.col("lr_cc")).alias("p_cc"))


@query("with x as (select o_orderpriority as k, (o_totalprice - 250000) / 100000.0::double as y from orders) select k, round(sum(case when y < -1.5 then y else 0 end / (0.05 * 2.0::double)) / count(*) + 1, 5) as z2 from x group by 1")
def r13_acerbi_szekely(spark, d):
    y = (F.col("o_totalprice") - 250000) / 100000.0
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(r(st.acerbi_szekely(y, F.lit(-1.5), F.lit(-2.0), 0.05), 5).alias("z2"))


GWZ = "gz as (select date, la - lb as z0, (la - lb) * case when month(date) <= 6 then 1 else 0 end as z1 from ls where la is not null and lb is not null), gl as (select *, " + ", ".join(f"{a} * lag({b}, {k}) over (order by date) as g{k}_{i}" for k in (1, 2, 3) for i, (a, b) in enumerate((("z0", "z0"), ("z0", "z1"), ("z1", "z0"), ("z1", "z1")))) + " from gz), gs as (select count(*) as n, avg(z0) as m0, avg(z1) as m1, avg(z0 * z0) + 2 * (" + " + ".join(f"(1 - {k} / 4.0::double) * sum(g{k}_0) / count(*)" for k in (1, 2, 3)) + ") as s00, avg(z0 * z1) + " + " + ".join(f"(1 - {k} / 4.0::double) * (sum(g{k}_1) + sum(g{k}_2)) / count(*)" for k in (1, 2, 3)) + " as s01, avg(z1 * z1) + 2 * (" + " + ".join(f"(1 - {k} / 4.0::double) * sum(g{k}_3) / count(*)" for k in (1, 2, 3)) + ") as s11 from gl), gw as (select n, n * (m0 * m0 * s11 - 2 * m0 * m1 * s01 + m1 * m1 * s00) / (s00 * s11 - s01 * s01) as stat from gs)"


@query("with " + DENSE + ", " + VL + ", " + GWZ + " select n, round(stat, 3) as stat, round(exp(-stat / 2), 5) as p from gw")
def r15_giacomini_white(spark, d):
    x = loss_series(spark, d).withColumn("h", F.when(F.month("date") <= 6, 1.0).otherwise(0.0))
    return st.giacomini_white(x, "la", "lb", "h", 3).select("n", r("stat", 3).alias("stat"), r("p", 5).alias("p"))


@query("with " + DENSE + ", " + IC + ", sl as (select date, regr_slope(f, s) as b from ok group by 1 having count(*) >= 15), " + nw_sql("sl", "b", "date", 5) + " select n, round(mean, 5) as mean, round(mean / se, 3) as t from nw where n is not null")
def r04_r05_fama_macbeth(spark, d):
    p = signal_panel(spark, d).where("s is not null and f is not null")
    return st.fama_macbeth(p, "f", ["s"], 5).where("signal = 's'").select("n", r("mean", 5).alias("mean"), r("t", 3).alias("t"))


@query()
def r16_r17_driscoll_kraay(spark, d):
    p = loss_panel(spark, d).select("date", "ticker", F.ln("y").alias("y"), F.ln("fa").alias("xa"), F.ln("fb").alias("xb"))
    return spark.createDataFrame(st.driscoll_kraay(p, "y", ["xa", "xb"], 5))


@query()
def r18_r20_block_bootstrap(spark, d):
    x = loss_series(spark, d)
    return st.block_bootstrap(x, ["la", "lb"], "date", lambda a: (a[:, 0] - a[:, 1]).mean(), 2000)


@query("with " + DENSE + ", a as (select date, avg(exp(ret) - 1) as ra from p where ret is not null and ticker <= 'NATION_19' group by 1), b as (select date, avg(exp(ret) - 1) as rb from p where ret is not null and ticker > 'NATION_19' group by 1), j as (select ra / 10 as ra, rb / 10 as rb from a join b using (date)), s as (select count(*) as n, avg(1 + ra) as ma, avg((1 + ra) * (1 + ra)) as ma2, avg((1 + rb) - (5 / 12.0::double) * (1 + rb) * (1 + rb)) as ub from j), q as (select *, 2 * (5 / 12.0::double) * ma - 1 as li, ma - (5 / 12.0::double) * ma2 - ub as co from s) select n, round(2 * co / (-li + sign(-li) * sqrt(li * li + 4 * (5 / 12.0::double) * co)), 5) as delta from q")
def r19_performance_fee(spark, d):
    p = panel(spark, d).where("ret is not null").withColumn("R", F.expm1("ret"))
    a = p.where("ticker <= 'NATION_19'").groupBy("date").agg((F.avg("R") / 10).alias("ra"))
    b = p.where("ticker > 'NATION_19'").groupBy("date").agg((F.avg("R") / 10).alias("rb"))
    return st.performance_fee(a.join(b, "date"), "ra", "rb", 5.0, 252).select("n", r("delta", 5).alias("delta"))


@query("with " + DENSE + ", m as (select date, avg(exp(ret) - 1) / 20 as r from p where ret is not null group by 1), e as (select *, exp(sum(ln(1 + r)) over (order by date)) as eq, quantile_cont(r, 0.05) over () as q from m), x as (select *, eq / max(eq) over (order by date) - 1 as dd from e) select count(*) as n, round(avg(r) * 252, 5) as ann_ret, round(stddev_samp(r) * sqrt(252), 5) as ann_vol, round(avg(r) / stddev_samp(r) * sqrt(252), 4) as sharpe, round(min(dd), 5) as max_dd, round(avg(r) filter (r <= q), 5) as cvar5, round(avg(r) / stddev_samp(r) filter (r < 0) * sqrt(252), 4) as sortino from x")
def r22_w34_performance(spark, d):
    m = panel(spark, d).where("ret is not null").groupBy("date").agg((F.avg(F.expm1("ret")) / 20).alias("r")).withColumn("k", F.lit(1))
    s = st.performance(m, ["k"])
    return s.select("n", r("ann_ret", 5).alias("ann_ret"), r("ann_vol", 5).alias("ann_vol"), r("sharpe", 4).alias("sharpe"), r("max_dd", 5).alias("max_dd"), r("cvar5", 5).alias("cvar5"), r("sortino", 4).alias("sortino"))


@query()
def r24_permutation_null(spark, d):
    return st.permutation_ic(signal_panel(spark, d), "s", "f", 1000)


BH = "t as (select user_id, event_type, avg(value) / 500 as p from events group by all), k as (select *, row_number() over (partition by event_type order by p, user_id) as i, count(*) over (partition by event_type) as m from t)"


@query("with " + BH + " select user_id, event_type, round(least(min(p * m / i) over (partition by event_type order by i rows between current row and unbounded following), 1), 6) as q from k")
def r25_benjamini_hochberg(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 500).alias("p"))
    return st.benjamini_hochberg(t, "p", "user_id", "q", ["event_type"]).select("user_id", "event_type", r("q").alias("q"))


@query("with " + BH + ", h as (select *, p / 100 <= 0.2 / (m - i + 1) as ok from k) select user_id, event_type, bool_and(ok) over (partition by event_type order by i rows between unbounded preceding and current row) as rejected from h")
def r35_holm(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 500 / 100).alias("p"))
    return st.holm(t, "p", "user_id", 0.2, ["event_type"]).select("user_id", "event_type", "rejected")


CELLS = "ce as (select ticker, date, ret as pred, lead(ret) over (partition by ticker order by date) as y from p), hh as (select * from ce where pred is not null and y is not null)"


@query("with " + DENSE + ", " + CELLS + ", rk as (select *, (rank() over (partition by ticker order by pred) + (count(*) over (partition by ticker, pred) - 1) / 2.0::double) as rp, (rank() over (partition by ticker order by y) + (count(*) over (partition by ticker, y) - 1) / 2.0::double) as ry from hh), g as (select ticker, count(*) as n, sum(case when sign(pred) = sign(y) then 1 else 0 end) as k, covar_pop(pred, y) / nullif(stddev_pop(pred) * stddev_pop(y), 0) as pe, covar_pop(rp, ry) / nullif(stddev_pop(rp) * stddev_pop(ry), 0) as sp, median(abs(pred)) / nullif(median(abs(y)), 0) as amp, avg(abs(pred - y)) as mae from rk group by 1) select ticker, n, round(k / n::double, 6) as da, round(pe, 5) as pearson, round(sp, 5) as spearman, round(amp, 5) as amp, round(mae, 6) as mae, round((k / n::double + 1.96 * 1.96::double / (2 * n)) / (1 + 1.96 * 1.96::double / n) - 1.96::double * sqrt(k / n::double * (1 - k / n::double) / n + 1.96 * 1.96::double / (4.0 * n * n)) / (1 + 1.96 * 1.96::double / n), 5) as ci_lo from g")
def g10_r27_f21_directional_cells(spark, d):
    from quantloom.operators.xsection import pct_rank

    h = _cells(spark, d)
    h = h.withColumns({"rp": pct_rank("pred", "ticker"), "ry": pct_rank("y", "ticker")})
    n, k = F.count("*"), F.sum((F.signum("pred") == F.signum("y")).cast("long"))
    med = lambda c: F.percentile(F.abs(c), F.lit(0.5))
    g = h.groupBy("ticker").agg(n.alias("n"), k.alias("k"), r(st.safe_corr("pred", "y"), 5).alias("pearson"), r(st.safe_corr("rp", "ry"), 5).alias("spearman"), r(med("pred") / F.nullif(med("y"), F.lit(0.0)), 5).alias("amp"), r(F.avg(F.abs(F.col("pred") - F.col("y")))).alias("mae"))
    return g.select("ticker", "n", r(F.col("k") / F.col("n")).alias("da"), "pearson", "spearman", "amp", "mae", r(special.wilson(F.col("k"), F.col("n"))[0], 5).alias("ci_lo"))


def _cells(spark, d):
    p = panel(spark, d).select("ticker", "date", F.col("ret").alias("pred"), F.lead("ret").over(wn.series()).alias("y"))
    return p.where("pred is not null and y is not null")


@query("with " + DENSE + ", " + CELLS + ", h2 as (select *, case when sign(pred) = sign(y) then 1 else 0 end as ha, case when sign(-pred) = sign(y) then 1 else 0 end as hb from hh) select ticker, count(*) as n, sum(case when ha = 0 and hb = 1 then 1 else 0 end)::bigint as n01, sum(case when ha = 1 and hb = 0 then 1 else 0 end)::bigint as n10 from h2 group by 1")
def r26_j15_mcnemar_counts(spark, d):
    h = _cells(spark, d)
    a, b = (F.signum("pred") == F.signum("y")).cast("int"), (F.signum(-F.col("pred")) == F.signum("y")).cast("int")
    return h.withColumns({"ha": a, "hb": b}).groupBy("ticker").agg(F.count("*").alias("n"), F.sum((F.expr("ha = 0 and hb = 1")).cast("long")).alias("n01"), F.sum((F.expr("ha = 1 and hb = 0")).cast("long")).alias("n10"))


@query()
def r26_r40_mcnemar_and_binomial_p(spark, d):
    c = r26_j15_mcnemar_counts(spark, d).withColumns({"p": special.mcnemar_exact("n01", "n10"), "p_binom": special.binom_greater("n10", F.col("n01") + F.col("n10"))})
    return st.benjamini_hochberg(c, "p", "ticker", "p_bh")


@query("with " + DENSE + f", e as (select ticker, date, ret, abs(ret) > 1.5 * case when count(ret) over {w(60, 1)} >= 20 then stddev_samp(ret) over {w(60, 1)} end as ev, dense_rank() over (order by date) as pos from p) select a.ticker as leader, b.ticker as follower, b.pos - a.pos as lag, count(*) as n_events, round(avg(case when sign(a.ret) = sign(b.ret) then 1.0::double else 0 end), 6) as same_dir, round(avg(b.ret * sign(a.ret)), 5) as response from e a join e b on b.pos - a.pos between 1 and 2 and a.ticker <> b.ticker where a.ev and b.ret is not null group by all having count(*) >= 5")
def r29_r30_r31_event_response(spark, d):
    """Every (leader, follower, lag) in one grouped join: rows are dates times names, pairs stay within a lag."""
    p = panel(spark, d)
    pos = p.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))
    sd = wn.rolling_std(F.col("ret"), 60, 20, lag=1)
    e = p.withColumn("ev", F.coalesce(F.abs("ret") > 1.5 * sd, F.lit(False))).join(F.broadcast(pos), "date").select("ticker", "pos", "ret", "ev")
    a = e.where("ev").select(F.col("ticker").alias("leader"), "pos", F.col("ret").alias("ra"), F.explode(F.array(F.lit(1), F.lit(2))).alias("lag"))
    b = e.where("ret is not null").select(F.col("ticker").alias("follower"), F.col("pos").alias("at"), F.col("ret").alias("rb"))
    j = a.join(b, (F.col("at") == F.col("pos") + F.col("lag")) & (F.col("leader") != F.col("follower")))
    out = j.groupBy("leader", "follower", F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n_events"), r(F.avg((F.signum("ra") == F.signum("rb")).cast("double"))).alias("same_dir"), r(F.avg(F.col("rb") * F.signum("ra")), 5).alias("response"))
    return out.where("n_events >= 5")


@query()
def r32_block_permute(spark, d):
    p = panel(spark, d)
    pos = p.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    return st.block_permute(p.join(F.broadcast(pos), "date").select("pos", "ticker", "ret"), 20)


@query("with " + DENSE + ", m as (select date, avg(ret) as m from p group by 1), j as (select ret as u, ret - 0.8::double * m as h from p join m using (date) where ret is not null) select round(1 - var_pop(h) / var_pop(u), 6) as effectiveness from j")
def r39_hedge_effectiveness(spark, d):
    p = panel(spark, d)
    j = p.join(p.groupBy("date").agg(F.avg("ret").alias("m")), "date").where("ret is not null").withColumn("h", F.col("ret") - 0.8 * F.col("m"))
    return j.agg(r(st.hedge_effectiveness("ret", "h")).alias("effectiveness"))
