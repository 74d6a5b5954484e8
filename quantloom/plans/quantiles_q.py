"""Quantile vectors: rearrangement, moments, tails, shapes and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import losses, quantiles as qt
from quantloom.plans.base import query, r, table

L = "[" + ", ".join(f"{x}::double" for x in qt.LEVELS) + "]"
Q = f"q as (select vec_id, label, list_transform(embedding[1:21], lambda x: x::double) as raw, list_sort(list_transform(embedding[1:21], lambda x: x::double)) as q, {L} as u from embeddings)"


def vectors(spark, d):
    """The first 21 components of each vector, in order, as a quantile vector."""
    raw = F.transform(F.slice("embedding", 1, 21), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", raw.alias("raw"), qt.rearranged(raw).alias("q"))


@query("with " + Q + " select label, count(*) as n, sum(case when raw <> q then 1 else 0 end) as crossed from q group by 1")
def f01_rearranged(spark, d):
    return vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(qt.crossed(F.col("raw")).cast("long")).alias("crossed"))


KNOTS = ", kn as (select vec_id, label, list_concat([q[1] - u[1] * (q[2] - q[1]) / (u[2] - u[1])], q, [q[21] + (1 - u[21]) * (q[21] - q[20]) / (u[21] - u[20])]) as a, list_concat([0.0::double], u, [1.0::double]) as v from q), mo as (select vec_id, label, list_sum(list_transform(range(1, 23), lambda i: (v[i + 1] - v[i]) * (a[i] + a[i + 1]) / 2)) as m1, list_sum(list_transform(range(1, 23), lambda i: (v[i + 1] - v[i]) * (a[i] * a[i] + a[i] * a[i + 1] + a[i + 1] * a[i + 1]) / 3)) as m2 from kn)"


@query("with " + Q + KNOTS + " select vec_id, round(m1, 6) as mean, round(greatest(m2 - m1 * m1, 0), 6) as var from mo")
def f02_f13_moments(spark, d):
    m, v = qt.moments(F.col("q"))
    return vectors(spark, d).select("vec_id", r(m).alias("mean"), r(v).alias("var"))


@query("with " + Q + ", j as (select *, least(greatest(len(list_filter(u, lambda x: x <= 0.33)), 1), 20) as k from q) select vec_id, round(q[k] + (0.33 - u[k]) / (u[k + 1] - u[k]) * (q[k + 1] - q[k]), 6) as q33, round(q[1], 6) as flat from j")
def f03_quantile_at(spark, d):
    q = F.col("q")
    return vectors(spark, d).select("vec_id", r(qt.at(q, 0.33)).alias("q33"), r(qt.at(q, 0.001, tail="flat")).alias("flat"))


@query("with " + Q + ", s as (select *, (q[2] - q[1]) / (u[2] - u[1]) as sl from q) select vec_id, round(q[2], 6) as var, round((q[1] * u[1] - sl * u[1] * u[1] / 2 + (0.05 - 0.01) * (q[1] + q[2]) / 2) / 0.05, 6) as es, round(q[1] + sl * (0.01 / 2 - 0.01), 6) as es1 from s")
def f04_f10_var_es(spark, d):
    q = F.col("q")
    v, e = qt.var_es(q, 0.05)
    return vectors(spark, d).select("vec_id", r(v).alias("var"), r(e).alias("es"), r(qt.var_es(q, 0.01)[1]).alias("es1"))


@query("with " + Q + ", g as (select *, list_transform(range(0, 199), lambda i: (i + 0.5::double) / 199) as g from q), x as (select vec_id, label, list_transform(g, lambda v: case when v < u[1] then q[1] when v > u[21] then q[21] else q[least(greatest(len(list_filter(u, lambda x: x <= v)), 1), 20)] + (v - u[least(greatest(len(list_filter(u, lambda x: x <= v)), 1), 20)]) / (u[least(greatest(len(list_filter(u, lambda x: x <= v)), 1), 20) + 1] - u[least(greatest(len(list_filter(u, lambda x: x <= v)), 1), 20)]) * (q[least(greatest(len(list_filter(u, lambda x: x <= v)), 1), 20) + 1] - q[least(greatest(len(list_filter(u, lambda x: x <= v)), 1), 20)]) end) as z from g) select label, round(sum(list_sum(list_transform(z, lambda x: exp(x))) / 199), 5) as e from x group by 1")
def f05_f11_mean_exp(spark, d):
    return vectors(spark, d).groupBy("label").agg(r(F.sum(qt.mean_exp(F.col("q"))), 5).alias("e"))


@query("with " + Q + KNOTS + ", f as (select label, vec_id % 6 + 1 as h, q[11] as med, mo.m1, greatest(m2 - m1 * m1, 0) as v, q[21] + q[1] - 2 * q[11] as sk from mo join q using (vec_id, label)) select label, round(sum(med), 5) as med, round(sum(m1), 5) as mu, round(sqrt(sum(v)), 5) as sig, count(*) as n from f where h between 2 and 6 group by 1")
def f06_forecast_features(spark, d):
    """Steps 2 to 6 of each label: summed medians and means, root of summed variances."""
    m, v = qt.moments(F.col("q"))
    f = vectors(spark, d).select("label", (F.col("vec_id") % 6 + 1).alias("h"), F.get("q", 10).alias("med"), m.alias("mu"), v.alias("v")).where("h between 2 and 6")
    return f.groupBy("label").agg(r(F.sum("med"), 5).alias("med"), r(F.sum("mu"), 5).alias("mu"), r(F.sqrt(F.sum("v")), 5).alias("sig"), F.count("*").alias("n"))


@query("with " + Q + KNOTS + ", f as (select label, vec_id, q[11] as med, greatest(m2 - m1 * m1, 0) as v from mo join q using (vec_id, label)) select vec_id, round(med - lag(med) over w, 6) as block_med, round(greatest(v - lag(v) over w, 1e-10::double), 6) as block_var, round(sqrt(v / 5), 6) as sig1 from f window w as (partition by label order by vec_id)")
def f07_f08_block_and_cumulative(spark, d):
    from pyspark.sql import Window

    _, v = qt.moments(F.col("q"))
    w = Window.partitionBy("label").orderBy("vec_id")
    f = vectors(spark, d).select("label", "vec_id", F.get("q", 10).alias("med"), v.alias("v"))
    return f.select("vec_id", r(F.col("med") - F.lag("med").over(w)).alias("block_med"), r(F.when(F.lag("v").over(w).isNotNull(), F.greatest(F.col("v") - F.lag("v").over(w), F.lit(1e-10))).otherwise(F.lit(1e-10))).alias("block_var"), r(F.sqrt(F.col("v") / 5)).alias("sig1"))


@query("with " + Q + ", z as (select *, len(list_filter(q, lambda x: x <= 0)) as j from q) select vec_id, round((q[19] + q[3] - 2 * q[11]) / nullif(q[19] - q[3], 0), 6) as skew, round(ln(greatest(q[19] - q[11], 1e-12::double) / greatest(q[11] - q[3], 1e-12::double)), 6) as updown, round((q[21] - q[1]) / nullif(q[19] - q[3], 0), 6) as tail, round((q[11] - q[2]) / nullif(q[19] - q[3], 0), 6) as down, round(1 - case when j = 0 then u[1] when j = 21 then u[21] else u[j] + (0 - q[j]) / (q[j + 1] - q[j]) * (u[j + 1] - u[j]) end, 6) as pup, round(((q[16] - q[6]) / 1.349::double) ** 2, 6) as v50 from z")
def f09_shape(spark, d):
    q = F.col("q")
    g = lambda i: F.get(q, i)
    width = F.nullif(g(18) - g(2), F.lit(0.0))
    tiny = F.lit(1e-12)
    return vectors(spark, d).select("vec_id", r((g(18) + g(2) - 2 * g(10)) / width).alias("skew"), r(F.ln(F.greatest(g(18) - g(10), tiny) / F.greatest(g(10) - g(2), tiny))).alias("updown"), r((g(20) - g(0)) / width).alias("tail"), r((g(10) - g(1)) / width).alias("down"), r(1 - qt.cdf_at_zero(q)).alias("pup"), r(F.pow((g(15) - g(5)) / 1.349, F.lit(2))).alias("v50"))


@query("with " + Q + " select label, round(avg(list_sum(list_transform(range(1, 22), lambda i: greatest(u[i] * (0.02 - q[i]), (u[i] - 1) * (0.02 - q[i])))) / 21), 6) as loss from q group by 1")
def g13_g14_pinball(spark, d):
    return vectors(spark, d).groupBy("label").agg(r(F.avg(qt.pinball(F.col("q"), F.lit(0.02)))).alias("loss"))


@query("select o_orderkey, round(o_totalprice / 150000.0::double - ln(o_totalprice / 150000.0::double) - 1, 6) as qlike, round(-(case when x <= v then 1 else 0 end) * (v - x) / (0.05 * e) + v / e + ln(-e) - 1, 6) as fz0 from (select *, (o_totalprice - 250000) / 100000.0::double as x, -1.5::double as v, -2.0::double as e from orders)")
def f14_f15_losses(spark, d):
    o = table(spark, d, "orders").withColumn("x", (F.col("o_totalprice") - 250000) / 100000.0)
    return o.select("o_orderkey", r(losses.qlike(F.col("o_totalprice"), F.lit(150000.0))).alias("qlike"), r(losses.fz0(F.col("x"), F.lit(-1.5), F.lit(-2.0), 0.05)).alias("fz0"))


@query("select s_suppkey, round(s * -1.6448536269514729, 6) as nv, round(-s * 0.10313564037537139 / 0.05, 6) as ne, round(exp(0.3 * ln(s) + 0.7 * ln(2 * s)), 6) as geo, round(0.3 * s + 0.7 * 2 * s, 6) as vin, round(least(0.1 / s, 2), 6) as lev, round(0.4 * s / 3, 6) as hedge from (select s_suppkey, 0.05::double + abs(s_acctbal) / 10000.0::double as s from supplier)")
def f16_f18_f19_combinations(spark, d):
    s = F.col("s")
    v, e = losses.normal_var_es(s, 0.05)
    t = table(spark, d, "supplier").withColumn("s", 0.05 + F.abs("s_acctbal") / 10000.0)
    return t.select("s_suppkey", r(v).alias("nv"), r(e).alias("ne"), r(losses.geo_mix([(0.3, s), (0.7, 2 * s)])).alias("geo"), r(losses.vincentize([(0.3, s), (0.7, 2 * s)])).alias("vin"), r(losses.vol_target_leverage(s, 0.1, 2.0)).alias("lev"), r(losses.hedge_ratio(F.lit(0.4), s, F.lit(3.0))).alias("hedge"))


@query("with e as (select vec_id, list_transform(embedding[1:4], lambda x: x::double) as t from embeddings), x as (select vec_id, list_transform(t, lambda v: exp(v - list_max(t))) as e from e) select vec_id, round(e[1] / list_sum(e), 6) as w1, round(e[4] / list_sum(e), 6) as w4 from x")
def f22_softmax(spark, d):
    t = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    s = table(spark, d, "embeddings").select("vec_id", losses.softmax(t).alias("s"))
    return s.select("vec_id", r(F.get("s", 0)).alias("w1"), r(F.get("s", 3)).alias("w4"))
