"""Hand cases, identities and causality of the panel operators."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import quantiles as qt
from quantloom.functions import special
from quantloom.operators import actions, joins, models, panel, portfolio, stats
from quantloom.operators import windows as wn
from quantloom.operators import xsection as xs


def day(k):
    return date(2024, 1, 1) + timedelta(days=k)


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(7)
    rows = [(day(i), f"T{j}", None if rng.random() < 0.1 else float(rng.normal(0, 0.01))) for i in range(120) for j in range(12)]
    return spark.createDataFrame(rows, "date date, ticker string, ret double")


def wide(df, col):
    return df.toPandas().pivot(index="date", columns="ticker", values=col).astype(float)


def test_session_close_ignores_evening(spark):
    t = [("07:00", 90.0), ("10:00", 100.0), ("18:40", 101.0), ("23:40", 120.0)]
    bars = spark.createDataFrame([("A", datetime.fromisoformat(f"2024-03-01T{h}:00"), c) for h, c in t], "ticker string, timestamp timestamp_ntz, close double")
    assert panel.session_close(bars, "close").first().close == 101.0


def test_realized_variance_spans_the_night(spark):
    t = [("2024-03-01T10:00", 100.0), ("2024-03-01T18:00", 102.0), ("2024-03-01T23:00", 500.0), ("2024-03-02T10:00", 101.0)]
    bars = spark.createDataFrame([("A", datetime.fromisoformat(h + ":00"), c) for h, c in t], "ticker string, timestamp timestamp_ntz, close double")
    days = spark.createDataFrame([(date(2024, 3, 1),), (date(2024, 3, 2),)], "date date")
    got = {r.date: r.rv for r in panel.realized_variance(bars, days).collect()}
    assert got[date(2024, 3, 1)] == pytest.approx(math.log(1.02) ** 2) and got[date(2024, 3, 2)] == pytest.approx(math.log(101 / 102) ** 2)


def test_rolling_matches_pandas(returns):
    x = F.col("ret")
    out = returns.select("date", "ticker", "ret", wn.rolling_std(x, 20, 10).alias("sd"), wn.rolling_skew(x, 30, 10).alias("sk"), wn.rolling_kurt(x, 30, 10).alias("ku"), wn.rolling_quantile(x, 0.1, 20, 10).alias("q"))
    r = wide(out, "ret")
    for col, want in (("sd", r.rolling(20, min_periods=10).std()), ("sk", r.rolling(30, min_periods=10).skew()), ("ku", r.rolling(30, min_periods=10).kurt()), ("q", r.rolling(20, min_periods=10).quantile(0.1))):
        np.testing.assert_allclose(wide(out, col), want, atol=1e-9)


def test_ewm_carries_over_nulls(returns):
    out = wn.ewm(returns.withColumn("x", F.col("ret") * F.col("ret")), "x", "v", 0.94, 20)
    x = wide(out, "x")
    want = x.ewm(alpha=0.06, adjust=False, ignore_na=True).mean()
    want[x.notna().cumsum() < 20] = np.nan
    np.testing.assert_allclose(wide(out, "v"), want, atol=1e-12)


def test_rank_and_standardize(spark):
    df = spark.createDataFrame([(day(0), "A", 1.0), (day(0), "B", 1.0), (day(0), "C", 3.0), (day(0), "D", None), (day(1), "A", 2.0), (day(1), "B", 2.0)], "date date, ticker string, x double")
    out = df.withColumn("pr", xs.pct_rank("x")).withColumn("z", xs.standardized("pr"))
    got = {(r.date, r.ticker): (r.pr, r.z) for r in out.collect()}
    assert [got[day(0), t][0] for t in "ABCD"] == [0.5, 0.5, 1.0, None] and got[day(1), "A"][1] == 0


def test_long_short_is_neutral(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(day(i), f"T{j}", float(rng.normal()), float(rng.uniform(0.5, 1.5))) for i in range(3) for j in range(20)], "date date, ticker string, x double, b double")
    w = df.withColumn("pr", xs.pct_rank("x")).withColumn("w", xs.long_short("pr", "b")).toPandas()
    for _, g in w.groupby("date"):
        assert abs(g.w.sum()) < 1e-12 and abs(g.w.abs().sum() - 1) < 1e-12 and abs((g.w * g.b).sum()) < 1e-12


@pytest.mark.parametrize("record, want", [(date(2022, 7, 14), date(2022, 7, 13)), (date(2021, 7, 11), date(2021, 7, 8)), (date(2023, 7, 31), date(2023, 7, 28)), (date(2023, 8, 1), date(2023, 8, 1)), (date(2024, 7, 7), date(2024, 7, 5)), (date(2030, 1, 1), None)])
def test_ex_dates(spark, record, want):
    cal = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2021-06-01", "2024-08-30")], "date date")
    rec = spark.createDataFrame([("A", record)], "ticker string, record_date date")
    assert actions.ex_dates(rec, cal).first().ex_date == want


def test_adjusted_close_stacks_events(spark):
    px = spark.createDataFrame([("A", day(i), c) for i, c in enumerate([200.0, 190.0, 181.0, 800.0, 100.0])], "ticker string, date date, close double")
    ev = spark.createDataFrame([("A", day(1), 10.0, None), ("A", day(2), 9.0, None), ("A", day(3), 900.0, None), ("A", day(4), None, 8.0), ("A", None, 5.0, None)], "ticker string, ex_date date, dividend double, ratio double")
    got = [r.close_adj for r in actions.adjusted_close(px, ev).orderBy("date").collect()]
    f1, f2 = 1 - 10 / 200, 1 - 9 / 190
    assert got == pytest.approx([200 * f1 * f2 / 8, 190 * f2 / 8, 181 / 8, 100.0, 100.0])


def test_asof_backward_and_strict(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "t int")
    right = spark.createDataFrame([(2, "a"), (3, "b")], "t int, v string")
    assert [r.v for r in joins.asof_backward(left, right, "t", "v").orderBy("t").collect()] == [None, "a", "b"]
    assert [r.v for r in joins.asof_backward(left, right, "t", "v", strict=True).orderBy("t").collect()] == [None, None, "a"]


def test_splice_refuses_other_keys(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    ok = joins.splice(base, spark.createDataFrame([(2, 9.0)], "k int, x double"), ["k"], F.col("k") > 1)
    assert sorted(map(tuple, ok.collect())) == [(1, 1.0), (2, 9.0)]
    for bad in ([(3, 9.0)], [(2, 9.0), (2, 8.0)]):
        with pytest.raises(ValueError):
            joins.splice(base, spark.createDataFrame(bad, "k int, x double"), ["k"], F.col("k") > 1)


def test_quantile_functions_on_a_uniform(spark):
    q = [-0.03 + 0.06 * u for u in qt.LEVELS]
    df = spark.createDataFrame([(q,)], "q array<double>")
    m, v = qt.moments(F.col("q"))
    var, es = qt.var_es(F.col("q"), 0.05)
    got = df.select(m, v, var, es, qt.cdf_at_zero(F.col("q")), qt.at(F.col("q"), 0.123)).first()
    assert list(got) == pytest.approx([0, 0.06**2 / 12, -0.027, -0.0285, 0.5, -0.03 + 0.06 * 0.123], abs=1e-12)


def loop_backtest(w, r, lag, n):
    out = []
    h = np.zeros((n, w.shape[1]))
    wt = np.vstack([np.full((lag, w.shape[1]), np.nan), w[: len(w) - lag]])
    for i in range(len(r)):
        gross = turn = 0.0
        for k in range(n):
            gross += h[k] @ r[i] / n
            h[k] = h[k] * (1 + r[i])
            if i % n == k and np.isfinite(wt[i]).any():
                new = np.nan_to_num(wt[i])
                turn += np.abs(new - h[k]).sum() / n
                h[k] = new
        out.append((gross, turn))
    return np.array(out)


def test_backtest_matches_a_daily_loop(spark):
    rng = np.random.default_rng(4)
    w, r = rng.normal(size=(30, 4)) * 0.1, rng.normal(size=(30, 4)) * 0.03
    w[rng.random(w.shape) < 0.2] = np.nan
    w[10] = np.nan
    w[17] = 0
    book = spark.createDataFrame([(day(i), f"T{j}", None if np.isnan(w[i, j]) else float(w[i, j])) for i in range(30) for j in range(4)], "date date, ticker string, w double")
    ret = spark.createDataFrame([(day(i), f"T{j}", float(r[i, j])) for i in range(30) for j in range(4)], "date date, ticker string, R double")
    got = portfolio.backtest(book, ret, 1, 3).orderBy("date").toPandas()
    np.testing.assert_allclose(got[["gross", "turnover"]].to_numpy(), loop_backtest(w, r, 1, 3), atol=1e-12)


def test_newey_west_matches_a_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=50)
    got = stats.newey_west(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double"), "x", "i", 4).first()
    e = x - x.mean()
    s = e @ e / 50 + sum(2 * (1 - k / 5) * (e[k:] @ e[:-k]) / 50 for k in range(1, 5))
    assert got.se == pytest.approx(math.sqrt(s / 50)) and got.t == pytest.approx(x.mean() / math.sqrt(s / 50))


def test_benjamini_hochberg_and_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = [r.q for r in stats.benjamini_hochberg(df, "p", "i", "q").orderBy("i").collect()]
    assert got[:4] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got[4] is None
    assert [r.rejected for r in stats.holm(df.where("p is not null"), "p", "i", 0.05).orderBy("i").collect()] == [True, False, False, True]


def test_distributions():
    assert special.norm_ppf(0.05) == pytest.approx(-1.6448536269514729) and special.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709)
    assert special.binom_cdf(3, 10) == pytest.approx(176 / 1024) and special.t_ppf(0.05, 4) == pytest.approx(-2.13184678632665)


def test_har_is_causal_and_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(-9, 0.5, 140))
    frame = lambda v: spark.createDataFrame([(i, day(i), "A", float(a)) for i, a in enumerate(v)], "pos long, date date, ticker string, x double")
    one = models.har(frame(x), "x", "x", [1, 2], every=10, least=40).orderBy("pos").toPandas()
    later = x.copy()
    later[100:] *= 7
    two = models.har(frame(later), "x", "x", [1, 2], every=10, least=40).orderBy("pos").toPandas()
    np.testing.assert_allclose(one.har[:100], two.har[:100])
    s = pd.Series(x)
    feats = np.column_stack([np.ones(140), s, s.rolling(5).mean(), s.rolling(22).mean()])
    y = (s.shift(-1) + s.shift(-2)).to_numpy()
    at = 110  # a refit row
    ok = np.isfinite(feats[: at - 1]).all(1) & np.isfinite(y[: at - 1])
    b = np.linalg.lstsq(feats[: at - 1][ok], y[: at - 1][ok], rcond=None)[0]
    assert one.har[at] == pytest.approx(max(feats[at] @ b, 0.2 * feats[at, 3]), rel=1e-6)


def test_min_variance_weights():
    assert portfolio.min_variance_weights(np.diag([1.0, 4.0])) == pytest.approx([0.8, 0.2])
    c = np.array([[1.0, 1.9], [1.9, 4.0]])
    assert portfolio.min_variance_weights(c) == pytest.approx([1, 0]) and portfolio.min_variance_weights(c, False)[1] < 0


def test_mixture_recovers_weights():
    rng = np.random.default_rng(0)
    f = np.exp(rng.normal(0, 0.6, (4000, 2)))
    y = f[:, 0] ** 0.7 * f[:, 1] ** 0.3 * rng.gamma(5, 0.2, 4000)
    assert models.fit_variance_mix(np.log(f), y)[:2] == pytest.approx([0.7, 0.3], abs=0.05)


def test_forecaster_guards(spark):
    ctx = spark.createDataFrame([(day(0), "A", [0.1] * 40), (day(0), "B", [0.2] * 40)], "date date, ticker string, context array<double>")
    q = models.forecast(ctx, models.last_value_forecaster, 2).collect()
    assert len(q) == 4 and {round(r.q[10], 9) for r in q} == {0.1, 0.2}
    for kw in ({"most": 1}, {"locked_from": "2023-01-01"}):
        with pytest.raises(Exception, match="at most|locked"):
            models.forecast(ctx, models.last_value_forecaster, 2, **kw).collect()


def test_planted_signal_is_found(spark):
    from quantloom.sources.synthetic import planted_panel

    p = planted_panel(spark, 250, 40, 0.3).withColumn("f", F.lead("ret").over(wn.series("ticker", "pos")))
    ic = stats.ic_series(p, "signal", "f").agg(F.avg("ic")).first()[0]
    assert 0.08 < ic < 0.2
