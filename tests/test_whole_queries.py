"""Queries over whole tables: every name and date has its result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import models as md, stats as st
from quantloom.operators.portfolio import min_variance_weights
from quantloom.plans import QUERIES
from quantloom.plans.base import panel, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole_panel(spark):
    return panel(spark, SF).toPandas().sort_values(["ticker", "date"])


def test_mean_exp_reads_all_vectors(spark):
    from quantloom.functions.quantiles import LEVELS

    u, g = np.array(LEVELS), (np.arange(199) + 0.5) / 199
    want = {}
    for r in table(spark, SF, "embeddings").select("label", "embedding").collect():
        want[r.label] = want.get(r.label, 0.0) + np.exp(np.interp(g, u, sorted(map(float, r.embedding[:21])))).mean()
    got = {r.label: r.e for r in QUERIES["f05_f11_mean_exp"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_var_es_has_every_name(spark, whole_panel):
    got = {(r.ticker, r.date): (r["var"], r.es) for r in QUERIES["w25_hs_var_es"](spark, SF).collect()}
    want = {}
    for t, g in whole_panel.groupby("ticker"):
        x, days = g.ret.to_numpy(float), g.date.to_list()
        for i in range(len(x)):
            y = x[max(i - 249, 0) : i + 1]
            y = y[np.isfinite(y)]
            if len(y) >= 100:
                v = np.quantile(y, 0.05)
                want[t, days[i]] = (v, y[y <= v].mean())
    assert got.keys() == want.keys() and len({t for t, _ in want}) > 3
    assert max(abs(np.subtract(got[k], want[k])).max() for k in want) < 2e-6


def test_books_have_every_name_and_date(spark, whole_panel):
    rows = QUERIES["b04_w27_vol_target_overlay"](spark, SF).collect()
    assert {(r.ticker, r.date) for r in rows} == set(zip(whole_panel.ticker, whole_panel.date, strict=True))
    last = whole_panel.date.max()
    book = {r.ticker: r.w for r in QUERIES["b06_b08_min_variance"](spark, SF).where(F.col("date") == last).collect()}
    wide = whole_panel.pivot(index="date", columns="ticker", values="ret")
    names = sorted(book)
    assert len(names) > 5
    s = np.zeros((len(names), len(names)))
    for x in wide[names].fillna(0.0).to_numpy():
        s = 0.97 * s + 0.03 * np.outer(x, x)
    sd = wide[names].iloc[-20:].std().to_numpy()
    rho = s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
    assert np.abs(min_variance_weights(rho * np.outer(sd, sd)) - [book[n] for n in names]).max() < 1e-6


@pytest.mark.parametrize("name", ["m07_m08_garch", "m09_garch_t"])
def test_garch_gets_every_name_and_date(name, spark, whole_panel, monkeypatch):
    asked = {}
    monkeypatch.setattr(md, "garch", lambda p, *a, **kw: asked.update(kw) or p.select("ticker", "date"))
    rows = QUERIES[name](spark, SF).collect()
    assert {(r.ticker, r.date) for r in rows} == set(zip(whole_panel.ticker, whole_panel.date, strict=True))
    assert not {"every", "least"} & set(asked)


def test_garch_fits_returns_of_any_scale():
    assert len(fit_any := md.fit_garch(np.full(300, 1e-9), True)) == 5 and np.isfinite(fit_any).all()


def test_draws_and_refits_are_the_full_counts(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(st, "permutation_ic", lambda *a: asked.update(r24=a[3]))
    monkeypatch.setattr(st, "block_bootstrap", lambda *a: asked.update(r18=a[4]))
    monkeypatch.setattr(md, "rolling_mixture", lambda p, *a, **kw: asked.update(m15=kw) or p.withColumn("mix", F.lit(1.0)))
    for name in ("r24_permutation_null", "r18_r20_block_bootstrap", "m15_m17_rolling_mixture"):
        QUERIES[name](spark, SF)
    assert asked == {"r24": 1000, "r18": 2000, "m15": {}}


def test_accuracies_of_every_year(spark, whole_panel):
    x = whole_panel[whole_panel.ret.notna()].copy()
    x["hit"] = (np.sign(x.ret) == np.sign(x.groupby("ticker").ret.shift(-1))).astype(float)
    want = x.groupby(["ticker", x.date.map(lambda v: v.year)]).hit.mean().to_dict()
    got = {(r.ticker, r.year): r.accuracy for r in QUERIES["c33_accuracy_table"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_pairs_over_all_dates(spark, whole_panel):
    wide = whole_panel.pivot(index="date", columns="ticker", values="ret").astype(float)
    late = wide.shift(-2)
    got = {(r.leader, r.follower): (r.n, r.rho) for r in QUERIES["j16_j17_r28_offset_pairs"](spark, SF).collect()}
    sd = wide.shift(1).rolling(60, min_periods=20).std()
    event = wide.abs() > 1.5 * sd
    seen = {(r.leader, r.follower, r.lag): r.n_events for r in QUERIES["r29_r30_r31_event_response"](spark, SF).collect()}
    assert got and seen
    for a in wide:
        for b in wide:
            ok = wide[a].notna() & late[b].notna()
            if a != b and ok.sum() >= 30:
                assert got[a, b][0] == ok.sum() and abs(got[a, b][1] - np.corrcoef(wide[a][ok], late[b][ok])[0, 1]) < 2e-6
            for lag in (1, 2):
                n = (event[a] & wide[b].shift(-lag).notna()).sum()
                assert a == b or seen.get((a, b, lag), 0) == (n if n >= 5 else 0)


def test_forecasts_and_mixtures_of_all_years(spark):
    f = QUERIES["m03_m04_forecast"](spark, SF).agg(F.min("date").alias("a"), F.max("date").alias("z")).first()
    assert (f.a.year, f.z.year) == (1995, 2000)
    assert {r.year for r in QUERIES["m16_tail_mixture"](spark, SF).collect()} == set(range(1995, 2002))


def test_garch_is_the_recursion_row_by_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(scale=0.01, size=90)
    rows = [("A", i, float(v) if i % 11 else None) for i, v in enumerate(x)]
    got = {r.pos: r.variance for r in md.garch(spark.createDataFrame(rows, "ticker string, pos long, ret double"), "ret", [1, 2], 21, 30, 40).collect()}
    want, fit, seen, nxt = {}, None, [], 0.0
    for _, pos, v in rows:
        if v is None:
            continue
        seen.append(v * 100)
        if len(seen) < 30:
            continue
        if fit is None or pos % 21 == 0:
            past = np.array(seen[-40:])
            fit, nxt = md.fit_garch(past), float(np.var(past))
            for e in past:
                nxt = fit[1] + fit[2] * (e - fit[0]) ** 2 + fit[3] * nxt
        else:
            nxt = fit[1] + fit[2] * (seen[-1] - fit[0]) ** 2 + fit[3] * nxt
        keep = fit[2] + fit[3]
        level = fit[1] / (1 - keep)
        want[pos] = sum(level + keep ** (h - 1) * (nxt - level) for h in (1, 2)) / 1e4
    assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 1e-9 for k in want)


def test_mixtures_are_fitted_on_the_window_before(spark):
    rng = np.random.default_rng(4)
    rows = [(t, p, *map(float, rng.uniform(0.5, 2, 3))) for p in range(60) for t in "AB"]
    df = spark.createDataFrame(rows, "ticker string, pos long, y double, fa double, fb double")
    out = {r.pos: r.mix for r in md.rolling_mixture(df, "y", ["fa", "fb"], 2, 20, 7, 10).where("ticker = 'A' and mix is not null").collect()}
    fits = {}
    for t in range(0, 60, 7):
        x = np.array([r[2:] for r in rows if t - 22 < r[1] <= t - 2])
        if len(x) >= 10:
            fits[t] = md.fit_variance_mix(np.log(x[:, 1:]), x[:, 0])
    assert out.keys() == set(range(min(fits), 60))
    for t, p, _, fa, fb in rows:
        if t == "A" and p in out:
            k = fits[max(x for x in fits if x <= p)]
            assert abs(np.log(out[p]) - (k[2] + k[0] * np.log(fa) + k[1] * np.log(fb))) < 1e-6


def test_permutations_average_to_nothing(spark, whole_panel):
    p = spark.createDataFrame([(r.date, r.ticker, r.ret, r.ret) for r in whole_panel.dropna(subset=["ret"]).itertuples()], "date date, ticker string, s double, f double")
    x = np.array([r.ic for r in st.permutation_ic(p, "s", "f", 200).collect()])
    assert len(x) == 200 and abs(x.mean()) < 0.01 and 0 < x.std() < 0.05
    assert st.permutation_ic(p.limit(0), "s", "f", 5).count() == 0


def test_pooled_tails_slide_over_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(p, float(rng.normal())) for p in range(95) for _ in range(3)]
    got = {r.pos: (r.q, r.tail) for r in md.pooled_tail(spark.createDataFrame(rows, "pos long, z double"), "z", 0.1, 2, 20, 12).collect()}
    for t in range(95):
        v = np.array([z for p, z in rows if t - 22 < p <= t - 2])
        assert (t in got) == (len(v) >= 12)
        if t in got:
            q = np.quantile(v, 0.1)
            assert abs(got[t][0] - q) < 1e-12 and abs(got[t][1] - v[v <= q].mean()) < 1e-12
