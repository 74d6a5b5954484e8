"""Queries over tables that the small samples lack: prices of 0, tied means, fewer days than names."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom.operators.portfolio import min_variance_weights
from quantloom.plans import ORACLE, QUERIES, evaluation_q


@pytest.fixture(scope="module")
def zero_prices(tmp_path_factory):
    """Events of two types over three days; one price of 0, and on the last day two in a row."""
    rng, path, rows = np.random.default_rng(3), tmp_path_factory.mktemp("zeros"), []
    for i in range(240):
        ts = datetime(2024, 1, 1, 10) + timedelta(days=i // 80, minutes=5 * (i % 80))
        rows.append((i, ts, int(rng.integers(6)), "ab"[i % 2], 0.0 if i in (100, 200, 202) else float(rng.uniform(1, 9))))
    con = duckdb.connect()
    con.register("rows", pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}))
    con.execute(f"copy (select * from rows) to '{path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    return con, str(path)


@pytest.mark.parametrize("name", ["g04_realized_variance", "g15_g18_portfolio_rv", "g16_residual_rv", "g17_futures_rv", "m25_log_rv_series"])
def test_zero_prices_count_as_in_sql(spark, zero_prices, name):
    con, path = zero_prices
    got, want = QUERIES[name](spark, path).toPandas(), con.execute(ORACLE[name]).df()
    text = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want) and any("inf" in r or "nan" in r for r in text(got))


@pytest.fixture(scope="module")
def odd_bars(tmp_path_factory):
    """Events over three days, three at a time: some without a type, some that come last at their time for want of an id, some with a value under 0."""
    rng, path = np.random.default_rng(4), tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    for i in range(360):
        ts = datetime(2024, 1, 1, 10) + timedelta(days=i // 120, minutes=5 * (i % 120 // 3))
        value = float(rng.uniform(1, 9))
        con.execute("insert into events values (?, ?, ?, ?, ?)", [None if i % 15 == 0 else i, ts, i % 7, ["a", "a", "b", None][i % 4], -value if i == 300 else value])
    con.execute(f"copy events to '{path}/events.parquet' (format parquet)")
    return con, str(path)


@pytest.mark.parametrize("name", ["m25_log_rv_series", "g15_g18_portfolio_rv", "g16_residual_rv"])
def test_odd_bars_count_as_in_sql(spark, odd_bars, name):
    con, path = odd_bars
    got, want = QUERIES[name](spark, path), con.execute(ORACLE[name])
    order = [c[0] for c in want.description]
    text = lambda rows: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    got, want = text(got.select(order).collect()), text(want.fetchall())
    assert got == want and any("nan" in r for r in got) and not all("nan" in r for r in got)


def test_tied_means_go_by_name(spark, monkeypatch):
    rows = [("resid_60_down", 0.46315895753139497), ("plain_60_down", 0.4631589575313943), ("plain_20_down", 0.463728813559322), ("resid_20_down", 0.46372881355932216)]
    monkeypatch.setattr(evaluation_q, "_sweep", lambda s, d: s.createDataFrame(rows, "signal string, mean double"))
    assert [r.config for r in QUERIES["c09_winners"](spark, "").collect()] == ["plain_20_down", "resid_20_down", "plain_60_down"]


@pytest.mark.parametrize("days", [1, 2, 9, 40])
def test_fewer_days_than_names_have_a_minimum(days):
    x = np.round(np.random.default_rng(days).normal(size=(days, 12)) * 2) + 0.5
    x[:, 3] = x[:, 7]  # and two names alike: singular however many days
    cov = x.T @ x
    w = min_variance_weights(cov)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert (cov @ w >= w @ cov @ w - 1e-6 * np.mean(np.diag(cov))).all()  # no name lowers the variance
    assert abs(min_variance_weights(cov, False).sum() - 1) < 1e-9
