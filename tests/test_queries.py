"""Registered queries against DuckDB on the smallest tables, and the entry's contract."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quantloom.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = ("m0", "m1", "r16", "r18", "r24", "b04", "b06", "c06", "c09", "x14", "k10", "c02")
SOME = tuple(n for n in sorted(ORACLE) if not n.startswith(SLOW))[::3]
WHOLE = ("f05_f11_mean_exp", "w11_vol_ewma", "w22_smooth_signal", "w25_hs_var_es", "w26_ewma_corr", "r29_r30_r31_event_response", "m13_fhs", "m14_conformal_scale", "x13_upserts", "x13_keep_last", "b17_finalize", "k06_k07_pull_outcomes")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v != v:
        return ""
    return f"{v:.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) else str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted({*SOME, *WHOLE}))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    for c in cols:  # integers that nulls turned into floats compare as numbers
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["date", "ticker", "signal", "rank", "weight"] and not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 120


def test_entry_without_the_training_data_package(monkeypatch):
    monkeypatch.setattr(entry, "_llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
