"""Registered queries against their SQL on the smallest tables."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from tidewire.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["returns", "abnormal_returns", "labels", "base_rates", "weekly", "anomaly_signals", "leadlag_pairs", "volatility_bands", "univariate_signal", "theme_portfolio", "earnings_surprise", "asof_forward", "macro_surprise", "rule_calendar",
        "figures", "lexicon_score", "mentions", "novelty", "alarms", "attention_burst", "macro_contribution", "top_evidence", "source_weights", "cluster_features", "signals", "route_articles", "probabilities", "reliability", "offsets", "local_time", "upsert", "windowed_attention", "story_sessions",
        "signals_history", "attention_panel", "event_study", "weighting_schemes", "asymmetry_persistence",
        "signals_with_macro", "route_layers", "calibration_error", "applied_offsets", "p_up_given_z", "earnings_summary", "market_proxy", "pre_event_context", "same_story_scores", "decile_table"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, float) or hasattr(v, "as_integer_ratio"):
        return f"{float(v):.5f}"
    return str(v)[:19].replace(" 00:00:00", "") if isinstance(v, (dt.date, dt.datetime)) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a = sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
    b = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    assert a == b


def test_registry_is_whole():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.SQL) <= set(registry.QUERIES)
