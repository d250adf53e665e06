"""Driver contract: entry, registry and DuckDB twins on the smallest fixture."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_entry_funnel(spark):
    rows = entry.entry(spark).collect()
    assert [r.step for r in rows][0] == "Sessions" and len(rows) == 6
    assert rows[0].sessions == 397


def test_every_oracle_key_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", [
    "events_clean", "session_features", "sessions_clean", "session_features_engineered", "overall_funnel",
    "behavior_segments", "landing_scorecard", "product_scorecard", "daily_overview", "chi2_landing_purchase",
    "mwu_engagement_purchase", "kw_landing_engagement", "spearman_events_depth", "chi2_weekend_purchase",
    "high_intent_fixed_score", "landing_path", "model_frame", "session_features_given", "streaming_sessions", "iqr_bounds",
    "events_from_csv", "session_features_from_csv", "sessions_from_csv", "sink_round_trip", "bucketed_join", "cleaning_account",
    "streaming_sessions_exact", "streaming_daily_corrected", "streaming_late_rows", "limit_cardinality", "product_discovery", "weekly_totals",
    "streaming_daily", "normality_checks", "train_test_split", "model_metrics_fixed_score",
])
def test_spark_matches_duckdb(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, res.fetchall())
