"""Session cleaning rules: keep-first, winsorizing, top-N and segments."""

import pandas as pd
from pyspark.sql import functions as F

from clickpath.operators.sessions import clean_sessions, dedup_keep_first, limit_cardinality
from clickpath.sources.tables import INGEST_ORDINAL


def test_dedup_keep_first_with_null_keys(spark):
    df = spark.createDataFrame(
        [("a", 1, 0), ("a", 2, 1), (None, 3, 2), (None, 4, 3), ("b", 5, 4)], ["k", "v", INGEST_ORDINAL])
    got = {(r.k, r.v) for r in dedup_keep_first(df, "k").collect()}
    assert got == {("a", 1), (None, 3), ("b", 5)}


def _sessions(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows))


def test_clean_sessions_rules(spark):
    rows = [
        {"Session Key": "s1", "event_count": "3", "purchase_revenue_usd": "abc", "converted_purchase": "1",
         "device_category": " <Other> ", "session_duration_sec": "-5"},
        {"Session Key": "s1", "event_count": "9", "purchase_revenue_usd": "1", "converted_purchase": "0",
         "device_category": "x", "session_duration_sec": "1"},
        {"Session Key": "s2", "event_count": None, "purchase_revenue_usd": "2.5", "converted_purchase": None,
         "device_category": None, "session_duration_sec": "4"},
    ]
    df = _sessions(spark, rows).withColumn(INGEST_ORDINAL, F.monotonically_increasing_id())
    out = {r.session_key: r for r in clean_sessions(df).collect()}
    assert set(out) == {"s1", "s2"}
    s1, s2 = out["s1"], out["s2"]
    assert s1.event_count == 3.0 and s1.purchase_revenue_usd == 0.0 and s1.session_duration_sec == 0.0
    assert s1.converted_purchase == 1 and s2.converted_purchase == 0 and s1.reached_cart == 0
    assert s1.device_category == "other" and s2.device_category == "unknown" and s1.country == "unknown"


def test_winsorize_iqr_zero_means_no_clip(spark):
    rows = [{"session_key": f"s{i}", "purchase_revenue_usd": 0.0 if i < 9 else 1000.0,
             "event_count": float(i)} for i in range(10)]
    out = {r.session_key: r for r in clean_sessions(_sessions(spark, rows)).collect()}
    assert out["s9"].purchase_revenue_usd_winsorized == 1000.0  # Q1 = Q3 = 0 -> untouched
    # event_count 0..9: Q1 2.25, Q3 6.75 -> fences max(-4.5, 0) = 0 and 13.5 -> nothing clipped
    assert [out[f"s{i}"].event_count_winsorized for i in range(10)] == [float(i) for i in range(10)]


def test_limit_cardinality_tie_rule(spark):
    vals = ["b"] * 3 + ["a"] * 3 + ["c"] * 2 + ["other"] * 1 + ["d"]
    df = spark.createDataFrame([(v,) for v in vals], ["x"])
    got = [r.x for r in limit_cardinality(df, "x", 2).collect()]
    assert sorted(set(got)) == ["a", "b", "other"]
    got3 = limit_cardinality(df, "x", 3).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in got3} == {"a": 3, "b": 3, "c": 2, "other": 2}


def test_engineered_segments(spark):
    from clickpath.plans.pipeline import pipeline

    s = pipeline(spark, "/root/testdata/sf0.001").sessions
    assert s.count() == 397
    bad = s.where(
        ((F.col("converted_purchase") == 1) & (F.col("ux_intent_segment") != "Purchasers"))
        | ((F.col("cart_without_checkout") == 1))
        | (F.col("engagement_seconds_winsorized") > F.col("engagement_seconds") + 1e-9)
    ).count()
    assert bad == 0


def test_keep_first_runs_once(spark):
    """bounds and result read the kept rows; the keep-first pass is not planned again in each of them."""
    from clickpath.operators.sessions import clean_sessions

    df = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 9, "2024-01-01"), ("b", 3, "2024-01-02")], "session_key string, event_count int, session_date string")
    out = clean_sessions(df)
    assert all("/tables/typed-sessions-" in f for f in out.inputFiles()) and out.inputFiles()
    assert out.count() == 2
