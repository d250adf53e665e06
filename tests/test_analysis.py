"""The two end-to-end entry points write every table."""

import tempfile

from clickpath.plans.analysis import prepare_event_log, run_analysis
from clickpath.sources.fixture import fixture_events


def test_prepare_then_analyse(spark):
    out_dir = tempfile.mkdtemp(prefix="clickpath-e2e-")
    raw = fixture_events(spark, "/root/testdata/sf0.001")
    prepared = prepare_event_log(raw, f"{out_dir}/raw")
    sessions = spark.read.parquet(prepared["session_features"])
    assert sessions.count() == 397
    assert spark.read.parquet(prepared["event_overview"]).count() >= 28
    product = spark.read.parquet(prepared["product_discovery"])
    outputs = run_analysis(sessions, f"{out_dir}/out", product=product)
    counts = {k: spark.read.parquet(v).count() for k, v in outputs.items()}
    assert counts["overall_funnel"] == 6 and counts["statistical_tests"] == 16
    assert counts["model_performance"] == 1 and counts["session_features_clean"] == 397
    assert counts["product_discovery_scorecard"] == product.count()
    funnel = {r.step: r.sessions for r in spark.read.parquet(outputs["overall_funnel"]).collect()}
    assert funnel["Purchase"] == 172
