"""Structured Streaming sessions agree with batch sessionization (closed sessions)."""

from datetime import timedelta

from pyspark.sql import functions as F

from clickpath.streaming import jobs as SJ

SF = "/root/testdata/sf0.001"


def test_closed_stream_sessions_match_batch(spark):
    from clickpath.plans.pipeline import pipeline

    stream = spark.read.parquet(SJ.run_to_table(SJ.session_counts(SJ.stream_events(spark, f"{SF}/events.parquet")), "t"))
    batch = pipeline(spark, SF).session_features.select(
        F.col("user_pseudo_id").alias("user_id"), F.col("session_start_ts").cast("timestamp").alias("session_start"),
        "event_count", "view_item_count", "add_to_cart_count", "purchase_count")
    s_rows = {tuple(r) for r in stream.select("user_id", "session_start", "event_count", "view_item_count",
                                               "add_to_cart_count", "purchase_count").collect()}
    b_rows = {tuple(r) for r in batch.collect()}
    assert s_rows, "the watermark closed no session"
    # every closed streaming session is a batch session (gaps of exactly 8 h never occur in the fixture)
    assert s_rows <= b_rows
    # only sessions still open at the end of the stream may be missing: those that the watermark has not passed
    late = pipeline(spark, SF).events.agg(F.max("event_time")).first()[0] - timedelta(hours=8)
    ends = pipeline(spark, SF).session_features.select("session_end_ts").collect()
    assert len(s_rows) == sum(r.session_end_ts + timedelta(hours=8) <= late for r in ends)


def test_stream_daily_counts_match_batch_days(spark):
    from clickpath.operators.scorecards import daily_overview
    from clickpath.plans.pipeline import pipeline

    stream = spark.read.parquet(SJ.run_to_table(SJ.daily_counts(SJ.stream_events(spark, f"{SF}/events.parquet")), "d"))
    batch = {r.event_dt: r for r in daily_overview(pipeline(spark, SF).events).collect()}
    rows = stream.collect()
    assert rows
    for r in rows:  # closed days carry exactly the batch counts
        b = batch[r.event_dt]
        assert (r.total_events, r.page_views, r.add_to_cart_events, r.purchase_events, r.purchase_revenue_usd) == (
            b.total_events, b.page_views, b.add_to_cart_events, b.purchase_events, b.purchase_revenue_usd)


def test_restarted_query_goes_on_and_repeats_nothing(spark, tmp_path):
    """A second run over one more file appends what is new; a third one over nothing appends nothing."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    middle = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("m")).first().m
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    log, root = str(tmp_path / "log"), str(tmp_path / "streams")

    def run():
        path = SJ.run_to_table(SJ.session_counts(SJ.stream_events(spark, log)), "s", root)
        return sorted(map(tuple, spark.read.parquet(path).collect()))

    events.where(early).coalesce(1).write.mode("append").parquet(log)
    first = run()
    events.where(~early).coalesce(1).write.mode("append").parquet(log)
    second = run()
    assert first and len(second) > len(first) and set(first) <= set(second)
    assert len(set(second)) == len(second) and run() == second


def test_nan_prices_and_odd_products(spark, tmp_path):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0, 7, "purchase", float("nan"), '{"k": 1}'), (2, t0 + timedelta(minutes=1), 7, "purchase", 2.5, '{"k": 2}'),
            (3, t0 + timedelta(minutes=2), 7, "view", 1.0, '{"k": "x"}'), (4, t0 + timedelta(days=9), 8, "view", 1.0, '{"k": 3}')]
    log = str(tmp_path / "log")
    spark.createDataFrame(rows, SJ.RAW_EVENT_SCHEMA).coalesce(1).write.parquet(log)
    out = spark.read.parquet(SJ.run_to_table(SJ.session_counts(SJ.stream_events(spark, log)), "n", str(tmp_path / "s"))).collect()
    assert [(r.user_id, r.event_count, r.purchase_revenue_usd) for r in out] == [("7", 2, 2.5)]
