"""Gap sessionization against a brute-force per-user scan."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickpath.operators.sessionize import sessionize


def brute(pdf, gap_s):
    out = {}
    for user, g in pdf.sort_values(["user_id", "event_time", "event_id"]).groupby("user_id"):
        n, prev = 0, None
        for row in g.itertuples():
            if prev is not None and (row.event_time - prev).total_seconds() > gap_s:
                n += 1
            out[row.event_id] = f"{user}-{n}"
            prev = row.event_time
    return out


@pytest.mark.parametrize("bucket", [600, 3600, 7200, 86400])
def test_hot_user_across_buckets(spark, bucket):
    base = dt.datetime(2024, 1, 1)
    rows = []
    # one hot user with gaps just below, at and above the gap, crossing many hour buckets
    t = base
    for i, step in enumerate([0, 3599, 1, 7200, 7201, 7199, 86400, 10, 7200, 3600 * 5, 3600 * 2 + 1]):
        t = t + dt.timedelta(seconds=step)
        rows.append((i, t, "hot"))
    rows += [(100 + i, base + dt.timedelta(minutes=37 * i), f"u{i % 3}") for i in range(40)]
    pdf = pd.DataFrame(rows, columns=["event_id", "event_time", "user_id"])
    df = spark.createDataFrame(pdf).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    got = {r.event_id: r.user_session for r in sessionize(df, gap_seconds=7200, bucket_seconds=bucket).collect()}
    assert got == brute(pdf, 7200)


def test_fixture_events(spark):
    from clickpath.sources.events import clean_events
    from clickpath.sources.fixture import fixture_events

    ev = clean_events(fixture_events(spark, "/root/testdata/sf0.001"), required=["event_time", "event_type", "user_id", "product_id"])
    got = {r.event_id: r.user_session for r in sessionize(ev, gap_seconds=8 * 3600).collect()}
    pdf = ev.select("event_id", "event_time", "user_id").toPandas()
    assert got == brute(pdf, 8 * 3600)
    assert len(set(got.values())) == 397  # FIXTURES.md: sessions at 8 h, sf0.001


def test_session_start_marks_first_event(spark):
    from clickpath.sources.events import clean_events
    from clickpath.sources.fixture import fixture_events

    ev = clean_events(fixture_events(spark, "/root/testdata/sf0.001"), required=["event_time", "event_type", "user_id", "product_id"])
    pdf = sessionize(ev, gap_seconds=8 * 3600, bucket_seconds=1800).select(
        "event_id", "event_time", "user_session", "session_start").toPandas()
    first = pdf.sort_values(["event_time", "event_id"]).groupby("user_session").event_id.first()
    assert set(pdf.loc[pdf.session_start == 1, "event_id"]) == set(first)


def test_log_without_event_ids_and_with_repeats(spark):
    """The same sessions with or without ids, however the rows are dealt; a repeated event makes no second session."""
    from pyspark.sql import functions as F

    from clickpath.operators.sessions import session_features
    rows = [("u", "2024-01-01 10:00:00", "view", "p1", "b"), ("u", "2024-01-01 10:00:00", "view", "p2", "a"),
            ("u", "2024-01-01 11:00:00", "cart", "p1", "b"), ("u", "2024-01-02 10:00:00", "view", "p1", "c"),
            ("v", "2024-01-01 10:00:00", "purchase", "p1", "b")]
    df = spark.createDataFrame(rows, "user_id string, t string, event_type string, product_id string, category_code string")
    df = df.select("*", F.col("t").cast("timestamp").alias("event_time"), F.lit(1.5).alias("price")).drop("t")
    results = set()
    for parts in (1, 5):
        out = sessionize(df.repartition(parts))
        assert {(r.user_session, r.n) for r in out.groupBy("user_session").agg(F.count("*").alias("n")).collect()} == {("u-0", 3), ("u-1", 1), ("v-0", 1)}
        results.add(tuple(sorted((r.session_key, r.landing_page_title) for r in session_features(out).collect())))
    assert len(results) == 1
    ided = df.withColumn("event_id", F.monotonically_increasing_id())
    twice = sessionize(ided.union(ided))
    got = {r.session_key: r.event_count for r in session_features(twice).collect()}
    assert got == {"u-0": 6, "u-1": 2, "v-0": 2}
