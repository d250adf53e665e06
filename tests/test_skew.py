"""Hot keys: one user / one key holding a third of all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clickpath.operators.sessionize import sessionize
from clickpath.operators.sessions import dedup_keep_first


def pandas_sessions(pdf, gap_us):
    pdf = pdf.sort_values(["user_id", "us", "event_id"])
    gaps = (pdf.groupby("user_id").us.diff() > gap_us).astype(int)
    n = gaps.groupby(pdf.user_id).cumsum()
    return dict(zip(pdf.event_id, pdf.user_id + "-" + n.astype(str)))


def test_sessionize_with_a_hot_user(spark):
    rng = np.random.default_rng(7)
    n = 60_000
    hot = n // 3
    users = np.concatenate([np.full(hot, "hot"), rng.integers(0, 2_000, size=n - hot).astype(str)])
    # the hot user is dense (seconds apart) with occasional long pauses; others are sparse
    us = np.concatenate([
        np.cumsum(rng.integers(1, 30, size=hot) * 1_000_000 + (rng.random(hot) < 0.001) * 9 * 3600 * 1_000_000),
        rng.integers(0, 30 * 86400, size=n - hot) * 1_000_000,
    ])
    pdf = pd.DataFrame({"event_id": np.arange(n), "user_id": users, "us": us})
    df = spark.createDataFrame(pdf).withColumn(
        "event_time", F.timestamp_micros(F.col("us")).cast("timestamp_ntz"))
    got = sessionize(df.drop("us"), gap_seconds=8 * 3600).select("event_id", "user_session").toPandas()
    expected = pandas_sessions(pdf, 8 * 3600 * 1_000_000)
    assert dict(zip(got.event_id, got.user_session)) == expected
    assert got.user_session.str.startswith("hot-").sum() == hot


def test_dedup_with_a_hot_key(spark):
    n = 30_000
    keys = ["hot"] * (n // 3) + [f"k{i % 5000}" for i in range(n - n // 3)]
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": np.arange(n), "_ingest_ordinal": np.arange(n)[::-1]}))
    got = {r.k: r.v for r in dedup_keep_first(df, "k").collect()}
    pdf = pd.DataFrame({"k": keys, "v": np.arange(n), "o": np.arange(n)[::-1]}).sort_values("o")
    assert got == pdf.drop_duplicates("k").set_index("k").v.to_dict()
