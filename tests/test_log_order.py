"""The order of a log of several files, the account of the cleaning step, and sinks that can be repeated."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickpath.operators.sessions import clean_sessions, session_features
from clickpath.schema import EVENT_SCHEMA
from clickpath.sources.events import clean_events, clean_events_counted, read_event_log
from clickpath.sources.tables import INGEST_ORDINAL, read_csv_table, write_bucketed, write_table

NAMES = EVENT_SCHEMA.fieldNames()


def log_rows(n=400, sessions=7):
    rng = random.Random(9)
    return [{"event_time": "2020-09-24 11:57:06 UTC", "event_type": rng.choice(["view", "cart"]), "product_id": str(k), "category_code": f"c{k}",
             "brand": "b", "price": "1.0", "user_id": f"u{k}", "user_session": f"s{rng.randrange(sessions)}"} for k in range(n)]


def write_log(folder, rows, files):
    """Files of very different sizes, named in the order of the log."""
    folder.mkdir()
    cuts = sorted(random.Random(files).sample(range(1, len(rows)), files - 1))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        lines = [",".join(NAMES)] + [",".join(r.get(n, "1") for n in NAMES) for r in rows[a:b]]
        (folder / f"log-{k:03d}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.mark.parametrize("split_bytes", ["128m", "2000", "300"])
@pytest.mark.parametrize("files", [1, 5])
def test_the_first_in_the_log_is_first(spark, tmp_path, split_bytes, files):
    rows = log_rows()
    path = write_log(tmp_path / "log", rows, files)
    first = {}
    for r in rows:
        first.setdefault(r["user_session"], (r["user_id"], r["category_code"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        log = read_event_log(spark, path)
        assert [r.product_id for r in log.orderBy(INGEST_ORDINAL).collect()] == [r["product_id"] for r in rows]
        got = session_features(clean_events(log).repartition(3)).collect()
        assert {r.session_key: (r.user_pseudo_id, r.landing_page_title) for r in got} == first
        sessions = read_csv_table(spark, path).withColumnRenamed("user_session", "session_key")
        assert {r.session_key: r.user_id for r in clean_sessions(sessions).collect()} == {k: v[0] for k, v in first.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_every_row_of_a_log_is_accounted_for(spark, tmp_path):
    rows = [("2020-01-01 00:00:00 UTC", "view", "p", "1.5", "u", "s"), ("bad", "view", "p", "1", "u", "s"), ("2020-01-01", None, "p", "1", "u", "s"),
            (None, "other", None, "-1", None, None), ("2020-01-01", "other", "p", "-1", "u", "s"), ("2020-01-01", "cart", "p", "-0.5", "u", "s"),
            ("2020-01-01", "cart", "p", None, "u", "s"), ("2020-01-01", "cart", None, "x", "u", "s"), ("2020-01-01", "cart", "p", "NaN", "u", None)]
    df = spark.createDataFrame(rows, "event_time string, event_type string, product_id string, price string, user_id string, user_session string")
    clean, rejected, counts = clean_events_counted(df, str(tmp_path / "events"))
    want = {"missing_event_time": 2, "missing_event_type": 1, "missing_user_id": 0, "missing_user_session": 1, "missing_product_id": 1,
            "other_event_type": 1, "negative_price": 1, "kept": 2}
    assert counts == want
    assert Counter(r.rule for r in rejected.collect()) == {k: v for k, v in want.items() if v and k != "kept"}
    same = clean_events(df)
    assert sorted(map(str, clean.select(same.columns).collect())) == sorted(map(str, same.collect()))


def test_one_day_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-02", 2), ("c", "2024-01-02", 3)], "k string, d string, n int")
    write_table(df, path, partition_by=["d"])
    others = sorted(f.name for f in (tmp_path / "t" / "d=2024-01-01").iterdir())
    for n in (10, 20, 20):
        write_table(df.where("d = '2024-01-02'").withColumn("n", F.lit(n)), path, partition_by=["d"], only_partitions=True)
    assert sorted((r.k, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 20), ("c", 20)]
    assert sorted(f.name for f in (tmp_path / "t" / "d=2024-01-01").iterdir()) == others
    write_table(df.limit(0), path, partition_by=["d"], only_partitions=True)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        write_table(df, path, only_partitions=True)
    write_table(df.limit(1), path, partition_by=["d"])
    assert spark.read.parquet(path).count() == 1


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_key"), "id")
    a = write_bucketed(df, "bucketed_a", str(tmp_path / "a"), "session_key", 4)
    b = write_bucketed(df.withColumnRenamed("id", "other"), "bucketed_b", str(tmp_path / "b"), "session_key", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = a.join(b, "session_key")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("id = other").count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE {t}")
