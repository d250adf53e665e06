"""Structured Streaming jobs: gap sessions (X2) and daily event counts.

Events arrive as files (parquet here; any file or Kafka source works the same);
watermarks bound the state, and closed windows are appended to a parquet sink.
A query's sink and checkpoint have fixed places under its root, so a query that is
started again with the same name and root resumes where it stopped and
appends only what is new. These two are plain window aggregates: rows behind the watermark are dropped and a redelivered event
counts again; ``streaming.stateful`` has the jobs that account for such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickpath.context import checkpoint_dir, configure
from clickpath.functions.columns import EXACT, exact_sum, nan_to_null
from clickpath.schema import DEFAULT_TAXONOMY, Taxonomy

RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def stream_events(spark: SparkSession, path: str, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                  files_per_trigger: int | None = None) -> DataFrame:
    """Typed clickstream events from a file stream (type filter, product and price rules as in batch).

    ``files_per_trigger`` bounds a micro-batch; by default one takes all files there are.
    """
    reader = spark.readStream.schema(RAW_EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet"):
        # a single file: a file stream watches folders or globs, so name the file by a glob
        folder, name = path.rsplit("/", 1)
        path = f"{folder}/{name.replace('.', '[.]')}"
    ev = reader.parquet(path)
    mapping = F.when(F.col("event_type") == "click", F.lit(taxonomy.cart))
    if taxonomy.checkout is not None:
        mapping = mapping.when(F.col("event_type") == "signup", F.lit(taxonomy.checkout))
    typed = ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        mapping.otherwise(F.col("event_type")).alias("event_type"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").try_cast("bigint").cast("string").alias("product_id"),
        nan_to_null("value").alias("price"),
    )
    typed = typed.dropna(subset=["event_time", "event_type", "user_id", "product_id"])
    return typed.where(F.col("event_type").isin(taxonomy.event_types) & (F.col("price").isNull() | (F.col("price") >= 0)))


def session_counts(events: DataFrame, gap: str = "8 hours", taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """One row per closed (user, session window): start, end and per-type counts."""
    t = taxonomy
    etype = F.col("event_type")
    return (
        events.withWatermark("event_time", gap)
        .groupBy("user_id", F.session_window("event_time", gap).alias("session"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(etype == t.view).alias("view_item_count"),
            F.count_if(etype == t.cart).alias("add_to_cart_count"),
            F.count_if(etype == t.purchase).alias("purchase_count"),
            exact_sum(F.when(etype == t.purchase, F.col("price"))).alias("purchase_revenue_usd"),
        )
        .select("user_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                "event_count", "view_item_count", "add_to_cart_count", "purchase_count",
                F.coalesce("purchase_revenue_usd", F.lit(0.0)).alias("purchase_revenue_usd"))
    )


def daily_counts(events: DataFrame, delay: str = "1 hour", taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Events, distinct users, per-type counts and revenue per UTC day, once the watermark passes it.

    Two chained window aggregates, as a stream has no distinct count: one row a (day, user), whose
    state is bounded by the day's users, then one a day.
    """
    t = taxonomy
    etype = F.col("event_type")
    revenue = F.when(etype == t.purchase, F.col("price")).cast("double").try_cast(EXACT)
    by_user = (
        events.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("day"), "user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(etype == t.view).alias("views"),
            F.count_if(etype == t.cart).alias("carts"),
            F.count_if(etype == t.purchase).alias("purchases"),
            F.sum(revenue).alias("revenue"),
        )
    )
    return (
        by_user.groupBy(F.window(F.window_time("day"), "1 day").alias("day"))
        .agg(F.sum("n").alias("total_events"), F.count(F.lit(1)).alias("users"), F.sum("views").alias("page_views"),
             F.sum("carts").alias("add_to_cart_events"), F.sum("purchases").alias("purchase_events"),
             F.sum("revenue").cast("double").alias("purchase_revenue_usd"))
        .select(F.to_date(F.col("day.start")).alias("event_dt"), "total_events", "users", "page_views",
                "add_to_cart_events", "purchase_events",
                F.coalesce("purchase_revenue_usd", F.lit(0.0)).alias("purchase_revenue_usd"))
    )


def run_to_table(stream: DataFrame, name: str, root: str | None = None) -> str:
    """Run a streaming aggregate to completion over the files present now
    (``availableNow``), appending closed windows to parquet; returns the table path.

    The call returns when all files are processed and raises if the query fails. With the
    same ``root`` and ``name`` it goes on from its checkpoint; the default root is
    one of this application, in the shared checkpoint folder.
    """
    spark = configure(stream.sparkSession)
    if root is None:
        root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{spark.sparkContext.applicationId}"
    base = f"{root.rstrip('/')}/{name}"
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return f"{base}/data"
