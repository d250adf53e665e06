"""Adapter from the driver tables to a raw clickstream event log.

The driver's ``events`` table carries (event_id, ts, user_id, event_type,
value, props). It is mapped onto the event-log layout the pipeline expects:

* event types view / click / purchase become view / cart / purchase; with the
  checkout taxonomy signup becomes checkout; other types are dropped by the
  event-type filter
* ``product_id`` is ``props.k``; brand and category come from ``part``
  (NULL for every tenth product so the ``unknown`` default is exercised)
* per-user attributes come from ``customer`` / ``nation`` / ``region``; the
  device is derived from the user id

Sessions are not part of the driver data; ``operators.sessionize`` derives
them from an inactivity gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickpath.schema import DEFAULT_TAXONOMY, SESSION_ATTRIBUTE_DEFAULTS, Taxonomy
from clickpath.sources.tables import read_table

DEVICES = ["desktop", "mobile", "tablet"]


def fixture_events(spark: SparkSession, sf_dir: str, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Raw events (no session yet): event_id, event_time, event_type,
    product_id, category_code, brand, price, user_id."""
    ev = read_table(spark, sf_dir, "events")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    mapping = F.when(F.col("event_type") == "click", F.lit(taxonomy.cart))
    if taxonomy.checkout is not None:
        mapping = mapping.when(F.col("event_type") == "signup", F.lit(taxonomy.checkout))
    mapping = mapping.otherwise(F.col("event_type"))
    # raw types that map into the taxonomy: a bare IN predicate that reaches the parquet scan
    raw_types = sorted(set(taxonomy.event_types) | {"click"} | ({"signup"} if taxonomy.checkout is not None else set()))
    raw = ev.where(F.col("event_type").isin(raw_types)).select(
        "event_id",
        F.col("ts").alias("event_time"),
        mapping.alias("event_type"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        F.col("value").alias("price"),
        F.col("user_id"),
    )
    # part is a dimension keyed by p_partkey; Spark broadcasts it only while its
    # measured size is under the broadcast threshold, else it plans a shuffle join.
    joined = raw.join(part, raw.k == part.p_partkey, "left")
    keep = (F.col("k") % 10) != 0
    return joined.select(
        "event_id",
        "event_time",
        "event_type",
        F.col("k").alias("product_id"),
        F.when(keep, F.concat(F.lower("p_type"), F.lit("."), F.lower(F.regexp_replace("p_brand", "#", ""))))
        .alias("category_code"),
        F.when(keep, F.col("p_brand")).alias("brand"),
        "price",
        "user_id",
    )


def fixture_user_attributes(spark: SparkSession, sf_dir: str, with_device: bool = True) -> DataFrame:
    """Per-user session attributes: device, country, region, traffic source.

    One row per customer; the nation and region dimensions are fixed-size
    (25 and 5 rows)."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    users = cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey, "left")
    device = F.element_at(F.array(*[F.lit(d) for d in DEVICES]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return users.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        (device if with_device else F.lit(SESSION_ATTRIBUTE_DEFAULTS["device_category"])).alias("device_category"),
        F.lit(SESSION_ATTRIBUTE_DEFAULTS["operating_system"]).alias("operating_system"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("traffic_source"),
        F.lit(SESSION_ATTRIBUTE_DEFAULTS["traffic_medium"]).alias("traffic_medium"),
        F.lit(SESSION_ATTRIBUTE_DEFAULTS["traffic_campaign"]).alias("traffic_campaign"),
    )
