"""Funnel and scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickpath.functions.columns import EXACT, clean_category, exact_avg, exact_sum, landing_path, safe_divide, to_number
from clickpath.operators.ranks import grouped_quantiles
from clickpath.schema import (
    DAILY_COLUMNS,
    DEFAULT_TAXONOMY,
    FUNNEL_STEPS,
    LANDING_MEASURES,
    PRODUCT_COLUMNS,
    PRODUCT_MEASURES,
    Taxonomy,
)


# ---------------------------------------------------------------------------
# Overall funnel
# ---------------------------------------------------------------------------
def overall_funnel(sessions: DataFrame, steps: list[tuple[str, str]] = FUNNEL_STEPS) -> DataFrame:
    """Marginal funnel: each step counts its own flag over all sessions.

    One global aggregate (partial sums per task, one tiny final merge) yields
    all step counts in a single row; ``stack`` turns it into one row per step,
    each carrying the previous step's count, so no window is needed.
    """
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, (_, col) in enumerate(steps):
        if col != "session_key":
            aggs.append(F.coalesce(F.sum(col), F.lit(0)).cast("bigint").alias(f"_s{i}"))
    row = sessions.agg(*aggs)
    counts = [F.col("_total") if col == "session_key" else F.col(f"_s{i}") for i, (_, col) in enumerate(steps)]
    args = []
    for i, (label, _) in enumerate(steps):
        prev = F.col("_total") if i == 0 else counts[i - 1]
        args += [F.lit(i), F.lit(label), counts[i], prev]
    long = row.select(F.stack(F.lit(len(steps)), *args).alias("_ord", "step", "sessions", "_prev"), "_total")
    conv = safe_divide(F.col("sessions"), F.col("_prev"))
    return long.select(
        "_ord",
        "step",
        F.col("sessions").cast("bigint").alias("sessions"),
        safe_divide(F.col("sessions"), F.col("_total")).alias("share_of_all_sessions"),
        conv.alias("step_conversion_rate"),
        F.when(F.col("_prev") != 0, F.lit(1.0) - conv).alias("step_dropoff_rate"),
    ).orderBy("_ord").drop("_ord")


def worst_funnel_step(funnel: DataFrame) -> DataFrame:
    """The step (after the first) with the largest finite drop-off."""
    first = FUNNEL_STEPS[0][0]
    cand = funnel.where((F.col("step") != first) & F.col("step_dropoff_rate").isNotNull()
                        & ~F.isnan("step_dropoff_rate"))
    order = F.struct(F.col("step_dropoff_rate"), F.lit(0) - F.col("_i"))
    steps = F.create_map(*[x for i, (s, _) in enumerate(FUNNEL_STEPS) for x in (F.lit(s), F.lit(i))])
    cand = cand.withColumn("_i", steps[F.col("step")])
    return cand.agg(
        F.max_by("step", order).alias("step"),
        F.max("step_dropoff_rate").alias("step_dropoff_rate"),
    ).where(F.col("step").isNotNull())


# ---------------------------------------------------------------------------
# Behaviour segments
# ---------------------------------------------------------------------------
SEGMENT_KEYS = ["ux_intent_segment", "device_category", "source_medium"]


def behavior_segments(sessions: DataFrame) -> DataFrame:
    """Per (segment, device, source/medium): volumes, stage rates, revenue and
    a friction score. The exact per-group median comes from the rank histogram,
    so a segment holding most sessions is not buffered in one task."""
    users = F.count_distinct("user_pseudo_id") if "user_pseudo_id" in sessions.columns else F.count("session_key")
    g = sessions.groupBy(*SEGMENT_KEYS).agg(
        F.count("session_key").alias("sessions"),
        users.alias("users"),
        F.avg("event_count").alias("avg_events"),
        exact_avg("engagement_seconds_winsorized").alias("avg_engagement_seconds"),
        F.avg("reached_product_detail").alias("product_detail_rate"),
        F.avg("reached_cart").alias("cart_rate"),
        F.avg("reached_checkout").alias("checkout_rate"),
        F.avg("converted_purchase").alias("purchase_rate"),
        F.coalesce(exact_sum("purchase_revenue_usd"), F.lit(0.0)).alias("revenue_usd"),
        F.avg("checkout_without_purchase").alias("checkout_abandonment_rate"),
        F.avg("cart_without_checkout").alias("cart_without_checkout_rate"),
    )
    med = grouped_quantiles(sessions, "engagement_seconds", [0.5], SEGMENT_KEYS, prefix="_med")
    g = g.join(med, SEGMENT_KEYS, "left").withColumnRenamed("_med0", "median_engagement_seconds")
    g = g.withColumns({
        "revenue_per_session": safe_divide(F.col("revenue_usd"), F.col("sessions")),
        "friction_score": F.coalesce(F.col("cart_without_checkout_rate"), F.lit(0.0)) * 0.45
        + F.coalesce(F.col("checkout_abandonment_rate"), F.lit(0.0)) * 0.45
        + (F.lit(1.0) - F.coalesce(F.col("purchase_rate"), F.lit(0.0))) * 0.10,
    })
    cols = SEGMENT_KEYS + [
        "sessions", "users", "avg_events", "avg_engagement_seconds", "median_engagement_seconds",
        "product_detail_rate", "cart_rate", "checkout_rate", "purchase_rate", "revenue_usd",
        "checkout_abandonment_rate", "cart_without_checkout_rate", "revenue_per_session", "friction_score",
    ]
    return g.select(*cols).orderBy(F.desc("friction_score"), F.desc("sessions"))


def segment_rollup(segments: DataFrame) -> DataFrame:
    """Sessions summed and friction averaged (unweighted) per intent segment."""
    return segments.groupBy("ux_intent_segment").agg(
        F.sum("sessions").alias("sessions"), F.avg("friction_score").alias("friction_score")
    ).orderBy("sessions")


# ---------------------------------------------------------------------------
# Landing scorecard
# ---------------------------------------------------------------------------
def landing_scorecard(sessions: DataFrame) -> DataFrame:
    g = sessions.groupBy("landing_path").agg(
        F.count("session_key").alias("sessions"),
        F.avg("event_count").alias("avg_events_per_session"),
        F.avg("page_view_count").alias("avg_page_views_per_session"),
        exact_avg("engagement_seconds").alias("avg_engagement_seconds"),
        F.sum("reached_product_detail").alias("product_detail_sessions"),
        F.sum("reached_cart").alias("cart_sessions"),
        F.sum("reached_checkout").alias("checkout_sessions"),
        F.sum("converted_purchase").alias("purchase_sessions"),
        F.coalesce(exact_sum("purchase_revenue_usd"), F.lit(0.0)).alias("revenue_usd"),
    )
    g = g.withColumns({
        "product_detail_rate": safe_divide(F.col("product_detail_sessions"), F.col("sessions")),
        "cart_rate": safe_divide(F.col("cart_sessions"), F.col("sessions")),
        "purchase_rate": safe_divide(F.col("purchase_sessions"), F.col("sessions")),
        "revenue_per_session": safe_divide(F.col("revenue_usd"), F.col("sessions")),
    })
    return g.orderBy(F.desc("sessions"))


def landing_passthrough(landing: DataFrame) -> DataFrame:
    """A supplied landing table: measures coerced to numbers, path derived from
    ``landing_page`` when present; no re-sort, rates not recomputed."""
    exprs = {c: to_number(c) for c in LANDING_MEASURES if c in landing.columns}
    if "landing_page" in landing.columns:
        exprs["landing_path"] = landing_path("landing_page")
    return landing.withColumns(exprs)


# ---------------------------------------------------------------------------
# Product discovery and product scorecard
# ---------------------------------------------------------------------------
PRODUCT_KEYS = ["product_id", "brand", "category_code"]


def product_discovery(events: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """One row per (product, brand, category), from one scan of the events.

    Events are first reduced to one row per (product key, session), a hash aggregate that absorbs hot products map-side
    and spreads what is left of them over their sessions; those rows give the totals and, counted, the
    distinct sessions of each event type.
    """
    t = taxonomy
    etype = F.col("event_type")
    value = F.col("price").cast("double").try_cast(EXACT)
    per_session = events.groupBy(*PRODUCT_KEYS, "user_session").agg(
        F.count_if(etype == t.view).alias("product_views"), F.count_if(etype == t.cart).alias("add_to_cart_events"),
        F.count_if(etype == t.purchase).alias("purchase_events"), F.count_if(etype == (t.checkout or t.cart)).alias("_checkout_events"),
        F.sum(value).alias("_price"), F.count(value).alias("_priced"), F.sum(F.when(etype == t.purchase, value)).alias("_revenue"))
    known = F.col("user_session").isNotNull()
    p = per_session.groupBy(*PRODUCT_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("product_views", "add_to_cart_events", "purchase_events", "_checkout_events")],
        F.try_divide(F.sum("_price").cast("double"), F.sum("_priced").cast("double")).alias("avg_item_price_usd"),
        F.coalesce(F.sum("_revenue").cast("double"), F.lit(0.0)).alias("revenue_usd"),
        F.count_if(known & (F.col("product_views") > 0)).alias("viewing_sessions"),
        F.count_if(known & (F.col("add_to_cart_events") > 0)).alias("cart_sessions"),
        F.count_if(known & (F.col("purchase_events") > 0)).alias("purchase_sessions"),
    )
    parts = F.split(F.col("category_code"), "[.]")
    p = p.select(
        F.col("product_id").alias("item_id"),
        F.concat(F.lit("product_"), F.col("product_id")).alias("item_name"),
        F.col("brand").alias("item_brand"),
        F.col("category_code").alias("item_category"),
        F.coalesce(F.get(parts, 0), F.lit("unknown")).alias("item_category2"),
        F.coalesce(F.get(parts, 1), F.lit("unknown")).alias("item_category3"),
        F.lit(0).cast("bigint").alias("list_impressions"),
        "product_views",
        "add_to_cart_events",
        # without a checkout event type, checkout stands in for cart
        F.col("_checkout_events").alias("begin_checkout_events"),
        "purchase_events",
        "viewing_sessions",
        "cart_sessions",
        "purchase_sessions",
        "avg_item_price_usd",
        F.col("purchase_events").alias("units_purchased"),
        "revenue_usd",
        safe_divide(F.col("add_to_cart_events"), F.col("product_views")).alias("view_to_cart_rate"),
        safe_divide(F.col("purchase_events"), F.col("product_views")).alias("view_to_purchase_rate"),
    )
    return p.select(*PRODUCT_COLUMNS).orderBy(F.desc("product_views"))


def product_scorecard(product: DataFrame) -> DataFrame:
    """Coerce measures, clean names, friction gap against the best
    view-to-cart rate (a one-row global max attached as a scalar subquery)."""
    exprs = {c: to_number(c) for c in PRODUCT_MEASURES if c in product.columns}
    exprs.update({c: clean_category(c) for c in ["item_name", "item_category", "item_brand"] if c in product.columns})
    p = product.withColumns(exprs)
    rate = F.coalesce(F.col("view_to_cart_rate"), F.lit(0.0))
    best = p.select(F.max(rate)).scalar()
    return p.withColumn("friction_gap", best - rate)


# ---------------------------------------------------------------------------
# Daily overview
# ---------------------------------------------------------------------------
def daily_overview(events: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    t = taxonomy
    etype = F.col("event_type")
    d = events.groupBy(F.col("event_date").alias("event_dt")).agg(
        F.count("event_type").alias("total_events"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("user_session").alias("sessions"),
        F.count_if(etype == t.view).alias("page_views"),
        F.count_if(etype == t.cart).alias("add_to_cart_events"),
        F.count_if(etype == t.purchase).alias("purchase_events"),
        F.count_if(etype == (t.checkout or t.cart)).alias("begin_checkout_events"),
        F.coalesce(exact_sum(F.when(etype == t.purchase, F.col("price"))), F.lit(0.0)).alias("purchase_revenue_usd"),
    )
    d = d.withColumns({"product_views": F.col("page_views")})
    return d.select(*DAILY_COLUMNS).orderBy("event_dt")


# ---------------------------------------------------------------------------
# G15, G16, G18
# ---------------------------------------------------------------------------
def event_type_tally(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "event_type")


def headline_summary(sessions: DataFrame, model_performance: DataFrame | None = None) -> DataFrame:
    """Headline totals; with the model's performance row also its status and reason."""
    users = F.count_distinct("user_pseudo_id") if "user_pseudo_id" in sessions.columns else F.lit(None).cast("bigint")
    totals = sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        users.alias("users"),
        F.avg("converted_purchase").alias("purchase_rate"),
        F.coalesce(exact_sum("purchase_revenue_usd"), F.lit(0.0)).alias("revenue_usd"),
    )
    if model_performance is None:
        return totals
    status = model_performance.select("status", "reason").first()  # one row
    return totals.withColumns({"model_status": F.lit(status["status"]), "model_reason": F.lit(status["reason"]).cast("string")})


# ---------------------------------------------------------------------------
# Chart feeds
# ---------------------------------------------------------------------------
def device_funnel(sessions: DataFrame, min_sessions: int = 10) -> DataFrame:
    g = sessions.groupBy("device_category").agg(
        F.count("session_key").alias("sessions"),
        F.avg("reached_product_discovery").alias("product_discovery"),
        F.avg("reached_product_detail").alias("product_detail"),
        F.avg("reached_cart").alias("add_to_cart"),
        F.avg("reached_checkout").alias("checkout"),
        F.avg("converted_purchase").alias("purchase"),
    )
    return g.where(F.col("sessions") >= min_sessions).orderBy(F.desc("sessions"), "device_category")


def source_quality(sessions: DataFrame, min_sessions: int = 25, top: int = 15) -> DataFrame:
    g = sessions.groupBy("source_medium").agg(
        F.count("session_key").alias("sessions"),
        F.avg("converted_purchase").alias("purchase_rate"),
        F.avg("reached_cart").alias("cart_rate"),
        F.coalesce(exact_sum("purchase_revenue_usd"), F.lit(0.0)).alias("revenue_usd"),
    )
    g = g.where(F.col("sessions") >= min_sessions).orderBy(F.desc("sessions"), F.asc("source_medium")).limit(top)
    return g.orderBy("purchase_rate", "source_medium")


def _bubble(df: DataFrame, col: str, scale: float) -> DataFrame:
    size = F.greatest(F.coalesce(F.col(col), F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy()  # over the already limited rows (at most the top-k)
    return df.withColumn("bubble_size", F.lit(60.0) + size / F.greatest(F.max(size).over(w), F.lit(1.0)) * scale)


def landing_matrix(landing: DataFrame, min_sessions: int = 25, top: int = 30) -> DataFrame:
    if not {"sessions", "landing_path"} <= set(landing.columns):
        return landing.limit(0)  # nothing to place: the columns are not there
    top_rows = landing.where(F.coalesce(F.col("sessions"), F.lit(0)) >= min_sessions).orderBy(
        F.desc("sessions"), F.asc("landing_path")
    ).limit(top)
    return _bubble(top_rows, "revenue_usd", 500.0)


def product_friction_matrix(product: DataFrame, min_views: int = 10, top: int = 50) -> DataFrame:
    if not {"product_views", "item_id"} <= set(product.columns):
        return product.limit(0)
    top_rows = product.where(F.coalesce(F.col("product_views"), F.lit(0)) >= min_views).orderBy(
        F.desc("product_views"), F.asc("item_id")
    ).limit(top)
    return _bubble(top_rows, "revenue_usd", 520.0)
