"""Table layouts, the event taxonomy and header rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

# ---------------------------------------------------------------------------
# Column names and orders of the tables the reference reads and
# writes. They must stay equal for results to line up column by column.
# ---------------------------------------------------------------------------
SESSION_COLUMNS = [
    "session_key", "user_pseudo_id", "session_date", "session_start_ts", "session_end_ts",
    "session_duration_sec", "device_category", "operating_system", "country", "region",
    "traffic_source", "traffic_medium", "traffic_campaign", "landing_page", "landing_page_title",
    "event_count", "unique_event_count", "unique_products", "avg_item_price_usd", "page_view_count",
    "view_item_list_count", "view_item_count", "add_to_cart_count", "begin_checkout_count",
    "purchase_count", "scroll_count", "user_engagement_count", "engagement_time_msec",
    "purchase_revenue_usd", "total_item_quantity", "item_touch_count", "reached_session_start",
    "reached_product_discovery", "reached_product_detail", "reached_cart", "reached_checkout",
    "converted_purchase",
]

# measures that are coerced to numbers, null -> 0 and floored at 0 when cleaning
SESSION_MEASURES = [
    "session_duration_sec", "event_count", "unique_event_count", "page_view_count",
    "view_item_list_count", "view_item_count", "add_to_cart_count", "begin_checkout_count",
    "purchase_count", "scroll_count", "user_engagement_count", "engagement_time_msec",
    "purchase_revenue_usd", "total_item_quantity", "item_touch_count", "unique_products",
    "avg_item_price_usd", "reached_session_start", "reached_product_discovery",
    "reached_product_detail", "reached_cart", "reached_checkout", "converted_purchase",
]

SESSION_FLAGS = [
    "reached_session_start", "reached_product_discovery", "reached_product_detail",
    "reached_cart", "reached_checkout", "converted_purchase",
]

SESSION_CATEGORIES = [
    "device_category", "operating_system", "country", "region", "traffic_source",
    "traffic_medium", "traffic_campaign", "landing_page", "landing_page_title",
]

WINSORIZED = [
    "session_duration_sec", "event_count", "page_view_count", "engagement_time_msec",
    "purchase_revenue_usd",
]

PRODUCT_COLUMNS = [
    "item_id", "item_name", "item_brand", "item_category", "item_category2", "item_category3",
    "list_impressions", "product_views", "add_to_cart_events", "begin_checkout_events",
    "purchase_events", "viewing_sessions", "cart_sessions", "purchase_sessions",
    "avg_item_price_usd", "units_purchased", "revenue_usd", "view_to_cart_rate",
    "view_to_purchase_rate",
]

PRODUCT_MEASURES = [
    "list_impressions", "product_views", "add_to_cart_events", "begin_checkout_events",
    "purchase_events", "viewing_sessions", "cart_sessions", "purchase_sessions",
    "avg_item_price_usd", "units_purchased", "revenue_usd", "view_to_cart_rate",
    "view_to_purchase_rate",
]

DAILY_COLUMNS = [
    "event_dt", "total_events", "users", "sessions", "page_views", "product_views",
    "add_to_cart_events", "begin_checkout_events", "purchase_events", "purchase_revenue_usd",
]

LANDING_MEASURES = [
    "sessions", "avg_events_per_session", "avg_page_views_per_session", "avg_engagement_seconds",
    "product_detail_sessions", "cart_sessions", "checkout_sessions", "purchase_sessions",
    "revenue_usd", "product_detail_rate", "cart_rate", "purchase_rate", "revenue_per_session",
]

# The constant session attributes of an event log without
# device / traffic data, as the reference labels them.
SESSION_ATTRIBUTE_DEFAULTS = {
    "device_category": "unknown",
    "operating_system": "unknown",
    "country": "unknown",
    "region": "unknown",
    "traffic_source": "kaggle_electronics",
    "traffic_medium": "clickstream",
    "traffic_campaign": "electronics_events_history",
}

# The six funnel steps, in order, with the flag each one counts.
FUNNEL_STEPS = [
    ("Sessions", "session_key"),
    ("Product discovery", "reached_product_discovery"),
    ("Product detail", "reached_product_detail"),
    ("Add to cart", "reached_cart"),
    ("Begin checkout", "reached_checkout"),
    ("Purchase", "converted_purchase"),
]


@dataclass(frozen=True)
class Taxonomy:
    """Names of the event types that mark each funnel stage.

    ``checkout=None`` means the log has no checkout event; the cart stage then
    stands in for checkout (``reached_checkout = reached_cart``).
    """

    view: str = "view"
    cart: str = "cart"
    purchase: str = "purchase"
    checkout: str | None = None

    @property
    def event_types(self) -> list[str]:
        kinds = [self.view, self.cart, self.purchase]
        if self.checkout is not None:
            kinds.append(self.checkout)
        return kinds


DEFAULT_TAXONOMY = Taxonomy()
CHECKOUT_TAXONOMY = Taxonomy(checkout="checkout")

EVENT_SCHEMA = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("user_session", T.StringType()),
])


def normalize_header(name: str) -> str:
    """Header rule of the session reader: strip, lower-case, spaces to ``_``."""
    return str(name).strip().lower().replace(" ", "_")


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_header(c) for c in df.columns])
