"""Registered queries: ``name -> Query(build, sql, doubles)``.

``build(spark, sf_dir)`` returns the Spark DataFrame; ``sql`` is the DuckDB
twin over the raw driver tables (``None`` where only a rows check is
possible); ``doubles`` lists the floating-point columns rounded to
``oracle.DIGITS`` decimals on both sides.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickpath.context import checkpoint_dir
from clickpath.functions.columns import clean_category, landing_path, to_number
from clickpath.operators import scorecards as sc
from clickpath.operators.sessions import clean_sessions, dedup_keep_first, session_features
from clickpath.plans import oracle as O
from clickpath.plans.pipeline import pipeline
from clickpath.schema import (EVENT_SCHEMA, LANDING_MEASURES, PRODUCT_MEASURES, SESSION_CATEGORIES, SESSION_COLUMNS, SESSION_FLAGS,
                              SESSION_MEASURES, WINSORIZED)
from clickpath.sources.events import clean_events, clean_events_counted, read_event_log
from clickpath.sources.fixture import fixture_events
from clickpath.sources.tables import INGEST_ORDINAL, read_csv_table, read_table, write_bucketed, write_table


# temporal output columns are rendered as ISO text on both sides, so the value
# hash does not depend on how each engine hands dates / timestamps to pandas
DATE_FMT, TS_FMT = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSSSSS"
EVENT_TIMES = {"event_time": "ts", "event_date": "date"}
SESSION_TIMES = {"session_date": "date", "session_start_ts": "ts", "session_end_ts": "ts"}
DAY = {"event_dt": "date"}


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list[str] = field(default_factory=list)
    temporal: dict = field(default_factory=dict)

    def spark_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        exprs = {c: F.round(F.col(c), O.DIGITS) for c in self.doubles}
        exprs.update({c: F.date_format(c, DATE_FMT if kind == "date" else TS_FMT) for c, kind in self.temporal.items()})
        return df.withColumns(exprs) if exprs else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return O.as_text(O.rounded(self.sql, self.doubles), self.temporal)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, doubles: list[str] | None = None, temporal: dict | None = None):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql, list(doubles or []), dict(temporal or {}))
        return fn
    return deco


S = O.sessions_ctes()
S_CHECKOUT = O.sessions_ctes(checkout=True)
S_NODEVICE = O.sessions_ctes(device=False)
E = O.events_ctes()

SESSION_DOUBLES = ["session_duration_sec", "avg_item_price_usd", "engagement_time_msec", "purchase_revenue_usd"]
WINSOR_DOUBLES = [f"{c}_winsorized" for c in WINSORIZED]
ENGINEERED_DOUBLES = SESSION_DOUBLES + WINSOR_DOUBLES + ["engagement_seconds", "engagement_seconds_winsorized"]

# ---------------------------------------------------------------------------
# events and sessions
# ---------------------------------------------------------------------------
EVENT_COLS = ["event_id", "event_time", "event_type", "product_id", "category_code", "brand", "price", "user_id",
              "user_session", "event_date"]


@register("events_clean", O.with_ctes(E, f"SELECT {', '.join(EVENT_COLS)} FROM clean_events"), ["price"], EVENT_TIMES)
def q_events_clean(spark, sf):
    return pipeline(spark, sf).events.select(*EVENT_COLS)


@register("session_features", O.with_ctes(S, "SELECT * FROM session_features"), SESSION_DOUBLES, SESSION_TIMES)
def q_session_features(spark, sf):
    return pipeline(spark, sf).session_features


@register("session_features_checkout", O.with_ctes(S_CHECKOUT, "SELECT * FROM session_features"), SESSION_DOUBLES,
          SESSION_TIMES)
def q_session_features_checkout(spark, sf):
    return pipeline(spark, sf, "checkout").session_features


@register("session_features_given", O.with_ctes(O.sessions_ctes(given=True), "SELECT * FROM session_features"), SESSION_DOUBLES,
          SESSION_TIMES)
def q_session_features_given(spark, sf):
    """Sessions that the log names itself (user and day), from a log of text columns with four spellings of
    time and no event ids: its order is its place in the log."""
    return session_features(given_events(spark, sf), attributes=pipeline(spark, sf).user_attributes)


def given_log(spark, sf, event_time="event_time"):
    """The event log as such a file has it, with the event id (its order) as the place in the log."""
    raw = fixture_events(spark, sf)
    raw = raw.withColumn("event_time", raw[event_time] if isinstance(event_time, str) else event_time)
    text = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    spelled = (F.when(F.col("event_id") % 4 == 0, F.concat(text, F.lit(" UTC")))
               .when(F.col("event_id") % 4 == 1, F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))
               .when(F.col("event_id") % 4 == 2, F.concat(text, F.lit("+00:00"))).otherwise(text))
    return raw.select(
        F.col("event_id").alias(INGEST_ORDINAL), spelled.alias("event_time"), "event_type", F.col("product_id").cast("string").alias("product_id"),
        "category_code", "brand", F.col("price").cast("string").alias("price"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("event_time", "yyyyMMdd")).alias("user_session"))


def given_events(spark, sf):
    return clean_events(given_log(spark, sf))


# ---------------------------------------------------------------------------
# readers and sinks: files that Spark derives from the given tables, written once an application and folder
# ---------------------------------------------------------------------------
_DERIVED: dict[tuple, str] = {}


def derived(spark, sf, name, write):
    """Folder that ``write(path)`` has filled."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _DERIVED:
        place = hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:16]
        path = f"{checkpoint_dir(spark).rstrip('/')}/derived/{spark.sparkContext.applicationId}/{name}-{place}"
        write(path)
        _DERIVED[key] = path
    return _DERIVED[key]


def csv_log(spark, sf):
    """The event log as six CSV files in the order of its rows, times cut to the hour, so that most sessions begin with several
    events of one time and only the order of the log tells the first."""
    def write(path):
        log = given_log(spark, sf, F.date_trunc("hour", "event_time").cast("timestamp_ntz"))
        (log.repartitionByRange(6, INGEST_ORDINAL).sortWithinPartitions(INGEST_ORDINAL).select(*EVENT_SCHEMA.fieldNames())
         .write.option("header", True).option("nullValue", "NA").csv(path))
    return derived(spark, sf, "log", write)


HOURLY = "date_trunc('hour', e.ts)"
LOG_COLS = ["event_time", "event_type", "product_id", "category_code", "brand", "price", "user_id", "user_session", "event_date"]


@register("events_from_csv", O.with_ctes(O.events_ctes(given=True, time=HOURLY), f"SELECT {', '.join(LOG_COLS)} FROM clean_events"), ["price"],
          EVENT_TIMES)
def q_events_from_csv(spark, sf):
    """A log of several CSV files with missing-value tokens and four spellings of time."""
    return clean_events(read_event_log(spark, csv_log(spark, sf))).select(*LOG_COLS)


@register("session_features_from_csv", O.with_ctes(O.sessions_ctes(given=True, time=HOURLY), "SELECT * FROM session_features"), SESSION_DOUBLES,
          SESSION_TIMES)
def q_session_features_from_csv(spark, sf):
    """G1 by the order of the log: first user and title of sessions whose first events have one time."""
    return session_features(clean_events(read_event_log(spark, csv_log(spark, sf))), attributes=pipeline(spark, sf).user_attributes)


def csv_sessions(spark, sf):
    """The session table as CSV files with headers in capitals and blanks and ``NA`` for missing values; each session
    is repeated, with other counts, in a second set of files."""
    def write(path):
        rows = pipeline(spark, sf).session_features.select(*[F.col(c).cast("string").alias(c.replace("_", " ").upper()) for c in SESSION_COLUMNS])
        out = lambda df, name: df.write.option("header", True).option("nullValue", "NA").csv(f"{path}/{name}")
        files = max(4, spark.sparkContext.defaultParallelism)
        out(rows.repartition(files, "SESSION KEY"), "a")
        out(rows.withColumn("EVENT COUNT", F.lit("99")).repartition(files - 1, "SESSION KEY"), "b")
    return derived(spark, sf, "sessions", write)


_READ_INTS = [c for c in SESSION_MEASURES if c not in SESSION_DOUBLES]
_READ_COLS = ["session_key", "user_pseudo_id", "session_date", *SESSION_MEASURES, *[c for c in SESSION_FLAGS if c not in SESSION_MEASURES],
              *SESSION_CATEGORIES, *WINSOR_DOUBLES]


@register("sessions_from_csv", O.with_ctes(S, f"SELECT {', '.join(_READ_COLS)} FROM sessions_clean"), SESSION_DOUBLES + WINSOR_DOUBLES,
          {"session_date": "date"})
def q_sessions_from_csv(spark, sf):
    """Session files read as text; of repeated sessions the first in the files is kept."""
    clean = clean_sessions(read_csv_table(spark, f"{csv_sessions(spark, sf)}/*"))
    return clean.withColumns({c: F.col(c).cast("bigint") for c in _READ_INTS}).select(*_READ_COLS)


@register("sink_round_trip", O.with_ctes(S, "SELECT * FROM session_features"), SESSION_DOUBLES, SESSION_TIMES)
def q_sink_round_trip(spark, sf):
    """The session table written by date, its last day written again twice, first with other counts."""
    def write(path):
        rows = pipeline(spark, sf).session_features
        write_table(rows, path, partition_by=["session_date"])
        last = rows.where(F.col("session_date") == rows.agg(F.max("session_date")).first()[0])
        for again in (last.withColumn("event_count", F.col("event_count") + 100), last):
            write_table(again, path, partition_by=["session_date"], only_partitions=True)
    return spark.read.parquet(derived(spark, sf, "sink", write)).select(*SESSION_COLUMNS)


@register("bucketed_join", O.with_ctes(S, "SELECT session_key, event_count, ux_intent_segment, journey_depth FROM sessions"))
def q_bucketed_join(spark, sf):
    """Two session tables bucketed by their key and joined without a shuffle."""
    p = pipeline(spark, sf)
    place = hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:16]

    def write(path):
        write_bucketed(p.session_features.select("session_key", "event_count"), f"features_{place}", f"{path}/features", "session_key", 8)
        write_bucketed(p.sessions.select("session_key", "ux_intent_segment", "journey_depth"), f"engineered_{place}", f"{path}/engineered",
                       "session_key", 8)
    derived(spark, sf, "bucketed", write)
    return spark.table(f"features_{place}").join(spark.table(f"engineered_{place}"), "session_key")


_RULES_SQL = f"""
SELECT CASE WHEN event_time IS NULL THEN 'missing_event_time' WHEN event_type IS NULL THEN 'missing_event_type'
  WHEN user_id IS NULL THEN 'missing_user_id' WHEN k IS NULL THEN 'missing_product_id'
  WHEN event_type NOT IN ('view', 'cart', 'purchase') THEN 'other_event_type' WHEN price < 0 THEN 'negative_price' ELSE 'kept' END AS rule
FROM raw_events"""


@register("cleaning_account", O.with_ctes(E, f"""
SELECT r.rule, count(x.rule) AS events, count(x.rule) AS rows FROM (VALUES ('missing_event_time'), ('missing_event_type'), ('missing_user_id'),
  ('missing_product_id'), ('other_event_type'), ('negative_price'), ('kept')) r(rule) LEFT JOIN ({_RULES_SQL}) x USING (rule) GROUP BY r.rule"""))
def q_cleaning_account(spark, sf):
    """Rows that each rule of the cleaning step rejects, counted while the log is written (``events``) and again from the
    tables of kept and rejected rows (``rows``)."""
    def write(path):
        ev = read_table(spark, sf, "events")
        log = ev.select("event_id", F.col("ts").alias("event_time"), F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type"))
                        .alias("event_type"), F.get_json_object("props", "$.k").try_cast("bigint").alias("product_id"), F.col("value").alias("price"), "user_id")
        *_, found = clean_events_counted(log, f"{path}/events", required=["event_time", "event_type", "user_id", "product_id"])
        spark.createDataFrame(list(found.items()), "rule string, events long").write.parquet(f"{path}/counts")
    path = derived(spark, sf, "cleaning", write)
    rows = spark.read.parquet(f"{path}/events").groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))
    return (spark.read.parquet(f"{path}/counts").join(rows, "rule", "left")
            .select("rule", "events", F.coalesce("rows", F.lit(0)).alias("rows")))


@register("sessions_dedup",
          O.with_ctes(S, "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_pseudo_id "
                         "ORDER BY session_start_ts, session_key) AS rn FROM session_features) WHERE rn = 1"),
          SESSION_DOUBLES, SESSION_TIMES)
def q_sessions_dedup(spark, sf):
    """Keep-first per key on a key with real duplicates: each user's first session."""
    return dedup_keep_first(pipeline(spark, sf).session_features, "user_pseudo_id", ["session_start_ts", "session_key"])


@register("sessions_clean", O.with_ctes(S, "SELECT * FROM sessions_clean"), SESSION_DOUBLES + WINSOR_DOUBLES,
          SESSION_TIMES)
def q_sessions_clean(spark, sf):
    return pipeline(spark, sf).sessions_clean


_IQR_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS measure, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, "
    f"quantile_cont({c}, 0.75) AS q3 FROM sessions_typed"
    for c in WINSORIZED
)


@register("iqr_bounds",
          O.with_ctes(S, f"SELECT measure, q1, median, q3, q3 - q1 AS iqr, GREATEST(q1 - 1.5 * (q3 - q1), 0.0) AS lower_fence, "
                         f"q3 + 1.5 * (q3 - q1) AS upper_fence, CAST(q3 - q1 <> 0 AS INTEGER) AS clipped FROM ({_IQR_SQL})"),
          ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"])
def q_iqr_bounds(spark, sf):
    """Quartiles and clip fences of the five winsorized measures, as the winsorizing step computes them."""
    bounds = pipeline(spark, sf).bounds
    rows = [(c, b["q1"], b["median"], b["q3"], b["q3"] - b["q1"], b["lower"], b["upper"], int(b["clip"]))
            for c, b in bounds.items() if not b["empty"]]
    return spark.createDataFrame(rows, "measure string, q1 double, median double, q3 double, iqr double, "
                                       "lower_fence double, upper_fence double, clipped int")


@register("sessions_winsorized",
          O.with_ctes(S, "SELECT session_key, " + ", ".join(WINSOR_DOUBLES) + " FROM sessions_clean"), WINSOR_DOUBLES)
def q_sessions_winsorized(spark, sf):
    return pipeline(spark, sf).sessions_clean.select("session_key", *WINSOR_DOUBLES)


@register("session_features_engineered", O.with_ctes(S, "SELECT * FROM sessions"), ENGINEERED_DOUBLES, SESSION_TIMES)
def q_sessions_engineered(spark, sf):
    return pipeline(spark, sf).sessions


@register("landing_path", f"SELECT page_id, url, {O.landing_path_sql('url')} AS landing_path FROM pages")
def q_landing_path(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", "url", landing_path("url").alias("landing_path"))


@register("category_clean",
          f"SELECT p_partkey, {O.clean_category_sql('p_name')} AS name_clean, {O.clean_category_sql('p_type')} AS type_clean, "
          f"{O.clean_category_sql('p_brand')} AS brand_clean FROM part")
def q_category_clean(spark, sf):
    return read_table(spark, sf, "part").select(
        "p_partkey", clean_category("p_name").alias("name_clean"), clean_category("p_type").alias("type_clean"),
        clean_category("p_brand").alias("brand_clean"),
    )


_NUM_RE = "^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def _num_sql(x: str) -> str:
    s = f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    return f"(CASE WHEN regexp_matches({s}, '{_NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END)"


@register("coerce_numeric",
          "SELECT event_id, " + _num_sql("json_extract_string(props, '$.k')") + " AS k_number, "
          f"{_num_sql('props')} AS props_number, {_num_sql('event_type')} AS type_number FROM events",
          ["k_number", "props_number", "type_number"])
def q_coerce_numeric(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select(
        "event_id", to_number(F.get_json_object("props", "$.k")).alias("k_number"),
        to_number("props").alias("props_number"), to_number("event_type").alias("type_number"),
    )


@register("limit_cardinality",
          O.with_ctes(S, "SELECT landing_category_grouped, count(*) AS sessions FROM sessions GROUP BY 1"))
def q_limit_cardinality(spark, sf):
    return pipeline(spark, sf).sessions.groupBy("landing_category_grouped").agg(F.count(F.lit(1)).alias("sessions"))


@register("intent_segments", O.with_ctes(S, "SELECT ux_intent_segment, count(*) AS sessions FROM sessions GROUP BY 1"))
def q_intent_segments(spark, sf):
    return pipeline(spark, sf).sessions.groupBy("ux_intent_segment").agg(F.count(F.lit(1)).alias("sessions"))


@register("intent_segments_checkout",
          O.with_ctes(S_CHECKOUT, "SELECT ux_intent_segment, count(*) AS sessions, CAST(sum(cart_without_checkout) AS BIGINT) "
                                  "AS cart_without_checkout FROM sessions GROUP BY 1"))
def q_intent_segments_checkout(spark, sf):
    return pipeline(spark, sf, "checkout").sessions.groupBy("ux_intent_segment").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("cart_without_checkout").cast("bigint").alias("cart_without_checkout"))


@register("session_calendar",
          O.with_ctes(S, "SELECT session_weekday, session_month, is_weekend, count(*) AS sessions, "
                         "CAST(sum(high_engagement_no_purchase) AS BIGINT) AS high_engagement_no_purchase, "
                         "CAST(sum(bounce_like_session) AS BIGINT) AS bounce_like_sessions FROM sessions GROUP BY 1, 2, 3"))
def q_session_calendar(spark, sf):
    return pipeline(spark, sf).sessions.groupBy("session_weekday", "session_month", "is_weekend").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("high_engagement_no_purchase").cast("bigint").alias("high_engagement_no_purchase"),
        F.sum("bounce_like_session").cast("bigint").alias("bounce_like_sessions"),
    )


# ---------------------------------------------------------------------------
# funnel and scorecards
# ---------------------------------------------------------------------------
_FUNNEL_ROWS = [
    (0, "Sessions", "total", "total"),
    (1, "Product discovery", "s1", "total"),
    (2, "Product detail", "s2", "s1"),
    (3, "Add to cart", "s3", "s2"),
    (4, "Begin checkout", "s4", "s3"),
    (5, "Purchase", "s5", "s4"),
]
FUNNEL_SQL = (
    "WITH " + S.strip() + ",\ntotals AS (SELECT count(*) AS total, "
    "CAST(COALESCE(sum(reached_product_discovery), 0) AS BIGINT) AS s1, CAST(COALESCE(sum(reached_product_detail), 0) AS BIGINT) AS s2, "
    "CAST(COALESCE(sum(reached_cart), 0) AS BIGINT) AS s3, CAST(COALESCE(sum(reached_checkout), 0) AS BIGINT) AS s4, "
    "CAST(COALESCE(sum(converted_purchase), 0) AS BIGINT) AS s5 FROM sessions),\n"
    "steps AS (" + " UNION ALL ".join(
        f"SELECT {o} AS ord, '{label}' AS step, {cur} AS sessions, {prev} AS prev, total FROM totals"
        for o, label, cur, prev in _FUNNEL_ROWS) + ")\n"
    f"SELECT step, sessions, {O.div('sessions', 'total')} AS share_of_all_sessions, "
    f"{O.div('sessions', 'prev')} AS step_conversion_rate, "
    f"CASE WHEN prev <> 0 THEN 1.0 - {O.div('sessions', 'prev')} END AS step_dropoff_rate FROM steps"
)
FUNNEL_DOUBLES = ["share_of_all_sessions", "step_conversion_rate", "step_dropoff_rate"]


@register("overall_funnel", FUNNEL_SQL, FUNNEL_DOUBLES)
def q_overall_funnel(spark, sf):
    return pipeline(spark, sf).funnel


@register("overall_funnel_checkout", FUNNEL_SQL.replace(S.strip(), S_CHECKOUT.strip()), FUNNEL_DOUBLES)
def q_overall_funnel_checkout(spark, sf):
    return pipeline(spark, sf, "checkout").funnel


_STEP_ORDER = "CASE step " + " ".join(f"WHEN '{label}' THEN {o}" for o, label, _, _ in _FUNNEL_ROWS) + " END"


@register("worst_funnel_step",
          f"SELECT step, step_dropoff_rate FROM ({FUNNEL_SQL}) WHERE step <> 'Sessions' AND step_dropoff_rate IS NOT NULL "
          f"AND NOT isnan(step_dropoff_rate) ORDER BY step_dropoff_rate DESC, {_STEP_ORDER} ASC LIMIT 1",
          ["step_dropoff_rate"])
def q_worst_funnel_step(spark, sf):
    return sc.worst_funnel_step(pipeline(spark, sf).funnel)


SEG_DOUBLES = ["avg_events", "avg_engagement_seconds", "median_engagement_seconds", "product_detail_rate", "cart_rate",
               "checkout_rate", "purchase_rate", "revenue_usd", "checkout_abandonment_rate",
               "cart_without_checkout_rate", "revenue_per_session", "friction_score"]
SEG_SQL = O.with_ctes(S, f"""
SELECT *, {O.div('revenue_usd', 'sessions')} AS revenue_per_session,
  COALESCE(cart_without_checkout_rate, 0.0) * 0.45 + COALESCE(checkout_abandonment_rate, 0.0) * 0.45
  + (1.0 - COALESCE(purchase_rate, 0.0)) * 0.10 AS friction_score
FROM (
  SELECT ux_intent_segment, device_category, source_medium, count(session_key) AS sessions,
    count(DISTINCT user_pseudo_id) AS users, avg(event_count) AS avg_events,
    {O.eavg('engagement_seconds_winsorized')} AS avg_engagement_seconds,
    quantile_cont(engagement_seconds, 0.5) AS median_engagement_seconds,
    avg(reached_product_detail) AS product_detail_rate, avg(reached_cart) AS cart_rate,
    avg(reached_checkout) AS checkout_rate, avg(converted_purchase) AS purchase_rate,
    COALESCE({O.esum('purchase_revenue_usd')}, 0.0) AS revenue_usd,
    avg(checkout_without_purchase) AS checkout_abandonment_rate,
    avg(cart_without_checkout) AS cart_without_checkout_rate
  FROM sessions GROUP BY 1, 2, 3)""")


@register("behavior_segments", SEG_SQL, SEG_DOUBLES)
def q_behavior_segments(spark, sf):
    return pipeline(spark, sf).segments


@register("segment_rollup",
          f"SELECT ux_intent_segment, CAST(sum(sessions) AS BIGINT) AS sessions, avg(friction_score) AS friction_score "
          f"FROM ({SEG_SQL}) GROUP BY 1", ["friction_score"])
def q_segment_rollup(spark, sf):
    return sc.segment_rollup(pipeline(spark, sf).segments)


LANDING_DOUBLES = ["avg_events_per_session", "avg_page_views_per_session", "avg_engagement_seconds", "revenue_usd",
                   "product_detail_rate", "cart_rate", "purchase_rate", "revenue_per_session"]
LANDING_SQL = O.with_ctes(S, f"""
SELECT *, {O.div('product_detail_sessions', 'sessions')} AS product_detail_rate,
  {O.div('cart_sessions', 'sessions')} AS cart_rate, {O.div('purchase_sessions', 'sessions')} AS purchase_rate,
  {O.div('revenue_usd', 'sessions')} AS revenue_per_session
FROM (
  SELECT landing_path, count(session_key) AS sessions, avg(event_count) AS avg_events_per_session,
    avg(page_view_count) AS avg_page_views_per_session, {O.eavg('engagement_seconds')} AS avg_engagement_seconds,
    CAST(sum(reached_product_detail) AS BIGINT) AS product_detail_sessions, CAST(sum(reached_cart) AS BIGINT) AS cart_sessions,
    CAST(sum(reached_checkout) AS BIGINT) AS checkout_sessions, CAST(sum(converted_purchase) AS BIGINT) AS purchase_sessions,
    COALESCE({O.esum('purchase_revenue_usd')}, 0.0) AS revenue_usd
  FROM sessions GROUP BY 1)""")


@register("landing_scorecard", LANDING_SQL, LANDING_DOUBLES)
def q_landing_scorecard(spark, sf):
    return pipeline(spark, sf).landing


_PASS_COLS = ", ".join(f"{_num_sql(c)} AS {c}" for c in LANDING_MEASURES)


@register("landing_scorecard_passthrough",
          f"SELECT landing_page, {_PASS_COLS}, {O.landing_path_sql('landing_page')} AS landing_path FROM "
          f"(SELECT 'https://shop.example' || landing_path || '?ref=feed' AS landing_page, "
          + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in LANDING_MEASURES)
          + f" FROM ({LANDING_SQL}))",
          [c for c in LANDING_MEASURES])
def q_landing_passthrough(spark, sf):
    """A supplied landing table (text columns, full URLs) coerced back to numbers."""
    supplied = pipeline(spark, sf).landing.select(
        F.concat(F.lit("https://shop.example"), F.col("landing_path"), F.lit("?ref=feed")).alias("landing_page"),
        *[F.col(c).cast("string").alias(c) for c in LANDING_MEASURES],
    )
    return sc.landing_passthrough(supplied)


PRODUCT_DOUBLES = ["avg_item_price_usd", "revenue_usd", "view_to_cart_rate", "view_to_purchase_rate"]
def product_sql(checkout: bool = False) -> str:
    """Product discovery twin; with ``checkout`` the signup events count as checkout."""
    begin = "checkout_events" if checkout else "add_to_cart_events"
    return "WITH " + O.events_ctes(checkout).strip() + f""",
base AS (
  SELECT product_id, brand, category_code,
    count(*) FILTER (WHERE event_type = 'view') AS product_views,
    count(*) FILTER (WHERE event_type = 'cart') AS add_to_cart_events,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchase_events,
    count(*) FILTER (WHERE event_type = 'checkout') AS checkout_events,
    {O.eavg('price')} AS avg_item_price_usd,
    COALESCE({O.esum('price', "event_type = 'purchase'")}, 0.0) AS revenue_usd,
    count(DISTINCT user_session) FILTER (WHERE event_type = 'view') AS viewing_sessions,
    count(DISTINCT user_session) FILTER (WHERE event_type = 'cart') AS cart_sessions,
    count(DISTINCT user_session) FILTER (WHERE event_type = 'purchase') AS purchase_sessions
  FROM clean_events GROUP BY 1, 2, 3)
SELECT product_id AS item_id, 'product_' || product_id AS item_name, brand AS item_brand, category_code AS item_category,
  COALESCE(split_part(category_code, '.', 1), 'unknown') AS item_category2,
  COALESCE(CASE WHEN strpos(category_code, '.') > 0 THEN split_part(category_code, '.', 2) END, 'unknown') AS item_category3,
  CAST(0 AS BIGINT) AS list_impressions, product_views, add_to_cart_events, {begin} AS begin_checkout_events,
  purchase_events, viewing_sessions, cart_sessions, purchase_sessions, avg_item_price_usd,
  purchase_events AS units_purchased, revenue_usd,
  {O.div('add_to_cart_events', 'product_views')} AS view_to_cart_rate,
  {O.div('purchase_events', 'product_views')} AS view_to_purchase_rate
FROM base"""


PRODUCT_SQL = product_sql()


@register("product_discovery", PRODUCT_SQL, PRODUCT_DOUBLES)
def q_product_discovery(spark, sf):
    return pipeline(spark, sf).product


_PSC_NUM = PRODUCT_MEASURES
PRODUCT_SCORE_SQL = (
    f"SELECT item_id, {O.clean_category_sql('item_name')} AS item_name, {O.clean_category_sql('item_brand')} AS item_brand, "
    f"{O.clean_category_sql('item_category')} AS item_category, item_category2, item_category3, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _PSC_NUM)
    + ", (SELECT max(COALESCE(view_to_cart_rate, 0.0)) FROM p0) - COALESCE(view_to_cart_rate, 0.0) AS friction_gap FROM p0"
)


@register("product_scorecard",
          "WITH p0 AS (" + PRODUCT_SQL + ") " + PRODUCT_SCORE_SQL,
          _PSC_NUM + ["friction_gap"])
def q_product_scorecard(spark, sf):
    return sc.product_scorecard(pipeline(spark, sf).product)


def daily_sql(checkout: bool = False) -> str:
    """Daily overview twin; with ``checkout`` the signup events count as checkout."""
    begin = "checkout" if checkout else "cart"
    return "WITH " + O.events_ctes(checkout).strip() + f"""
SELECT event_date AS event_dt, count(event_type) AS total_events, count(DISTINCT user_id) AS users,
  count(DISTINCT user_session) AS sessions, count(*) FILTER (WHERE event_type = 'view') AS page_views,
  count(*) FILTER (WHERE event_type = 'view') AS product_views,
  count(*) FILTER (WHERE event_type = 'cart') AS add_to_cart_events,
  count(*) FILTER (WHERE event_type = '{begin}') AS begin_checkout_events,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase_events,
  COALESCE({O.esum('price', "event_type = 'purchase'")}, 0.0) AS purchase_revenue_usd
FROM clean_events GROUP BY 1"""


@register("daily_overview", daily_sql(), ["purchase_revenue_usd"], DAY)
def q_daily_overview(spark, sf):
    return sc.daily_overview(pipeline(spark, sf).events)


@register("event_type_tally", O.with_ctes(E, "SELECT event_type, count(*) AS events FROM clean_events GROUP BY 1"))
def q_event_type_tally(spark, sf):
    return sc.event_type_tally(pipeline(spark, sf).events)


@register("headline_summary",
          O.with_ctes(S, "SELECT count(*) AS sessions, count(DISTINCT user_pseudo_id) AS users, "
                         "avg(converted_purchase) AS purchase_rate, COALESCE(" + O.esum('purchase_revenue_usd') + ", 0.0) AS revenue_usd "
                         "FROM sessions"), ["purchase_rate", "revenue_usd"])
def q_headline_summary(spark, sf):
    return sc.headline_summary(pipeline(spark, sf).sessions)


@register("device_funnel",
          O.with_ctes(S, "SELECT device_category, count(session_key) AS sessions, avg(reached_product_discovery) AS product_discovery, "
                         "avg(reached_product_detail) AS product_detail, avg(reached_cart) AS add_to_cart, "
                         "avg(reached_checkout) AS checkout, avg(converted_purchase) AS purchase FROM sessions GROUP BY 1 "
                         "HAVING count(session_key) >= 10"),
          ["product_discovery", "product_detail", "add_to_cart", "checkout", "purchase"])
def q_device_funnel(spark, sf):
    return sc.device_funnel(pipeline(spark, sf).sessions)


@register("source_quality",
          O.with_ctes(S, "SELECT * FROM (SELECT source_medium, count(session_key) AS sessions, avg(converted_purchase) AS purchase_rate, "
                         "avg(reached_cart) AS cart_rate, COALESCE(" + O.esum('purchase_revenue_usd') + ", 0.0) AS revenue_usd "
                         "FROM sessions GROUP BY 1 HAVING count(session_key) >= 25) ORDER BY sessions DESC, source_medium ASC LIMIT 15"),
          ["purchase_rate", "cart_rate", "revenue_usd"])
def q_source_quality(spark, sf):
    return sc.source_quality(pipeline(spark, sf).sessions)


@register("landing_matrix",
          f"SELECT *, 60.0 + GREATEST(COALESCE(revenue_usd, 0.0), 0.0) / GREATEST(max(GREATEST(COALESCE(revenue_usd, 0.0), 0.0)) OVER (), 1.0) * 500.0 "
          f"AS bubble_size FROM (SELECT * FROM ({LANDING_SQL}) WHERE COALESCE(sessions, 0) >= 25 "
          f"ORDER BY sessions DESC, landing_path ASC LIMIT 30)",
          LANDING_DOUBLES + ["bubble_size"])
def q_landing_matrix(spark, sf):
    return sc.landing_matrix(pipeline(spark, sf).landing)


@register("product_friction_matrix",
          f"SELECT *, 60.0 + GREATEST(COALESCE(revenue_usd, 0.0), 0.0) / GREATEST(max(GREATEST(COALESCE(revenue_usd, 0.0), 0.0)) OVER (), 1.0) * 520.0 "
          f"AS bubble_size FROM (SELECT * FROM ({PRODUCT_SQL}) WHERE COALESCE(product_views, 0) >= 10 "
          f"ORDER BY product_views DESC, item_id ASC LIMIT 50)",
          PRODUCT_DOUBLES + ["bubble_size"])
def q_product_friction_matrix(spark, sf):
    return sc.product_friction_matrix(pipeline(spark, sf).product)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.spark_df for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle() for name, q in REGISTRY.items() if q.sql is not None}


# ---------------------------------------------------------------------------
# hypothesis tests (statistic, dof, effect size, n, medians; p-values are
# excluded from the value hash and checked in tests/)
# ---------------------------------------------------------------------------
from clickpath.operators import stats as ST  # noqa: E402

TEST_KEYS = [
    "chi2_device_purchase", "chi2_medium_purchase", "chi2_landing_purchase", "chi2_landing_cart",
    "chi2_device_cart", "chi2_device_checkout_purchase",
    "mwu_engagement_purchase", "mwu_duration_purchase", "mwu_events_cart", "mwu_price_purchase",
    "kw_device_depth", "kw_medium_depth", "kw_landing_depth", "kw_landing_engagement",
    "spearman_events_depth", "spearman_products_depth",
]
TEST_DOUBLES = ["statistic", "degrees_of_freedom", "effect_size", "group_0_median", "group_1_median"]
_TEST_OUT = [c.strip() for c in O.TEST_COLUMNS.split(",")]


def _register_test(key: str, index: int) -> None:
    kind, a, b, where, _ = ST.SUITE[index]
    sql = "WITH " + S.strip() + ",\n" + O.TEST_SQL[kind](a, b, where).strip()

    def build(spark, sf, _i=index):
        return ST.run_test(pipeline(spark, sf).sessions, _i).select(*_TEST_OUT)

    REGISTRY[key] = Query(build, sql, TEST_DOUBLES)


for _i, _key in enumerate(TEST_KEYS):
    _register_test(_key, _i)


@register("chi2_weekend_purchase", "WITH " + S.strip() + ",\n" + O.chi2_sql("is_weekend", "converted_purchase").strip(),
          TEST_DOUBLES)
def q_chi2_weekend(spark, sf):
    """2x2 table: exercises the Yates-corrected branch."""
    return ST.chi_square(pipeline(spark, sf).sessions, "is_weekend", "converted_purchase",
                         "Purchase conversion differs on weekends.").select(*_TEST_OUT)


@register("chi2_device_purchase_nodevice",
          "WITH " + S_NODEVICE.strip() + ",\n" + O.chi2_sql("device_category", "converted_purchase").strip(), TEST_DOUBLES)
def q_chi2_nodevice(spark, sf):
    """Device unknown everywhere: the skip contract (one category level)."""
    return ST.run_test(pipeline(spark, sf, "nodevice").sessions, 0).select(*_TEST_OUT)


def _suite_sql() -> str:
    """The twins of the 16 tests as one table, in suite order."""
    parts = []
    for i, (kind, a, b, where, text) in enumerate(ST.SUITE):
        reason, effect = ST.TWIN_LABELS[kind]
        parts.append(f"SELECT {i} AS test_order, '{text}' AS hypothesis, CASE WHEN status = 'skipped' THEN '{reason}' END AS reason, "
                     f"CASE WHEN status = 'completed' THEN '{effect}' END AS effect_size_name, * "
                     f"FROM (WITH {O.TEST_SQL[kind](a, b, where).strip()})")
    return "WITH " + S.strip() + "\n" + "\nUNION ALL ".join(parts)


@register("statistical_tests", _suite_sql(), TEST_DOUBLES)
def q_statistical_tests(spark, sf):
    """The full 16-test suite; p-values (checked in tests/) are left out of the comparison."""
    return ST.hypothesis_suite(pipeline(spark, sf).sessions).drop("p_value")


@register("significant_tests", None)
def q_significant_tests(spark, sf):
    return ST.significant_count(ST.hypothesis_suite(pipeline(spark, sf).sessions))


@register("test_table_feed", None)
def q_test_table_feed(spark, sf):
    return ST.test_table_feed(ST.hypothesis_suite(pipeline(spark, sf).sessions))


_NORMALITY_SQL = "WITH " + S.strip() + ",\nmelted AS (" + " UNION ALL ".join(
    f"SELECT {i} AS t, '{m}' AS metric, CAST({g} AS VARCHAR) AS g, '{label}' AS label, CAST({m} AS DOUBLE) AS v FROM sessions "
    f"WHERE {m} IS NOT NULL AND {g} IS NOT NULL" for i, (m, g, label) in enumerate(ST.NORMALITY_SUITE)) + f"""),
ranked AS (SELECT *, (rank() OVER (PARTITION BY t, g ORDER BY v) + (count(*) OVER (PARTITION BY t, g, v) - 1) / 2.0 - 0.375)
                     / (count(*) OVER (PARTITION BY t, g) + 0.25) AS p FROM melted),
scored AS (SELECT *, {ST.normal_quantile_sql('p')} AS z FROM ranked),
sums AS (SELECT t, metric, g, label, count(*) AS n, power(corr(v, z), 2) AS w, avg(v) AS mean, var_pop(v) AS var FROM scored GROUP BY 1, 2, 3, 4),
moments AS (SELECT s.t, s.g, avg(power(x.v - s.mean, 3)) AS m3, avg(power(x.v - s.mean, 4)) AS m4
            FROM scored x JOIN sums s ON x.t = s.t AND x.g = s.g GROUP BY 1, 2)
SELECT metric, g AS "group", CASE WHEN n >= 3 AND var > 0 THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN n < 3 THEN 'Fewer than 3 observations.' WHEN var <= 0 THEN 'All values are identical.' ELSE '' END AS reason, n,
  CASE WHEN n >= 3 AND var > 0 THEN w END AS statistic, CASE WHEN n >= 3 AND var > 0 THEN m3 / power(var, 1.5) END AS skewness,
  CASE WHEN n >= 3 AND var > 0 THEN m4 / (var * var) - 3 END AS kurtosis, label
FROM sums JOIN moments USING (t, g)"""


@register("normality_checks", _NORMALITY_SQL, ["statistic", "skewness", "kurtosis"])
def q_normality_checks(spark, sf):
    """Shapiro-Francia statistic and moments per (metric, group) on all rows; p-values are checked in tests/."""
    return ST.normality_suite(pipeline(spark, sf).sessions).drop("p_value", "interpretation")


_NORM_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({g} AS VARCHAR) AS \"group\", count(*) AS n "
    f"FROM sessions WHERE {m} IS NOT NULL AND {g} IS NOT NULL GROUP BY {g}"
    for m, g, _ in ST.NORMALITY_SUITE
)


@register("normality_sample_sizes", "WITH " + S.strip() + "\n" + _NORM_SQL)
def q_normality_sample_sizes(spark, sf):
    """Rows behind each statistic of the normality suite: all of the group."""
    return ST.normality_suite(pipeline(spark, sf).sessions).select("metric", "group", "n")


# ---------------------------------------------------------------------------
# propensity model
# ---------------------------------------------------------------------------
from clickpath.operators import model as M  # noqa: E402


def _top_sql(c: str, n: int = 25) -> str:
    cc = O.clean_category_sql(c)
    return (f"CASE WHEN {cc} IN (SELECT lvl FROM (SELECT {cc} AS lvl, count(*) AS k FROM sessions GROUP BY 1) "
            f"ORDER BY k DESC, lvl ASC LIMIT {n}) THEN {cc} ELSE 'other' END AS {c}")


@register("model_frame",
          "WITH " + S.strip() + "\nSELECT session_key, " + ", ".join(_top_sql(c) for c in M.CATEGORICAL_FEATURES)
          + " FROM sessions")
def q_model_frame(spark, sf):
    """M2: categorical model features limited to their 25 most frequent levels."""
    return M.model_frame(pipeline(spark, sf).sessions).select("session_key", *M.CATEGORICAL_FEATURES)


@register("train_test_split", "WITH " + S.strip() + f""",
ranked AS (
  SELECT session_key, converted_purchase, count(*) OVER (PARTITION BY converted_purchase) AS n,
    row_number() OVER (PARTITION BY converted_purchase ORDER BY substr(md5('{M.SEED}:' || session_key), 1, 13)) AS r
  FROM sessions)
SELECT session_key, converted_purchase, CASE WHEN r <= round(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def q_train_test_split(spark, sf):
    """M3: the split of every session, a quarter of each class for testing."""
    s = M.with_split(pipeline(spark, sf).sessions)
    return s.select("session_key", M.TARGET, F.when(F.col("_test") == 1, "test").otherwise("train").alias("split"))


@register("model_frame_statistics", "WITH " + S.strip() + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY converted_purchase ORDER BY substr(md5('{M.SEED}:' || session_key), 1, 13))
    > round(count(*) OVER (PARTITION BY converted_purchase) * 0.25) AS train
  FROM sessions)
""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS sd FROM ranked WHERE train"
                         for c in M.NUMERIC_FEATURES), ["mean", "sd"])
def q_model_frame_statistics(spark, sf):
    """M5: mean and population deviation of each numeric feature over the training rows."""
    train = M.with_split(pipeline(spark, sf).sessions).where("_test = 0")
    row = train.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean"),
                               F.stddev_pop(F.col(c).cast("double")).alias("sd")).alias(f"s{i}") for i, c in enumerate(M.NUMERIC_FEATURES)])
    return row.select(F.explode(F.array(*row.columns)).alias("s")).select("s.*")


@register("model_performance", None)
def q_model_performance(spark, sf):
    return pipeline(spark, sf).model.performance


@register("model_saved_scores", O.with_ctes(S, "SELECT count(*) AS sessions, count(*) AS equal_scores FROM sessions"))
def q_model_saved_scores(spark, sf):
    """M4-M8: the fitted model written to a folder, read back and applied to the session table; ``equal_scores``: rows
    whose score is that of the training run."""
    p = pipeline(spark, sf)
    saved = M.PurchaseModel.load(derived(spark, sf, "model", p.model.model.save)).score(p.sessions).select("session_key", F.col("score").alias("_again"))
    both = p.model.scored.select("session_key", "score").join(saved, "session_key", "full")
    return both.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.abs(F.col("score") - F.col("_again")) < 1e-12).alias("equal_scores"))


@register("model_feature_importance", None)
def q_model_feature_importance(spark, sf):
    return pipeline(spark, sf).model.importance


@register("model_coefficient_feed", None)
def q_model_coefficient_feed(spark, sf):
    return M.coefficient_feed(pipeline(spark, sf).model.importance)


@register("high_intent_segments_checkout", None)
def q_high_intent_segments_checkout(spark, sf):
    """M15 on the checkout taxonomy, in which fewer sessions buy and the queue is not empty."""
    return pipeline(spark, sf, "checkout").model.high_intent


@register("model_metrics_fixed_score", "WITH " + S.strip() + f""",
scored AS (SELECT converted_purchase AS y, ({"(journey_depth_pre_purchase + engagement_seconds_winsorized / (engagement_seconds_winsorized + 60.0)) / 5.0"}) AS s FROM sessions),
c AS (SELECT count(*) FILTER (WHERE y = 0 AND s < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp,
             count(*) FILTER (WHERE y = 1 AND s < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp FROM scored),
r AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk,
             sum(y) OVER (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above_pos,
             count(*) OVER (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM scored),
m AS (SELECT sum(rk) FILTER (WHERE y = 1) AS rp, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS q,
             sum(CAST(above_pos AS DOUBLE) / above) FILTER (WHERE y = 1) AS ap FROM r)
SELECT tn, fp, fn, tp, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall,
  CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS accuracy,
  (rp - p * (p + 1) / 2) / (p * q) AS roc_auc, ap / p AS average_precision FROM c, m""",
          ["precision", "recall", "accuracy", "roc_auc", "average_precision"])
def q_model_metrics_fixed_score(spark, sf):
    """M9-M11 fed a fixed score: confusion counts, threshold metrics, ROC AUC and average precision."""
    s = pipeline(spark, sf).sessions.select(F.col(M.TARGET).alias("label"), F.expr(_FIXED_SCORE).alias("score"))
    hit, yes = F.col("score") >= 0.5, F.col("label") == 1
    row = s.agg(F.count_if(~yes & ~hit).alias("tn"), F.count_if(~yes & hit).alias("fp"),
                F.count_if(yes & ~hit).alias("fn"), F.count_if(yes & hit).alias("tp"))
    ranks = M.rank_metrics(s)
    return row.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
                      F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
                      F.try_divide(F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("accuracy"),
                      F.lit(ranks["roc_auc"]).alias("roc_auc"), F.lit(ranks["average_precision"]).alias("average_precision"))


@register("high_intent_segments", None)
def q_high_intent_segments(spark, sf):
    return pipeline(spark, sf).model.high_intent


_FIXED_SCORE = ("(journey_depth_pre_purchase + engagement_seconds_winsorized / (engagement_seconds_winsorized + 60.0)) "
                "/ 5.0")
HIGH_INTENT_DOUBLES = ["avg_predicted_purchase_probability", "cart_rate", "checkout_rate", "avg_engagement_seconds",
                       "avg_journey_depth"]


@register("high_intent_fixed_score", "WITH " + S.strip() + f""",
scored AS (SELECT *, {_FIXED_SCORE} AS score FROM sessions),
thr AS (SELECT GREATEST(0.5, quantile_cont(score, 0.9)) AS t FROM scored)
SELECT ux_intent_segment, device_category, source_medium, landing_path, count(session_key) AS sessions,
  avg(score) AS avg_predicted_purchase_probability, avg(reached_cart) AS cart_rate, avg(reached_checkout) AS checkout_rate,
  {O.eavg('engagement_seconds_winsorized')} AS avg_engagement_seconds, avg(journey_depth_pre_purchase) AS avg_journey_depth
FROM scored WHERE converted_purchase = 0 AND score >= (SELECT t FROM thr) GROUP BY 1, 2, 3, 4""", HIGH_INTENT_DOUBLES)
def q_high_intent_fixed(spark, sf):
    """M14 + M15 fed a fixed rational score, so the threshold and roll-up logic has an exact twin."""
    s = pipeline(spark, sf).sessions.withColumn("score", F.expr(_FIXED_SCORE))
    return M.high_intent_segments(s, "score")


# ---------------------------------------------------------------------------
# G11 over ranges of days: united sketches
# ---------------------------------------------------------------------------
from clickpath.operators import sketches as SK  # noqa: E402

#: Most that an estimate may be off the exact count, as a share of it: over 4 standard errors.
SKETCH_ERROR = 0.03


@register("weekly_totals", "WITH " + O.events_ctes().strip() + f"""
SELECT strftime(date_trunc('week', event_date), '%Y-%m-%d') AS label, count(*) AS total_events,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase_events,
  COALESCE({O.esum('price', "event_type = 'purchase'")}, 0.0) AS purchase_revenue_usd,
  count(DISTINCT user_id) AS exact_users, count(DISTINCT user_session) AS exact_sessions, TRUE AS users_near, TRUE AS sessions_near
FROM clean_events GROUP BY 1""", ["purchase_revenue_usd"])
def q_weekly_totals(spark, sf):
    """Totals of each week from the rows of its days; ``*_near``: the united sketch is within SKETCH_ERROR of the exact count."""
    week = lambda c: F.date_format(F.date_trunc("week", c), DATE_FMT)
    events = pipeline(spark, sf).events
    days = spark.read.parquet(derived(spark, sf, "sketches", lambda path: write_table(SK.daily_sketches(events), path)))
    exact = events.groupBy(week("event_date").alias("label")).agg(F.count_distinct("user_id").alias("exact_users"),
                                                                  F.count_distinct("user_session").alias("exact_sessions"))
    near = lambda c: (F.abs(F.col(c) - F.col(f"exact_{c}")) <= SKETCH_ERROR * F.col(f"exact_{c}")).alias(f"{c}_near")
    return (SK.range_totals(days, week("event_dt")).join(exact, "label")
            .select("label", "total_events", "purchase_events", "purchase_revenue_usd", "exact_users", "exact_sessions", near("users"), near("sessions")))


# ---------------------------------------------------------------------------
# Structured Streaming: append mode emits the windows that the watermark (latest event less the
# delay) has closed; sessions and days still open at the end of the log stay in state
# ---------------------------------------------------------------------------
from clickpath.streaming import jobs as SJ  # noqa: E402


def stream_table(spark, sf, name, aggregate):
    """Result of one streaming aggregate over a folder's event log, run once an application and folder."""
    events = SJ.stream_events(spark, f"{sf.rstrip('/')}/events.parquet")
    place = hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:16]
    return spark.read.parquet(SJ.run_to_table(aggregate(events), f"{name}-{place}"))


@register("streaming_sessions", "WITH " + O.events_ctes().strip() + f""",
late AS (SELECT max(event_time) - INTERVAL 8 HOUR AS mark FROM typed_events)
SELECT user_id, min(event_time) AS session_start, max(event_time) + INTERVAL 8 HOUR AS session_end, count(*) AS event_count,
  count(*) FILTER (WHERE event_type = 'view') AS view_item_count, count(*) FILTER (WHERE event_type = 'cart') AS add_to_cart_count,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count,
  COALESCE({O.esum('price', "event_type = 'purchase'")}, 0.0) AS purchase_revenue_usd
FROM clean_events GROUP BY user_id, user_session HAVING max(event_time) + INTERVAL 8 HOUR <= (SELECT mark FROM late)""",
          ["purchase_revenue_usd"], {"session_start": "ts", "session_end": "ts"})
def q_streaming_sessions(spark, sf):
    """The sessions that the stream has closed."""
    return stream_table(spark, sf, "sessions", SJ.session_counts)


@register("streaming_daily", "WITH " + O.events_ctes().strip() + f""",
late AS (SELECT max(event_time) - INTERVAL 1 HOUR AS mark FROM typed_events)
SELECT event_date AS event_dt, count(*) AS total_events, count(DISTINCT user_id) AS users,
  count(*) FILTER (WHERE event_type = 'view') AS page_views, count(*) FILTER (WHERE event_type = 'cart') AS add_to_cart_events,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase_events,
  COALESCE({O.esum('price', "event_type = 'purchase'")}, 0.0) AS purchase_revenue_usd
FROM typed_events GROUP BY event_date HAVING event_date + INTERVAL 1 DAY <= (SELECT mark FROM late)""",
          ["purchase_revenue_usd"], {"event_dt": "date"})
def q_streaming_daily(spark, sf):
    """The days that the stream has closed."""
    return stream_table(spark, sf, "daily", SJ.daily_counts)


from clickpath.streaming import stateful as SF  # noqa: E402


def delivered(spark, sf, name, parts, run):
    """Result of ``run(stream of typed events, root)`` after several deliveries of a folder's events into one log folder:
    ``parts`` (of the events table) yields what each delivery adds. The stream is run again after every one."""
    def write(path):
        events = read_table(spark, sf, "events")
        for df in parts(events):
            df.write.mode("append").parquet(f"{path}/log")
            run(SJ.stream_events(spark, f"{path}/log"), path)
    return derived(spark, sf, name, write)


def in_time_order_twice(events):
    """Three deliveries by time, each of which brings the one before again."""
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [1 / 3, 2 / 3], 100).alias("c")).first()["c"]
    place = sum((F.unix_micros(F.col("ts").cast("timestamp")) > c).cast("int") for c in cuts)
    return [events.where(place == 0), *(events.where(place.isin(k - 1, k)) for k in (1, 2))]


def in_no_order(events):
    """Three deliveries by the id, the last of which brings the first again."""
    place = F.col("event_id") % 3
    return [events.where(place == 0), events.where(place == 1), events.where(place.isin(2, 0))]


@register("streaming_sessions_exact", "WITH " + O.events_ctes().strip() + f""",
late AS (SELECT max(event_time) - INTERVAL 8 HOUR AS mark FROM typed_events)
SELECT user_session, user_id, min(event_time) AS session_start, max(event_time) AS session_end, count(*) AS event_count,
  count(*) FILTER (WHERE event_type = 'view') AS view_item_count, count(*) FILTER (WHERE event_type = 'cart') AS add_to_cart_count,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count,
  COALESCE({O.esum('price', "event_type = 'purchase'")}, 0.0) AS purchase_revenue_usd
FROM clean_events GROUP BY user_id, user_session HAVING max(event_time) + INTERVAL 8 HOUR <= (SELECT mark FROM late)""",
          ["purchase_revenue_usd"], {"session_start": "ts", "session_end": "ts"})
def q_streaming_sessions_exact(spark, sf):
    """X2 by the rule and with the keys of X1, from a log that is delivered twice."""
    run = lambda stream, root: SJ.run_to_table(SF.timed_sessions(stream, 8 * 3600, "8 hours"), "sessions", root)
    return spark.read.parquet(f"{delivered(spark, sf, 'timed', in_time_order_twice, run)}/sessions/data")


_DAILY_TOTALS_SQL = f"""
SELECT event_date AS event_dt, count(*) AS total_events, count(DISTINCT user_id) AS users,
  count(*) FILTER (WHERE event_type = 'view') AS page_views, count(*) FILTER (WHERE event_type = 'cart') AS add_to_cart_events,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase_events,
  COALESCE({O.esum('price', "event_type = 'purchase'")}, 0.0) AS purchase_revenue_usd FROM typed_events GROUP BY event_date"""


def _corrected(spark, sf):
    run = lambda stream, root: SF.run_daily(stream, "daily", 3600, root)
    return f"{delivered(spark, sf, 'corrected', in_no_order, run)}/daily"


@register("streaming_daily_corrected", "WITH " + O.events_ctes().strip() + _DAILY_TOTALS_SQL, ["purchase_revenue_usd"], {"event_dt": "date"})
def q_streaming_daily_corrected(spark, sf):
    """X3 with late and repeated rows: every day as the batch job has it."""
    columns = ["event_dt", "total_events", "users", "page_views", "add_to_cart_events", "purchase_events", "purchase_revenue_usd"]
    return spark.read.parquet(f"{_corrected(spark, sf)}/days").select(*columns)


@register("streaming_late_rows", "WITH " + O.events_ctes().strip() + """,
d AS (SELECT event_id % 3 AS place, event_id, user_id, event_type, price, event_time FROM typed_events),
m AS (SELECT max(event_time) FILTER (WHERE place = 0) AS first, max(event_time) FILTER (WHERE place < 2) AS second FROM d)
SELECT CAST(1 AS BIGINT) AS batch, event_id, user_id, event_type, price FROM d, m WHERE place = 1 AND event_time < first - INTERVAL 1 HOUR
UNION ALL SELECT 2, event_id, user_id, event_type, price FROM d, m WHERE place <> 1 AND event_time < second - INTERVAL 1 HOUR""", ["price"])
def q_streaming_late_rows(spark, sf):
    """Rows that came more than an hour behind the latest event of the deliveries before, with their delivery."""
    late = spark.read.parquet(f"{_corrected(spark, sf)}/late")
    return late.select(F.col("batch").cast("long").alias("batch"), "event_id", "user_id", "event_type", "price")


# ---------------------------------------------------------------------------
# checkout taxonomy (signup events become checkout): product and daily tables
# ---------------------------------------------------------------------------
@register("product_discovery_checkout", product_sql(checkout=True), PRODUCT_DOUBLES)
def q_product_discovery_checkout(spark, sf):
    return pipeline(spark, sf, "checkout").product


@register("daily_overview_checkout", daily_sql(checkout=True), ["purchase_revenue_usd"], DAY)
def q_daily_overview_checkout(spark, sf):
    p = pipeline(spark, sf, "checkout")
    return sc.daily_overview(p.events, p.taxonomy)
