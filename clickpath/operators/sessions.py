"""Session tables: assembly from events (G1-G5), cleaning (P10-P14) and
feature engineering (F1-F10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from clickpath.context import written
from clickpath.functions.columns import (
    MISSING,
    clean_category,
    exact_avg,
    exact_sum,
    flag,
    intent_segment,
    is_weekend,
    landing_path,
    month_label,
    to_number,
    weekday_name,
)
from clickpath.operators.ranks import between_ranks, select_ranks
from clickpath.schema import (
    DEFAULT_TAXONOMY,
    SESSION_ATTRIBUTE_DEFAULTS,
    SESSION_CATEGORIES,
    SESSION_COLUMNS,
    SESSION_FLAGS,
    SESSION_MEASURES,
    WINSORIZED,
    Taxonomy,
    normalize_headers,
)
from clickpath.sources.tables import INGEST_ORDINAL


# ---------------------------------------------------------------------------
# One row per session from the cleaned event log
# ---------------------------------------------------------------------------
def _first(value: str, order: F.Column) -> F.Column:
    """First non-null ``value`` in event order (min_by skips NULL orderings)."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def session_features(
    events: DataFrame,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    attributes: DataFrame | None = None,
    session_col: str = "user_session",
) -> DataFrame:
    """The 37-column session table.

    Per-type counts, purchase revenue and units are conditional aggregates of
    one ``groupBy(session)``, so the cross-tab and the two left joins of a
    pandas pipeline collapse into a single hash aggregate with map-side partial
    aggregation (a hot session is pre-combined in every task). The only
    distinct count (products) adds one exchange keyed by (session, product).
    """
    t = taxonomy
    etype = F.col("event_type")
    aggs = [
        F.min("event_time").alias("session_start_ts"),
        F.max("event_time").alias("session_end_ts"),
        F.count("event_type").alias("event_count"),
        F.count_distinct("product_id").alias("unique_products"),
        F.count("product_id").alias("item_touch_count"),
        exact_avg("price").alias("avg_item_price_usd"),
        F.count_if(etype == t.view).alias("view_item_count"),
        F.count_if(etype == t.cart).alias("add_to_cart_count"),
        F.count_if(etype == t.purchase).alias("purchase_count"),
        F.coalesce(exact_sum(F.when(etype == t.purchase, F.col("price"))), F.lit(0.0)).alias("purchase_revenue_usd"),
        F.count(F.when(etype == t.purchase, F.col("product_id"))).alias("total_item_quantity"),
    ]
    if t.checkout is not None:
        aggs.append(F.count_if(etype == t.checkout).alias("_checkout_count"))
    if "session_start" in events.columns:
        # Sessions derived by ``sessionize`` are per user, so the user is part of
        # the key, and the first event is flagged: every aggregate buffer is
        # fixed-width (a hash aggregate, no sort of the event log), and the
        # landing title arrives through a one-row-per-session join.
        s = events.groupBy(F.col(session_col).alias("session_key"), F.col("user_id").alias("user_pseudo_id")).agg(*aggs)
        first = events.where(F.col("session_start") == 1).select(
            F.col(session_col).alias("session_key"), F.col("user_id").alias("user_pseudo_id"),
            F.col("category_code").alias("landing_page_title"))
        # an event delivered twice is flagged twice: one title a session
        first = first.groupBy("session_key", "user_pseudo_id").agg(F.min("landing_page_title").alias("landing_page_title"))
        # joined on the full grouping key, so the aggregate keeps its partitioning (no re-shuffle)
        s = s.join(first, ["session_key", "user_pseudo_id"], "left")
    else:
        # ties in time: the event id, else the row's place in the log, else a hash of the row
        tie = next((F.col(c) for c in ("event_id", INGEST_ORDINAL) if c in events.columns), F.xxhash64(*events.columns))
        order = F.struct(F.col("event_time"), tie.alias("tie"))
        s = events.groupBy(F.col(session_col).alias("session_key")).agg(
            _first("user_id", order).alias("user_pseudo_id"), _first("category_code", order).alias("landing_page_title"),
            *aggs)

    kinds = ["view_item_count", "add_to_cart_count", "purchase_count"] + (
        ["_checkout_count"] if t.checkout is not None else []
    )
    unique_types = sum((F.col(k) > 0).cast("bigint") for k in kinds)
    duration = F.greatest(
        F.timestamp_diff("MICROSECOND", F.col("session_start_ts"), F.col("session_end_ts")) / F.lit(1e6), F.lit(0.0)
    )
    checkout_count = F.col("_checkout_count") if t.checkout is not None else F.col("add_to_cart_count")
    s = s.withColumns({
        "session_date": F.to_date("session_start_ts"),
        "session_duration_sec": duration,
        "unique_event_count": unique_types,
        "page_view_count": F.col("view_item_count"),
        "view_item_list_count": F.lit(0).cast("bigint"),
        "begin_checkout_count": checkout_count,
        "scroll_count": F.lit(0).cast("bigint"),
        "user_engagement_count": (F.col("event_count") > 1).cast("bigint"),
        "reached_session_start": F.lit(1),
        "reached_product_discovery": (F.col("event_count") > 0).cast("int"),
        "reached_product_detail": (F.col("view_item_count") > 0).cast("int"),
        "reached_cart": (F.col("add_to_cart_count") > 0).cast("int"),
        "reached_checkout": (checkout_count > 0).cast("int"),
        "converted_purchase": (F.col("purchase_count") > 0).cast("int"),
        "landing_page": F.concat(
            F.lit("/category/"), F.replace(F.coalesce(F.col("landing_page_title"), F.lit(MISSING)), F.lit(" "), F.lit("-"))
        ),
    })
    s = s.withColumn("engagement_time_msec", F.col("session_duration_sec") * 1000)
    attr_cols = list(SESSION_ATTRIBUTE_DEFAULTS)
    if attributes is not None:
        a = attributes.select(F.col("user_id").alias("_uid"), *attr_cols)
        # one row per user; Spark broadcasts it only under the size threshold
        s = s.join(a, s.user_pseudo_id == a._uid, "left").drop("_uid")
    else:
        s = s.withColumns({c: F.lit(v) for c, v in SESSION_ATTRIBUTE_DEFAULTS.items()})
    return s.select(*SESSION_COLUMNS)


# ---------------------------------------------------------------------------
# P10: keep the first row per key
# ---------------------------------------------------------------------------
def dedup_keep_first(df: DataFrame, key: str | list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key, the first in ``order`` (default: the ingest ordinal if
    present, else the smallest row).

    Written as ``min_by(struct(row), order)`` inside a hash aggregate rather than
    ``row_number()`` over a key window: duplicates of a hot key (even a third of
    the table) are collapsed map-side in every task before the shuffle. NULL keys
    form one group, like the pandas keep-first rule.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    if order is None:
        order = [INGEST_ORDINAL] if INGEST_ORDINAL in df.columns else rest
    row = F.struct(*[F.col(c) for c in rest]).alias("_row")
    rank = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    picked = df.groupBy(*keys).agg(F.min_by(row, rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------
def _measure(df: DataFrame, name: str) -> F.Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        value = F.col(name).cast("bigint")
        return F.greatest(F.coalesce(value, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    value = to_number(name) if isinstance(dtype, T.StringType) else F.col(name).cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def winsor_bounds(df: DataFrame, cols: list[str] = WINSORIZED) -> dict[str, dict]:
    """Exact Q1 / median / Q3 per column -> clip fences (lower floored at 0).

    All columns go through one selection of ranks. ``middle`` keeps the two values next to the
    median, from which the median of a scaled column follows without another pass.
    """
    present = [c for c in cols if c in df.columns]
    ranks = select_ranks(df, {c: [0.25, 0.5, 0.75] for c in present})
    bounds = {}
    for c in present:
        if ranks[c] is None:
            bounds[c] = {"empty": True}
            continue
        q1, med, q3 = (between_ranks(*r) for r in ranks[c])
        iqr = q3 - q1
        bounds[c] = {
            "empty": False,
            "q1": q1, "median": med, "q3": q3, "middle": ranks[c][1],
            "clip": iqr != 0,
            "lower": max(q1 - 1.5 * iqr, 0.0),
            "upper": q3 + 1.5 * iqr,
        }
    return bounds


def winsorize_column(name: str, b: dict) -> F.Column:
    x = F.col(name).cast("double")
    if b["empty"]:
        return F.coalesce(x, F.lit(0.0))
    med = F.lit(float(b["median"]))
    if not b["clip"]:
        return F.coalesce(x, med)
    clipped = F.least(F.greatest(x, F.lit(float(b["lower"]))), F.lit(float(b["upper"])))
    return F.coalesce(clipped, med)


def typed_sessions(df: DataFrame, assume_unique: bool = False) -> DataFrame:
    """Session table -> one typed row per ``session_key``: measures, flags, categories and date coerced.

    ``assume_unique=True`` skips the keep-first pass for tables that are unique
    per ``session_key`` by construction (the output of ``session_features``).
    """
    df = normalize_headers(df)
    if "session_key" not in df.columns:
        raise ValueError("the session table must include a session_key column")
    if not assume_unique:
        df = dedup_keep_first(df, "session_key")
    if INGEST_ORDINAL in df.columns:
        df = df.drop(INGEST_ORDINAL)
    exprs = {c: _measure(df, c) for c in SESSION_MEASURES if c in df.columns}
    for c in SESSION_FLAGS:
        base = exprs.get(c, F.col(c) if c in df.columns else F.lit(0))
        exprs[c] = flag(F.coalesce(base, F.lit(0)) > 0)
    for c in SESSION_CATEGORIES:
        exprs[c] = clean_category(F.col(c) if c in df.columns else F.lit(None).cast("string"))
    if "session_date" in df.columns:
        exprs["session_date"] = F.col("session_date").cast("string").try_cast("date") if not isinstance(
            df.schema["session_date"].dataType, T.DateType
        ) else F.col("session_date")
    return df.withColumns(exprs)


def winsorized(df: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    """Typed sessions with a ``*_winsorized`` column for each measure of ``winsor_bounds``."""
    return df.withColumns({f"{c}_winsorized": winsorize_column(c, b) for c, b in bounds.items()})


def clean_sessions(df: DataFrame, assume_unique: bool = False, winsorize: bool = True) -> DataFrame:
    """Session table -> clean session table (+5 ``*_winsorized`` columns)."""
    df = typed_sessions(df, assume_unique)
    if not winsorize:
        return df
    if not assume_unique:
        df = written(df, "typed-sessions")  # the keep-first pass runs once, not for each pass of the bounds
    return winsorized(df, winsor_bounds(df))


# ---------------------------------------------------------------------------
# Engineered features
# ---------------------------------------------------------------------------
#: Levels that the first pass over a column tracks in each task, and candidates that it names beyond the wanted ones.
TRACKED_LEVELS = 8192
SPARE_LEVELS = 200


def counted_levels(df: DataFrame, levels: dict[str, list[str] | None], top_n: int) -> dict[str, list[tuple[int, str]]]:
    """(count, level) of the ``top_n`` most frequent cleaned levels of each column, among those listed for it (``None``: all)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), (clean_category(c) if known is None else
                                                        F.when(clean_category(c).isin(known), clean_category(c))).alias("_lvl"))
                      for c, known in levels.items()])
    counts = (df.select(F.explode(F.filter(pairs, lambda x: x["_lvl"].isNotNull())).alias("_m")).select("_m._col", "_m._lvl")
              .groupBy("_col", "_lvl").agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy("_col").orderBy(F.desc("_n"), F.asc("_lvl"))
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n)
    out: dict[str, list[tuple[int, str]]] = {c: [] for c in levels}
    for row in top.select("_col", "_lvl", "_n").collect():
        out[row["_col"]].append((row["_n"], row["_lvl"]))
    return {c: sorted(v, key=lambda x: (-x[0], x[1])) for c, v in out.items()}


def top_levels(df: DataFrame, cols: list[str], top_n: int) -> dict[str, list[str]]:
    """The ``top_n`` most frequent cleaned levels of each column.

    Ties at the cut: count descending, then value ascending. Two passes, neither of which shuffles all levels: a
    frequent-items sketch a column (``TRACKED_LEVELS`` counters a task) names candidates, and only those are counted. A level
    that it has not named occurs at most as often as the last one named, or 3.5 / TRACKED_LEVELS of all rows, the sketch's
    proven error, if that is more. If the last wanted level is not above that bound, the column's levels are counted in full.
    At most ``top_n`` levels a column and the candidates reach the driver.
    """
    if not cols:
        return {}
    most = top_n + SPARE_LEVELS
    sketch = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.call_function("approx_top_k", clean_category(c), F.lit(most), F.lit(TRACKED_LEVELS)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    named = {c: [(x["item"], x["count"]) for x in sketch[f"s{i}"] or []] for i, c in enumerate(cols)}
    found = counted_levels(df, {c: [level for level, _ in named[c]] for c in cols}, top_n)
    # a sketch whose counts add up to all rows has named all levels
    bound = {c: 0 if sum(n for _, n in named[c]) == sketch["n"] and len(named[c]) < most else
             max(named[c][-1][1] if len(named[c]) >= most else 0, 3.5 / TRACKED_LEVELS * sketch["n"]) for c in cols}
    unsure = [c for c in cols if bound[c] and (len(found[c]) < top_n or top_n and found[c][-1][0] <= bound[c])]
    if unsure:
        found.update(counted_levels(df, dict.fromkeys(unsure), top_n))
    return {c: [level for _, level in found[c]] for c in cols}


def limited(col: str, levels: list[str]) -> F.Column:
    """Cleaned value if it is one of ``levels``, else ``other``."""
    cleaned = clean_category(col)
    return F.when(cleaned.isin(levels), cleaned).otherwise(F.lit("other")) if levels else F.lit("other")


def limit_cardinality(df: DataFrame, col: str | list[str], top_n: int, out_col: str | None = None) -> DataFrame:
    """Keep the ``top_n`` most frequent cleaned levels of ``col`` (or of each
    column of a list); other levels become ``other``."""
    cols = [col] if isinstance(col, str) else list(col)
    levels = top_levels(df, cols, top_n)
    if isinstance(col, str):
        return df.withColumn(out_col or col, limited(col, levels[col]))
    return df.withColumns({c: limited(c, levels[c]) for c in cols})


def engineer_features(df: DataFrame, landing_top_n: int = 20, bounds: dict[str, dict] | None = None) -> DataFrame:
    """Clean sessions with the journey features. ``bounds`` (of ``winsor_bounds`` on the same rows) spares the pass for the
    median of ``engagement_seconds``: it is that of ``engagement_time_msec``, divided by 1000 rank by rank."""

    def get(c: str, default=0):
        return F.col(c) if c in df.columns else F.lit(default)

    msec_w = "engagement_time_msec_winsorized" if "engagement_time_msec_winsorized" in df.columns else "engagement_time_msec"
    out = df.withColumns({
        "engagement_seconds": get("engagement_time_msec") / 1000,
        "engagement_seconds_winsorized": get(msec_w) / 1000,
        "landing_path": landing_path("landing_page"),
        "source_medium": F.concat(clean_category("traffic_source"), F.lit(" / "), clean_category("traffic_medium")),
    })
    out = limit_cardinality(out, "landing_page_title", landing_top_n, "landing_category_grouped")
    if "session_date" in df.columns:
        cal = {
            "session_weekday": weekday_name("session_date"),
            "session_month": month_label("session_date"),
            "is_weekend": is_weekend("session_date"),
        }
    else:
        cal = {"session_weekday": F.lit(MISSING), "session_month": F.lit(MISSING), "is_weekend": F.lit(0)}
    pre = (
        F.col("reached_product_discovery") + F.col("reached_product_detail") + F.col("reached_cart")
        + F.col("reached_checkout")
    )
    out = out.withColumns({
        **cal,
        "journey_depth": pre + F.col("converted_purchase"),
        "journey_depth_pre_purchase": pre,
        "bounce_like_session": flag(
            (get("event_count") <= 2) & (get("page_view_count") <= 1) & (F.col("reached_product_detail") == 0)
        ),
        "cart_without_checkout": flag((F.col("reached_cart") == 1) & (F.col("reached_checkout") == 0)),
        "checkout_without_purchase": flag((F.col("reached_checkout") == 1) & (F.col("converted_purchase") == 0)),
    })
    known = (bounds or {}).get("engagement_time_msec")
    if known is None:
        middle = (select_ranks(out, {"engagement_seconds": [0.5]})["engagement_seconds"] or [None])[0]
    else:
        middle = None if known["empty"] else (known["middle"][0] / 1000, known["middle"][1] / 1000, known["middle"][2])
    engaged = F.col("engagement_seconds") >= F.lit(between_ranks(*middle)) if middle else F.lit(False)
    out = out.withColumn(
        "high_engagement_no_purchase",
        flag((F.col("converted_purchase") == 0) & (F.col("journey_depth_pre_purchase") >= 3) & engaged),
    )
    return out.withColumn("ux_intent_segment", intent_segment())


def build_sessions(events: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY, attributes: DataFrame | None = None) -> DataFrame:
    """Cleaned events -> engineered session table (unique per key by construction)."""
    typed = typed_sessions(session_features(events, taxonomy, attributes), assume_unique=True)
    bounds = winsor_bounds(typed)
    return engineer_features(winsorized(typed, bounds), bounds=bounds)
