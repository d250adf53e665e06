"""DuckDB SQL twins of the registered queries.

Each twin recomputes its result from the raw driver tables (events, part,
customer, nation, region, pages) with plain SQL, sharing the CTE chain below:
cleaned + sessionized events -> session table -> clean sessions -> engineered
sessions. Floating-point outputs are rounded to ``DIGITS`` decimals on both
sides so that summation order does not change the value hash.
"""

from __future__ import annotations

from clickpath.functions.columns import WHITE_SPACE

DIGITS = 6
GAP_US = 8 * 3600 * 1_000_000


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE_SPACE}+|{WHITE_SPACE}+$', '', 'g')"


def clean_category_sql(x: str) -> str:
    s = _strip(f"CAST({x} AS VARCHAR)")
    return (
        f"(CASE WHEN {x} IS NULL THEN 'unknown' ELSE (CASE {s} WHEN '' THEN 'unknown' WHEN '<Other>' THEN 'other' "
        f"WHEN '(not set)' THEN 'not set' WHEN 'nan' THEN 'unknown' WHEN 'None' THEN 'unknown' ELSE {s} END) END)"
    )


_URL_RE = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)"
_PARAM_SCHEMES = "'', 'ftp', 'hdl', 'prospero', 'http', 'imap', 'https', 'shttp', 'rtsp', 'rtsps', 'rtspu', 'sip', 'sips', 'mms', 'sftp', 'tel'"


def landing_path_sql(x: str) -> str:
    text = _strip(f"CAST({x} AS VARCHAR)")
    url = f"regexp_replace({text}, '[\\t\\r\\n]', '', 'g')"
    scheme = f"regexp_extract({url}, '{_URL_RE}', 1)"
    netloc = f"regexp_extract({url}, '{_URL_RE}', 3)"
    raw_path = f"regexp_extract({url}, '{_URL_RE}', 4)"
    path = f"(CASE WHEN lower({scheme}) IN ({_PARAM_SCHEMES}) THEN regexp_replace({raw_path}, ';[^/]*$', '') ELSE {raw_path} END)"
    chosen = f"(CASE WHEN {scheme} <> '' OR {netloc} <> '' THEN (CASE WHEN {path} = '' THEN '/' ELSE {path} END) ELSE {text} END)"
    return f"(CASE WHEN {text} IS NULL OR {text} = '' THEN '(missing)' ELSE substring({chosen}, 1, 140) END)"


def esum(x: str, where: str | None = None) -> str:
    """Plain decimal sum, as the nearest double (by way of its digits)."""
    filt = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(CAST(sum(CAST({x} AS DECIMAL(38,9))){filt} AS VARCHAR) AS DOUBLE)"


def eavg(x: str) -> str:
    """Plain mean: decimal sum over count."""
    return f"({esum(x)} / NULLIF(count({x}), 0))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def events_ctes(checkout: bool = False, given: bool = False, time: str = "e.ts") -> str:
    """``given``: one session a user and day instead of sessions by gap; ``time``: the time of an event."""
    if given:
        gap = events_ctes(checkout, time=time)
        head = gap[:gap.index("gap_events AS (")]
        return head + """clean_events AS (
  SELECT event_id, event_time, event_type, product_id, category_code, brand, price, user_id,
         user_id || '-' || strftime(event_time, '%Y%m%d') AS user_session, event_date
  FROM typed_events
)"""
    mapping = "WHEN 'click' THEN 'cart'" + (" WHEN 'signup' THEN 'checkout'" if checkout else "")
    kinds = "'view', 'cart', 'purchase'" + (", 'checkout'" if checkout else "")
    return f"""
raw_events AS (
  SELECT e.event_id, {time} AS event_time,
         CASE e.event_type {mapping} ELSE e.event_type END AS event_type,
         TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
         CASE WHEN isnan(e.value) THEN NULL ELSE e.value END AS price,
         e.user_id
  FROM events e
),
typed_events AS (
  SELECT r.event_id, r.event_time, r.event_type, CAST(r.k AS VARCHAR) AS product_id,
         COALESCE(CASE WHEN r.k % 10 <> 0 THEN lower(p.p_type) || '.' || lower(replace(p.p_brand, '#', '')) END, 'unknown') AS category_code,
         COALESCE(CASE WHEN r.k % 10 <> 0 THEN p.p_brand END, 'unknown') AS brand,
         r.price, CAST(r.user_id AS VARCHAR) AS user_id, CAST(r.event_time AS DATE) AS event_date
  FROM raw_events r LEFT JOIN part p ON p.p_partkey = r.k
  WHERE r.event_time IS NOT NULL AND r.event_type IS NOT NULL AND r.user_id IS NOT NULL AND r.k IS NOT NULL
    AND r.event_type IN ({kinds}) AND (r.price IS NULL OR r.price >= 0)
),
gap_events AS (
  SELECT *, CASE WHEN epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time, event_id)) > {GAP_US}
                 THEN 1 ELSE 0 END AS brk
  FROM typed_events
),
clean_events AS (
  SELECT event_id, event_time, event_type, product_id, category_code, brand, price, user_id,
         user_id || '-' || CAST(SUM(brk) OVER (PARTITION BY user_id ORDER BY event_time, event_id
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS user_session,
         event_date
  FROM gap_events
)"""


def sessions_ctes(checkout: bool = False, device: bool = True, given: bool = False, time: str = "e.ts") -> str:
    checkout_count = "count(*) FILTER (WHERE event_type = 'checkout')" if checkout else "count(*) FILTER (WHERE event_type = 'cart')"
    unique_types = (
        "CAST(view_item_count > 0 AS BIGINT) + CAST(add_to_cart_count > 0 AS BIGINT) + CAST(purchase_count > 0 AS BIGINT)"
        + (" + CAST(begin_checkout_count > 0 AS BIGINT)" if checkout else "")
    )
    device_sql = (
        "CASE c.c_custkey % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END" if device else "'unknown'"
    )
    measures_int = [
        "event_count", "unique_event_count", "page_view_count", "view_item_list_count", "view_item_count",
        "add_to_cart_count", "begin_checkout_count", "purchase_count", "scroll_count", "user_engagement_count",
        "total_item_quantity", "item_touch_count", "unique_products",
    ]
    measures_dbl = ["session_duration_sec", "engagement_time_msec", "purchase_revenue_usd", "avg_item_price_usd"]
    flags = ["reached_session_start", "reached_product_discovery", "reached_product_detail", "reached_cart",
             "reached_checkout", "converted_purchase"]
    cats = ["device_category", "operating_system", "country", "region", "traffic_source", "traffic_medium",
            "traffic_campaign", "landing_page", "landing_page_title"]
    clean_cols = ",\n    ".join(
        ["session_key", "user_pseudo_id", "session_date", "session_start_ts", "session_end_ts"]
        + [f"GREATEST(COALESCE({c}, 0), 0) AS {c}" for c in measures_int]
        + [f"GREATEST(COALESCE(CAST({c} AS DOUBLE), 0.0), 0.0) AS {c}" for c in measures_dbl]
        + [f"CAST(COALESCE({c}, 0) > 0 AS INTEGER) AS {c}" for c in flags]
        + [f"{clean_category_sql(c)} AS {c}" for c in cats]
    )
    wins = ["session_duration_sec", "event_count", "page_view_count", "engagement_time_msec", "purchase_revenue_usd"]
    qcols = ",\n    ".join(
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) AS {c}_q3"
        for c in wins
    )
    wcols = []
    for c in wins:
        q1, q2, q3 = f"q.{c}_q1", f"q.{c}_q2", f"q.{c}_q3"
        iqr = f"({q3} - {q1})"
        wcols.append(
            f"CASE WHEN {iqr} = 0 THEN COALESCE(CAST(s.{c} AS DOUBLE), {q2}) "
            f"ELSE COALESCE(LEAST(GREATEST(CAST(s.{c} AS DOUBLE), GREATEST({q1} - 1.5 * {iqr}, 0.0)), {q3} + 1.5 * {iqr}), {q2}) END "
            f"AS {c}_winsorized"
        )
    wsel = ",\n    ".join(wcols)
    title = clean_category_sql("landing_page_title")
    return f"""{events_ctes(checkout, given, time)},
session_base AS (
  SELECT user_session AS session_key,
    first(user_id ORDER BY event_time, event_id) AS user_pseudo_id,
    min(event_time) AS session_start_ts, max(event_time) AS session_end_ts,
    count(event_type) AS event_count, count(DISTINCT product_id) AS unique_products,
    count(product_id) AS item_touch_count, {eavg('price')} AS avg_item_price_usd,
    first(category_code ORDER BY event_time, event_id) AS landing_page_title,
    count(*) FILTER (WHERE event_type = 'view') AS view_item_count,
    count(*) FILTER (WHERE event_type = 'cart') AS add_to_cart_count,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count,
    {checkout_count} AS begin_checkout_count,
    COALESCE({esum('price', "event_type = 'purchase'")}, 0.0) AS purchase_revenue_usd,
    count(product_id) FILTER (WHERE event_type = 'purchase') AS total_item_quantity
  FROM clean_events GROUP BY user_session
),
user_attrs AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS user_id, {device_sql} AS device_category,
         'unknown' AS operating_system, n.n_name AS country, r.r_name AS region, c.c_mktsegment AS traffic_source,
         'clickstream' AS traffic_medium, 'electronics_events_history' AS traffic_campaign
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
session_features AS (
  SELECT b.session_key, b.user_pseudo_id, CAST(b.session_start_ts AS DATE) AS session_date,
    b.session_start_ts, b.session_end_ts,
    GREATEST((epoch_us(b.session_end_ts) - epoch_us(b.session_start_ts)) / 1000000.0, 0.0) AS session_duration_sec,
    u.device_category, u.operating_system, u.country, u.region, u.traffic_source, u.traffic_medium, u.traffic_campaign,
    '/category/' || replace(COALESCE(b.landing_page_title, 'unknown'), ' ', '-') AS landing_page,
    b.landing_page_title, b.event_count, {unique_types} AS unique_event_count, b.unique_products,
    b.avg_item_price_usd, b.view_item_count AS page_view_count, CAST(0 AS BIGINT) AS view_item_list_count,
    b.view_item_count, b.add_to_cart_count, b.begin_checkout_count, b.purchase_count,
    CAST(0 AS BIGINT) AS scroll_count, CAST(b.event_count > 1 AS BIGINT) AS user_engagement_count,
    GREATEST((epoch_us(b.session_end_ts) - epoch_us(b.session_start_ts)) / 1000000.0, 0.0) * 1000 AS engagement_time_msec,
    b.purchase_revenue_usd, b.total_item_quantity, b.item_touch_count,
    1 AS reached_session_start, CAST(b.event_count > 0 AS INTEGER) AS reached_product_discovery,
    CAST(b.view_item_count > 0 AS INTEGER) AS reached_product_detail,
    CAST(b.add_to_cart_count > 0 AS INTEGER) AS reached_cart,
    CAST(b.begin_checkout_count > 0 AS INTEGER) AS reached_checkout,
    CAST(b.purchase_count > 0 AS INTEGER) AS converted_purchase
  FROM session_base b LEFT JOIN user_attrs u ON u.user_id = b.user_pseudo_id
),
sessions_typed AS (
  SELECT
    {clean_cols}
  FROM session_features
),
wq AS (
  SELECT
    {qcols}
  FROM sessions_typed
),
sessions_clean AS (
  SELECT s.*,
    {wsel}
  FROM sessions_typed s, wq q
),
title_top AS (
  SELECT lvl FROM (SELECT {title} AS lvl, count(*) AS n FROM sessions_clean GROUP BY 1)
  ORDER BY n DESC, lvl ASC LIMIT 20
),
sessions_eng1 AS (
  SELECT s.*,
    s.engagement_time_msec / 1000 AS engagement_seconds,
    s.engagement_time_msec_winsorized / 1000 AS engagement_seconds_winsorized,
    {landing_path_sql('s.landing_page')} AS landing_path,
    {clean_category_sql('s.traffic_source')} || ' / ' || {clean_category_sql('s.traffic_medium')} AS source_medium,
    CASE WHEN {title.replace('landing_page_title', 's.landing_page_title')} IN (SELECT lvl FROM title_top)
         THEN {title.replace('landing_page_title', 's.landing_page_title')} ELSE 'other' END AS landing_category_grouped,
    COALESCE(dayname(s.session_date), 'unknown') AS session_weekday,
    COALESCE(strftime(s.session_date, '%Y-%m'), 'unknown') AS session_month,
    COALESCE(CAST(isodow(s.session_date) IN (6, 7) AS INTEGER), 0) AS is_weekend,
    s.reached_product_discovery + s.reached_product_detail + s.reached_cart + s.reached_checkout + s.converted_purchase AS journey_depth,
    s.reached_product_discovery + s.reached_product_detail + s.reached_cart + s.reached_checkout AS journey_depth_pre_purchase,
    CAST(s.event_count <= 2 AND s.page_view_count <= 1 AND s.reached_product_detail = 0 AS INTEGER) AS bounce_like_session,
    CAST(s.reached_cart = 1 AND s.reached_checkout = 0 AS INTEGER) AS cart_without_checkout,
    CAST(s.reached_checkout = 1 AND s.converted_purchase = 0 AS INTEGER) AS checkout_without_purchase
  FROM sessions_clean s
),
sessions AS (
  SELECT s.*,
    CAST(s.converted_purchase = 0 AND s.journey_depth_pre_purchase >= 3
         AND s.engagement_seconds >= (SELECT quantile_cont(engagement_seconds, 0.5) FROM sessions_eng1) AS INTEGER)
      AS high_engagement_no_purchase,
    CASE WHEN s.converted_purchase = 1 THEN 'Purchasers'
         WHEN s.reached_checkout = 1 THEN 'Checkout abandoners'
         WHEN s.reached_cart = 1 THEN 'Cart abandoners'
         WHEN s.reached_product_detail = 1 THEN 'Product detail browsers'
         WHEN s.reached_product_discovery = 1 THEN 'Discovery-only browsers'
         WHEN s.bounce_like_session = 1 THEN 'Shallow low-intent sessions'
         ELSE 'General visitors' END AS ux_intent_segment
  FROM sessions_eng1 s
)"""


def rounded(select_sql: str, doubles: list[str]) -> str:
    """Wrap a query so its floating-point columns are rounded to ``DIGITS``."""
    if not doubles:
        return select_sql
    # Spark rounds a double half-up on its shortest decimal text; do the same here
    repl = ", ".join(
        f"COALESCE(CAST(round(TRY_CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,18)), {DIGITS}) AS DOUBLE), round({c}, {DIGITS})) AS {c}"
        for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({select_sql}) AS t"


def as_text(select_sql: str, temporal: dict[str, str]) -> str:
    """Render the named date (``date``) / timestamp (``ts``) output columns as ISO text,
    in the same formats as the Spark side."""
    if not temporal:
        return select_sql
    fmt = {"date": "%Y-%m-%d", "ts": "%Y-%m-%d %H:%M:%S.%f"}
    repl = ", ".join(f"strftime({c}, '{fmt[k]}') AS {c}" for c, k in temporal.items())
    return f"SELECT * REPLACE ({repl}) FROM ({select_sql}) AS t_txt"


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


# ---------------------------------------------------------------------------
# hypothesis-test twins: one row of statistic / dof / effect / n / medians
# ---------------------------------------------------------------------------
_TEST_TAIL = "test, status, statistic, degrees_of_freedom, effect_size, n, group_0_median, group_1_median, groups"


def _where(col_a: str, col_b: str, where: str | None) -> str:
    extra = f" AND {where} = 1" if where else ""
    return f"WHERE {col_a} IS NOT NULL AND {col_b} IS NOT NULL{extra}"


def _midrank(v: str) -> str:
    return f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0)"


def chi2_sql(cat: str, out: str, where: str | None = None) -> str:
    return f"""
t_sub AS (SELECT {cat} AS cat, {out} AS outc FROM sessions {_where(cat, out, where)}),
t_cells AS (SELECT cat, outc, count(*) AS o FROM t_sub GROUP BY 1, 2),
t_rr AS (SELECT cat, sum(o) AS r FROM t_cells GROUP BY 1),
t_cc AS (SELECT outc, sum(o) AS c FROM t_cells GROUP BY 1),
t_dims AS (SELECT (SELECT count(*) FROM t_rr) AS nr, (SELECT count(*) FROM t_cc) AS nc, (SELECT sum(o) FROM t_cells) AS n),
t_grid AS (
  SELECT COALESCE(t_cells.o, 0) AS o, CAST(t_rr.r AS DOUBLE) * t_cc.c / t_dims.n AS e, t_dims.nr, t_dims.nc, t_dims.n
  FROM t_rr CROSS JOIN t_cc CROSS JOIN t_dims
  LEFT JOIN t_cells ON t_cells.cat = t_rr.cat AND t_cells.outc = t_cc.outc),
t_terms AS (
  SELECT *, CASE WHEN (nr - 1) * (nc - 1) = 1 THEN o + LEAST(0.5, abs(e - o)) * sign(e - o) ELSE o END AS oa FROM t_grid),
t_res AS (
  SELECT max(nr) AS nr, max(nc) AS nc, max(n) AS n, sum(pow(oa - e, 2) / e) AS stat FROM t_terms)
SELECT 'Chi-square' AS test,
  CASE WHEN nr >= 2 AND nc >= 2 THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN nr >= 2 AND nc >= 2 THEN stat END AS statistic,
  CASE WHEN nr >= 2 AND nc >= 2 THEN CAST((nr - 1) * (nc - 1) AS DOUBLE) END AS degrees_of_freedom,
  CASE WHEN nr >= 2 AND nc >= 2 THEN sqrt(stat / n / GREATEST(LEAST(nr - 1, nc - 1), 1)) END AS effect_size,
  CASE WHEN nr >= 2 AND nc >= 2 THEN CAST(n AS BIGINT) END AS n,
  CAST(NULL AS DOUBLE) AS group_0_median, CAST(NULL AS DOUBLE) AS group_1_median, CAST(NULL AS BIGINT) AS groups
FROM t_res"""


def mwu_sql(metric: str, outcome: str, where: str | None = None) -> str:
    ok = "n0 >= 5 AND n1 >= 5"
    u0 = "(r0 - CAST(n0 AS DOUBLE) * (n0 + 1) / 2.0)"
    return f"""
t_sub AS (SELECT CAST({metric} AS DOUBLE) AS v, {outcome} AS g FROM sessions {_where(metric, outcome, where)} AND {outcome} IN (0, 1)),
t_rk AS (SELECT v, g, {_midrank('v')} AS rnk FROM t_sub),
t_res AS (
  SELECT count(*) FILTER (WHERE g = 0) AS n0, count(*) FILTER (WHERE g = 1) AS n1,
         sum(rnk) FILTER (WHERE g = 0) AS r0,
         quantile_cont(v, 0.5) FILTER (WHERE g = 0) AS m0, quantile_cont(v, 0.5) FILTER (WHERE g = 1) AS m1
  FROM t_rk)
SELECT 'Mann-Whitney U' AS test, CASE WHEN {ok} THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN {ok} THEN {u0} END AS statistic, CAST(NULL AS DOUBLE) AS degrees_of_freedom,
  CASE WHEN {ok} THEN 2 * {u0} / (CAST(n0 AS DOUBLE) * n1) - 1 END AS effect_size,
  CASE WHEN {ok} THEN CAST(n0 + n1 AS BIGINT) END AS n,
  CASE WHEN {ok} THEN m0 END AS group_0_median, CASE WHEN {ok} THEN m1 END AS group_1_median,
  CAST(NULL AS BIGINT) AS groups
FROM t_res"""


def kw_sql(cat: str, metric: str, where: str | None = None) -> str:
    h = "((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n * n * n - n)))"
    ok = "k >= 2 AND (1 - tie / (n * n * n - n)) > 0"
    return f"""
t_sub AS (SELECT {cat} AS cat, CAST({metric} AS DOUBLE) AS v FROM sessions {_where(cat, metric, where)}),
t_kept AS (SELECT * FROM t_sub WHERE cat IN (SELECT cat FROM t_sub GROUP BY cat HAVING count(*) >= 5)),
t_rk AS (SELECT cat, v, {_midrank('v')} AS rnk FROM t_kept),
t_g AS (SELECT cat, sum(rnk) AS r, count(*) AS nc FROM t_rk GROUP BY cat),
t_tie AS (SELECT COALESCE(sum(pow(c, 3) - c), 0.0) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM t_kept GROUP BY v)),
t_res AS (SELECT sum(r * r / nc) AS s, CAST(sum(nc) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k,
                 (SELECT tie FROM t_tie) AS tie FROM t_g)
SELECT 'Kruskal-Wallis' AS test, CASE WHEN {ok} THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN {ok} THEN {h} END AS statistic, CASE WHEN {ok} THEN k - 1 END AS degrees_of_freedom,
  CASE WHEN {ok} AND n > k THEN ({h} - k + 1) / (n - k) END AS effect_size,
  CASE WHEN {ok} THEN CAST(n AS BIGINT) END AS n,
  CAST(NULL AS DOUBLE) AS group_0_median, CAST(NULL AS DOUBLE) AS group_1_median,
  CASE WHEN {ok} THEN CAST(k AS BIGINT) END AS groups
FROM t_res"""


def spearman_sql(x: str, y: str, where: str | None = None) -> str:
    return f"""
t_sub AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM sessions {_where(x, y, where)}),
t_rk AS (SELECT {_midrank('x')} AS rx, {_midrank('y')} AS ry FROM t_sub),
t_res AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM t_rk)
SELECT 'Spearman correlation' AS test, CASE WHEN n >= 10 THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN n >= 10 THEN rho END AS statistic, CAST(NULL AS DOUBLE) AS degrees_of_freedom,
  CASE WHEN n >= 10 THEN rho END AS effect_size, CASE WHEN n >= 10 THEN CAST(n AS BIGINT) END AS n,
  CAST(NULL AS DOUBLE) AS group_0_median, CAST(NULL AS DOUBLE) AS group_1_median, CAST(NULL AS BIGINT) AS groups
FROM t_res"""


TEST_SQL = {"chi2": chi2_sql, "mwu": mwu_sql, "kw": kw_sql, "spearman": spearman_sql}
TEST_COLUMNS = _TEST_TAIL
