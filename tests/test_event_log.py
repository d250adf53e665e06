"""S1 + G1-G5 on a raw CSV event log with given session ids (no sessionization)."""

import os
import tempfile

from clickpath.operators.scorecards import daily_overview, product_discovery
from clickpath.operators.sessions import build_sessions, session_features
from clickpath.sources.events import clean_events, read_event_log

ROWS = """event_time,event_type,product_id,category_code,brand,price,user_id,user_session
2020-09-24 11:57:06 UTC,view,p1,electronics.video.tv,acme,10.50,u1,s1
2020-09-24 11:58:00 UTC,cart,p1,electronics.video.tv,acme,10.50,u1,s1
2020-09-24 11:59:30 UTC,purchase,p1,electronics.video.tv,acme,10.50,u1,s1
2020-09-24 12:00:00 UTC,purchase,p2,,,NA,u1,s1
2020-09-24 12:00:00 UTC,view,p3,computers,beta,-3,u2,s2
bad-time,view,p3,computers,beta,3,u2,s2
2020-09-25 08:00:00 UTC,remove_from_cart,p3,computers,beta,3,u2,s2
2020-09-25 08:00:00 UTC,view,p3,computers,beta,abc,u2,s3
2020-09-25 08:05:00 UTC,view,,computers,beta,1,u2,s3
"""


def test_raw_event_log_to_sessions(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="clickpath-log-"), "events.csv")
    with open(path, "w") as fh:
        fh.write(ROWS)
    events = clean_events(read_event_log(spark, path))
    rows = events.collect()
    # dropped: negative price, bad time, unknown type, missing product -> 5 rows kept
    assert len(rows) == 5
    assert {r.category_code for r in rows} >= {"unknown"} and {r.brand for r in rows} >= {"unknown"}
    s = {r.session_key: r for r in session_features(events).collect()}
    assert set(s) == {"s1", "s3"}
    s1 = s["s1"]
    assert (s1.event_count, s1.view_item_count, s1.add_to_cart_count, s1.purchase_count) == (4, 1, 1, 2)
    assert s1.purchase_revenue_usd == 10.5 and s1.total_item_quantity == 2 and s1.unique_products == 2
    assert s1.session_duration_sec == 174.0 and s1.landing_page == "/category/electronics.video.tv"
    assert s1.user_pseudo_id == "u1" and s1.reached_checkout == s1.reached_cart == 1
    assert s["s3"].avg_item_price_usd is None and s["s3"].purchase_revenue_usd == 0.0
    eng = build_sessions(events).collect()
    assert {r.ux_intent_segment for r in eng} == {"Purchasers", "Product detail browsers"}
    assert product_discovery(events).count() == 3
    assert [r.total_events for r in daily_overview(events).collect()] == [4, 1]


def test_time_spellings(spark):
    from pyspark.sql import functions as F

    from clickpath.sources.events import clean_events
    spelled = ["2020-09-24 11:57:06 UTC", "2020-09-24T11:57:06Z", "2020-09-24 11:57:06", "2020-09-24 11:57:06+00:00",
               "2020-09-24T13:57:06.000+02:00", "not a time", None]
    df = spark.createDataFrame([(t, "view", "p", "u", "s", "1.5") for t in spelled],
                               "event_time string, event_type string, product_id string, user_id string, user_session string, price string")
    got = [str(r.event_time) for r in clean_events(df).select(F.col("event_time")).collect()]
    assert got == ["2020-09-24 11:57:06"] * 5


def test_first_of_equal_times_is_the_first_in_the_log(spark, tmp_path):
    from clickpath.operators.sessions import session_features
    from clickpath.schema import EVENT_SCHEMA
    from clickpath.sources.events import clean_events, read_event_log
    path = tmp_path / "log.csv"
    value = {"event_time": "2020-09-24 11:57:06 UTC", "event_type": "view", "brand": "b", "price": "1.0", "user_id": "u"}
    names = EVENT_SCHEMA.fieldNames()
    lines = [",".join(names)]
    for k, c in enumerate(["zzz", "yyy", "aaa", "bbb"]):
        row = value | {"product_id": str(k), "category_code": c, "user_session": f"s{k % 2}"}
        lines.append(",".join(row.get(n, "1") for n in names))
    path.write_text("\n".join(lines) + "\n")
    events = clean_events(read_event_log(spark, str(path)))
    for parts in (1, 4):
        rows = {r.session_key: r.landing_page_title for r in session_features(events.repartition(parts)).collect()}
        assert rows == {"s0": "zzz", "s1": "yyy"}
