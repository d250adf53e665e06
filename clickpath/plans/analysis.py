"""End-to-end entry points, as a user of the library runs them.

``prepare_event_log``  raw event log -> session, product and daily tables (S1, P1-P8, G1-G11, S6)
``run_analysis``       session table -> every result table (P10-P14, F1-F10, G12-G18, T1-T9, M1-M15, S6)

Both take DataFrames and write their outputs with ``sources.tables.write_table``
(parquet by default, CSV on request); the session tables are partitioned by
``session_date`` so date filters prune files. Nothing is collected except the
bounded statistics the operators themselves need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from clickpath.operators import scorecards as sc
from clickpath.operators import stats as st
from clickpath.operators.model import train_purchase_model
from clickpath.operators.sessionize import sessionize
from clickpath.operators.sessions import engineer_features, session_features, typed_sessions, winsor_bounds, winsorized
from clickpath.schema import DEFAULT_TAXONOMY, Taxonomy
from clickpath.sources.events import clean_events
from clickpath.sources.tables import write_table


def prepare_event_log(events: DataFrame, out_dir: str, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                      gap_seconds: int | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Entry 1: clean the raw log (sessionizing by inactivity gap when it has no
    session ids) and write the session, product and daily tables."""
    required = ["event_time", "event_type", "user_id", "product_id"]
    if "user_session" in events.columns and gap_seconds is None:
        required.append("user_session")
    clean = clean_events(events, taxonomy, required=required)
    if "user_session" not in events.columns or gap_seconds is not None:
        clean = sessionize(clean, gap_seconds=gap_seconds or 8 * 3600)
    out = {
        "session_features": f"{out_dir}/session_features",
        "product_discovery": f"{out_dir}/product_discovery",
        "event_overview": f"{out_dir}/event_overview",
    }
    write_table(session_features(clean, taxonomy), out["session_features"], fmt, partition_by=["session_date"])
    write_table(sc.product_discovery(clean, taxonomy), out["product_discovery"], fmt)
    write_table(sc.daily_overview(clean, taxonomy), out["event_overview"], fmt)
    return out


def run_analysis(sessions: DataFrame, out_dir: str, landing: DataFrame | None = None,
                 product: DataFrame | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Entry 2: clean + engineer the session table, then write every result table.

    ``landing`` (optional) replaces the computed landing scorecard, ``product``
    (optional) adds the product scorecard, as in the reference's optional inputs.
    """
    spark = sessions.sparkSession
    engineered_path = f"{out_dir}/session_features_clean"
    typed = typed_sessions(sessions)
    bounds = winsor_bounds(typed)
    write_table(engineer_features(winsorized(typed, bounds), bounds=bounds), engineered_path, fmt, partition_by=["session_date"])
    clean = spark.read.format(fmt).option("header", True).load(engineered_path) if fmt == "csv" else \
        spark.read.parquet(engineered_path)

    model = train_purchase_model(clean)
    tables = {
        "overall_funnel": sc.overall_funnel(clean),
        "headline_summary": sc.headline_summary(clean, model.performance),
        "landing_page_scorecard": sc.landing_passthrough(landing) if landing is not None else sc.landing_scorecard(clean),
        "ux_behavior_segments": sc.behavior_segments(clean),
        "statistical_tests": st.hypothesis_suite(clean),
        "normality_checks": st.normality_suite(clean),
        "model_performance": model.performance,
        "model_feature_importance": model.importance,
        "high_intent_no_purchase_segments": model.high_intent,
    }
    if product is not None:
        tables["product_discovery_scorecard"] = sc.product_scorecard(product)
    out = {"session_features_clean": engineered_path}
    for name, df in tables.items():
        path = f"{out_dir}/{name}"
        write_table(df, path, fmt)
        out[name] = path
    return out
