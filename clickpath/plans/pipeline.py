"""The analysis pipeline over one data directory, built once per Spark application.

The sessionized event log, the session table and the engineered session table
feed almost every query, so each is written once as parquet into the shared
checkpoint folder (``spark.checkpoint.dir``) and read back. That cuts the
lineage: downstream jobs scan a materialised table (column pruning, filter
pushdown), a lost executor never replays the sessionization shuffles, and
building further DataFrames does not re-analyse a deep plan.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickpath.context import checkpoint_dir, configure
from clickpath.operators import scorecards as sc
from clickpath.operators.sessionize import sessionize
from clickpath.operators.sessions import engineer_features, session_features, typed_sessions, winsor_bounds, winsorized
from clickpath.schema import CHECKOUT_TAXONOMY, DEFAULT_TAXONOMY, Taxonomy
from clickpath.sources.events import clean_events
from clickpath.sources.fixture import fixture_events, fixture_user_attributes

SESSION_GAP_SECONDS = 8 * 3600

_PIPELINES: dict[tuple, "Pipeline"] = {}


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                 with_device: bool = True, persist: bool = True):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self.taxonomy = taxonomy
        self.with_device = with_device
        self.persist = persist

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` to the shared checkpoint folder and read it back."""
        if not self.persist:
            return df
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    # -- events ------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        """S1 + P1-P8 + X1: typed, filtered, sessionized event log."""
        raw = fixture_events(self.spark, self.sf_dir, self.taxonomy)
        clean = clean_events(raw, self.taxonomy, required=["event_time", "event_type", "user_id", "product_id"])
        return self._keep(sessionize(clean, gap_seconds=SESSION_GAP_SECONDS), "events")

    @cached_property
    def user_attributes(self) -> DataFrame:
        return fixture_user_attributes(self.spark, self.sf_dir, with_device=self.with_device)

    # -- sessions ----------------------------------------------------------
    @cached_property
    def session_features(self) -> DataFrame:
        return self._keep(session_features(self.events, self.taxonomy, self.user_attributes), "session_features")

    @cached_property
    def sessions_typed(self) -> DataFrame:
        return typed_sessions(self.session_features, assume_unique=True)

    @cached_property
    def bounds(self) -> dict[str, dict]:
        """Quartiles and fences of the winsorized measures."""
        return winsor_bounds(self.sessions_typed)

    @cached_property
    def sessions_clean(self) -> DataFrame:
        return winsorized(self.sessions_typed, self.bounds)

    @cached_property
    def sessions(self) -> DataFrame:
        """The engineered session table every analysis reads."""
        return self._keep(engineer_features(self.sessions_clean, bounds=self.bounds), "sessions")

    # -- scorecards --------------------------------------------------------
    @cached_property
    def funnel(self) -> DataFrame:
        return sc.overall_funnel(self.sessions)

    @cached_property
    def segments(self) -> DataFrame:
        return sc.behavior_segments(self.sessions)

    @cached_property
    def landing(self) -> DataFrame:
        return sc.landing_scorecard(self.sessions)

    @cached_property
    def product(self) -> DataFrame:
        """Written once: the scorecard reads it twice (its rows and their best rate)."""
        return self._keep(sc.product_discovery(self.events, self.taxonomy), "product").orderBy(F.desc("product_views"))

    # -- model -------------------------------------------------------------
    @cached_property
    def model(self):
        from clickpath.operators.model import train_purchase_model
        return train_purchase_model(self.sessions)


def pipeline(spark: SparkSession, sf_dir: str, variant: str = "default") -> Pipeline:
    """Shared pipeline per (application, directory, variant).

    Variants: ``default`` (view/cart/purchase, device from user id),
    ``checkout`` (signup events become checkout), ``nodevice`` (device unknown).
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), variant)
    if key not in _PIPELINES:
        taxonomy = CHECKOUT_TAXONOMY if variant == "checkout" else DEFAULT_TAXONOMY
        _PIPELINES[key] = Pipeline(spark, sf_dir, taxonomy, with_device=(variant != "nodevice"))
    return _PIPELINES[key]
