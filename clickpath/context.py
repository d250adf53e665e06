"""Session-level settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings the library's semantics depend on. They are runtime SQL confs,
# so they can be applied to a session that someone else created.
_SQL_CONF = {
    # all timestamps are treated as UTC wall-clock
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: partition coalescing and skew-join splitting
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # allow a per-task top-k (WindowGroupLimit) for row_number() <= k up to k=5000
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # the JVM only interprets methods over 8000 bytes, so wide projections are generated in smaller ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the library needs; returns ``spark``."""
    for key, value in _SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``; that setting is read from the
    session and never overridden. Only when it is unset and the master is local
    (tests) is a fresh scratch folder created and registered; on a cluster, where
    executors would not see it, that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="clickpath-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that the passes over it do not repeat the work behind it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "clickpath") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
