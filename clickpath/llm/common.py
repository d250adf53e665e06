"""Shared pieces of the corpus operators.

Operators take a DataFrame plus the names of its id and text columns, read only
those columns and return the id with their own result columns, so extra columns
of the input can never clash with a result.
"""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickpath.context import checkpoint_dir

#: Rows per Arrow batch sent to Python: bounds a worker's memory, changes no result.
ARROW_ROWS = 512
#: Spark deletes the shuffle files of an SQL execution at its end.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Small Arrow batches, so that a worker holds few whole texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage
    with files that survive lost executors. The shuffle files of the job that writes it are deleted when it ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*kept: DataFrame) -> None:
    """Delete the files of tables that ``keep`` has written, once nothing is read from them any more."""
    for df in kept:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def worker_state(owner: str, name: str, key, make):
    """A value that lives as long as the Python worker: built on first use, then shared by all tasks of
    ``owner`` that this worker runs. There is one value a name, replaced when its key changes, and
    another owner's values are dropped, so a worker that serves many jobs holds the state of one."""
    home = sys.modules.setdefault("_clickpath_worker_state", types.ModuleType("_clickpath_worker_state"))
    if home.__dict__.get("owner") != owner:
        home.owner, home.held = owner, {}
    if name not in home.held or home.held[name][0] != key:
        home.held.pop(name, None)
        home.held[name] = (key, make())
    return home.held[name][1]


def text_of(column: str | None):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def in_order(df: DataFrame, *order) -> DataFrame:
    """``df`` in range partitions of a total order, kept, with the partition's number as ``_part``.
    No task holds more than a range of the rows."""
    return keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id().cast("long")), "ordered")


def global_rank(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with each row's number, from 1, in a total order: numbers inside range partitions plus the
    sizes of the partitions before. Only one row a partition meets in one task."""
    parts = in_order(df, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = (parts.groupBy("_part").agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (parts.withColumn("_inside", inside).join(offset, "_part")
            .withColumn(name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset"))
