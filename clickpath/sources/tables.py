"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickpath.schema import normalize_headers

# Text tokens that a CSV reader treats as missing (pandas' default
# set); a lone blank is not among them.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INGEST_ORDINAL = "_ingest_ordinal"


def with_log_order(scan: DataFrame) -> DataFrame:
    """A file scan with each row's place in the log as ``INGEST_ORDINAL``: (file path, first byte of the split, place in the
    split), in the order of those.

    Files count in the order of their paths and a file's rows in their own order, however Spark packs splits into tasks: a
    split's rows are numbered by one task in the order of the file, so only their numbers depend on the packing, not their
    order. Several files of one log therefore give the same result as one, with any number of cores. Call it on the
    scan itself, before any other step.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return scan.withColumn(INGEST_ORDINAL, place)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as parquet (column pruning and filters reach the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def null_tokens_to_null(df: DataFrame, keep_na: bool = False) -> DataFrame:
    """Map the CSV missing-value tokens of every string column to NULL.

    ``keep_na=True`` keeps the literal ``NA`` (for example a country code).
    """
    tokens = [t for t in NULL_TOKENS if not (keep_na and t == "NA")]
    exprs = {}
    for field in df.schema.fields:
        if field.dataType.simpleString() == "string":
            c = F.col(field.name)
            exprs[field.name] = F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)
    return df.withColumns(exprs) if exprs else df


def read_csv_table(spark: SparkSession, path: str, keep_na: bool = False) -> DataFrame:
    """A CSV export read as text: headers normalised, missing tokens mapped.

    Every column stays a string; typed coercion happens in the cleaners with
    ``try_*`` casts, so bad values become NULL instead of failing the job.
    A missing path raises Spark's own PATH_NOT_FOUND error. Rows carry their place in the
    file or files (``with_log_order``), which keep-first de-duplication goes by.
    """
    df = with_log_order(
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
        .option("multiLine", False)
        .csv(path)
    )
    df = normalize_headers(df)
    return null_tokens_to_null(df, keep_na=keep_na)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                only_partitions: bool = False) -> None:
    """Overwrite ``path`` with ``df``; the session table is partitioned by date so
    date filters prune files.

    ``only_partitions`` overwrites just the partitions that ``df`` has rows of and leaves the others as they are,
    so that a day can be written again, any number of times.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if only_partitions else "static")
    elif only_partitions:
        raise ValueError("only_partitions needs partition_by")
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table of files bucketed and sorted by ``key``, and read it back: a join or aggregate on the key
    with a table of as many buckets needs no shuffle."""
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
