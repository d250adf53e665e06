"""Event-log cleaning (operators P1-P8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from clickpath.functions.columns import MISSING, nan_to_null, to_number
from clickpath.schema import DEFAULT_TAXONOMY, Taxonomy

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss z"

REQUIRED_KEYS = ["event_time", "event_type", "user_id", "user_session", "product_id"]


def _as_timestamp(df: DataFrame, name: str, fmt: str) -> F.Column:
    """UTC wall-clock TIMESTAMP_NTZ; unparseable text becomes NULL."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.TimestampType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    text = c.cast("string")
    # the named format, then any ISO spelling: T or blank, fraction, Z, offset, zone name or none (UTC)
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit(fmt)), F.try_to_timestamp(text))
    return parsed.cast("timestamp_ntz")


def _as_double(df: DataFrame, name: str) -> F.Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return to_number(name)
    return nan_to_null(F.col(name).cast("double"))


def event_rules(df: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY, time_format: str = TIME_FORMAT,
                required: list[str] | None = None) -> dict[str, F.Column]:
    """The rejecting rules of the cleaning step in their order: name -> whether a typed row breaks it. The first rule that
    a row breaks is the one that rejects it."""
    required = [c for c in (required or REQUIRED_KEYS) if c in df.columns]
    rules = {f"missing_{c}": F.col(c).isNull() for c in required}
    rules["other_event_type"] = ~F.coalesce(F.col("event_type").isin(taxonomy.event_types), F.lit(False))
    rules["negative_price"] = F.coalesce(F.col("price") < 0, F.lit(False))
    return rules


def typed_events(df: DataFrame, time_format: str = TIME_FORMAT) -> DataFrame:
    """Event time and price with their types; what can't be parsed is null."""
    return df.withColumns({"event_time": _as_timestamp(df, "event_time", time_format), "price": _as_double(df, "price")})


def defaulted(df: DataFrame) -> DataFrame:
    """Default category and brand, ids as text and the date of the event."""
    cats = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in ("category_code", "brand") if c in df.columns}
    ids = {c: F.col(c).cast("string") for c in ("product_id", "user_id", "user_session") if c in df.columns}
    return df.withColumns({**cats, **ids}).withColumn("event_date", F.to_date("event_time"))


def clean_events(
    df: DataFrame,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    time_format: str = TIME_FORMAT,
    required: list[str] | None = None,
) -> DataFrame:
    """Typed, filtered event log.

    * event_time -> UTC timestamp (``time_format`` or any ISO spelling), price -> double (bad values -> NULL)
    * rows lacking any required key are dropped
    * only the taxonomy's event types are kept
    * negative prices are dropped; a NULL price is kept and stays NULL
    * category / brand default to ``unknown``; ids become strings
    * ``event_date`` is the UTC date of the event

    All filters are bare column predicates, so Catalyst pushes the type and
    price filters into the parquet scan.
    """
    required = [c for c in (required or REQUIRED_KEYS) if c in df.columns]
    out = typed_events(df, time_format).dropna(subset=required)
    out = out.where(F.col("event_type").isin(taxonomy.event_types))
    out = out.where(F.col("price").isNull() | (F.col("price") >= 0))
    return defaulted(out)


def clean_events_counted(
    df: DataFrame,
    path: str,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    time_format: str = TIME_FORMAT,
    required: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``clean_events`` written to ``path`` in one scan of the log, with an account of every row.

    Returns the clean events, the rejected rows (as typed, with the column ``rule``) and the number of rows a rule has
    rejected (``kept``: those that none has). The counts are observed while the rows are written; a row counts for the first
    rule that it breaks, in the order of ``event_rules``. Rows are laid out by ``rule``, so reading either part prunes the other.
    """
    rules = event_rules(df, taxonomy, time_format, required)
    rule = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        rule = F.when(broken, F.lit(name)).otherwise(rule)
    typed = typed_events(df, time_format)
    typed = typed.withColumn("rule", F.coalesce(rule, F.lit("kept")))
    seen = Observation()
    counted = typed.observe(seen, *[F.count_if(F.col("rule") == name).alias(name) for name in [*rules, "kept"]])
    counted.write.mode("overwrite").partitionBy("rule").parquet(path)
    back = df.sparkSession.read.schema(counted.schema).parquet(path)
    return (defaulted(back.where(F.col("rule") == "kept").drop("rule")), back.where(F.col("rule") != "kept"),
            {k: int(v) for k, v in seen.get.items()})


def read_event_log(spark, path: str, fmt: str = "csv") -> DataFrame:
    """A raw event log (CSV or parquet, one file or several) read as text with a fixed schema and
    normalised headers; ``clean_events`` does the typed coercion. Rows of a CSV log carry their
    place in it (``with_log_order``), so that of events at one time the first in the log is
    first. A missing path raises Spark's own PATH_NOT_FOUND error."""
    from clickpath.schema import EVENT_SCHEMA
    from clickpath.sources.tables import null_tokens_to_null, with_log_order

    if fmt == "csv":
        df = with_log_order(spark.read.option("header", True).schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").csv(path))
    else:
        df = spark.read.parquet(path)
    return null_tokens_to_null(df.toDF(*[c.strip().lower() for c in df.columns]))
