"""Gap sessionization (X1): user + inactivity gap -> session key.

A new session starts when an event follows the user's previous event by more
than ``gap_seconds``; the session key is ``<user>-<n>`` where ``n`` counts the
gaps seen so far in the user's (time, event id) order.

Skew-safe plan: a plain ``Window.partitionBy(user).orderBy(time)`` sorts every
event of a user in one task, so a single hot user (say a third of all rows)
would sit in one task. Instead time is cut into buckets no wider than the gap.
Two events of one bucket are less than a gap apart, so a session can only
break *between* buckets, and the session number of an event depends only on
its bucket:

1. an aggregate gives each (user, bucket) its first (time, event id) and last time
   (map-side partial aggregation, one row per active bucket);
2. a window over those bucket rows (bounded by the user's active span / bucket
   width, not by its event count) marks buckets that open a session and
   numbers them;
3. one join back on (user, bucket) -- the only shuffle of the event rows, and one
   that adaptive execution may split, as no window needs its rows together --
   stamps the number on every event; the first event of each opening bucket
   (earliest time, then smallest event id) is flagged ``session_start``.

A log without event ids is ordered by a hash of its rows where times are equal. An event
that is delivered twice is flagged twice; ``session_features`` takes one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_US = 1_000_000


def epoch_micros(c: F.Column) -> F.Column:
    """Microseconds since the epoch of a UTC wall-clock timestamp (no time zone use)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def sessionize(
    df: DataFrame,
    user_col: str = "user_id",
    time_col: str = "event_time",
    order_col: str = "event_id",
    gap_seconds: int = 8 * 3600,
    bucket_seconds: int = 3600,
    out_col: str = "user_session",
    start_col: str = "session_start",
) -> DataFrame:
    """Adds ``out_col`` (session key) and ``start_col`` (1 on the first event of
    each session, else 0)."""
    gap = int(gap_seconds * _US)
    width = max(1, min(int(bucket_seconds * _US), gap))  # a bucket never spans a gap
    tie = F.col(order_col) if order_col in df.columns else F.xxhash64(*df.columns)
    ev = df.withColumn("_us", epoch_micros(F.col(time_col))).withColumn("_b", F.floor(F.col("_us") / width)).withColumn("_id", tie)

    buckets = ev.groupBy(user_col, "_b").agg(F.min(F.struct("_us", "_id")).alias("_head"), F.max("_us").alias("_last"))
    buckets = buckets.withColumn("_first", F.col("_head._us"))
    across = Window.partitionBy(user_col).orderBy("_b")
    prev_last = F.lag("_last").over(across)
    buckets = buckets.withColumn("_opens", (prev_last.isNull() | ((F.col("_first") - prev_last) > gap)).cast("int"))
    buckets = buckets.select(
        user_col, "_b", "_head", "_opens",
        (F.sum("_opens").over(across.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("_n"),
    )

    out = ev.join(buckets, [user_col, "_b"], "inner")
    starts = (F.col("_opens") == 1) & (F.struct("_us", "_id") == F.col("_head"))
    return out.withColumns({
        out_col: F.concat(F.col(user_col).cast("string"), F.lit("-"), F.col("_n").cast("bigint").cast("string")),
        start_col: starts.cast("int"),
    }).drop("_us", "_b", "_id", "_head", "_opens", "_n")
