"""Streams that account for every row: sessions by the batch rule, and days corrected by late rows.

``timed_sessions`` keeps users' open sessions as state (start, end and counts of each, no events), those of the users of one
hash together, so that a call of Python serves many users, and closes one when the
watermark has passed its end by the gap: no event that is not late could still reach it. A break is more than the gap, as in
``operators.sessionize``, and closed sessions are numbered on in time order, so keys equal those of the batch job.
Redelivered events are dropped by their id while the watermark may still let them in, which bounds that state, too.

``run_daily`` keeps a log of what has arrived beside the table of days. Each micro-batch adds its rows to the log and
recomputes the days that it has rows of, from the log, without repeats; other days are left as they are. A late row thus corrects its day,
however late it is, and is reported in a table of late rows. Each step overwrites what an earlier attempt at the same batch has
left, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickpath.context import checkpoint_dir, configure
from clickpath.functions.columns import EXACT, exact_sum
from clickpath.operators.sessionize import epoch_micros
from clickpath.schema import DEFAULT_TAXONOMY, Taxonomy

SUMS = ["event_count", "view_item_count", "add_to_cart_count", "purchase_count", "revenue_nano"]
_SESSION = ["start_us", "end_us", *SUMS]
_OUT = "user_id string, session long, " + ", ".join(f"{c} long" for c in _SESSION)
_STATE = "users array<string>, closed array<long>, owner array<long>, " + ", ".join(f"{c} array<long>" for c in _SESSION)
#: Groups of users that share a state; a stream keeps the number that it began with.
USER_GROUPS = 2048


def folded(rows: np.ndarray, gap: int) -> np.ndarray:
    """Sessions of rows (start, end, sums...) in any order: sorted, and joined where one starts at most ``gap`` after the
    end of all before it."""
    return folded_by(np.zeros(len(rows), np.int64), rows, gap)[1]


def folded_by(owner: np.ndarray, rows: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """``folded`` for the rows of each owner; returns owners and rows, sorted by owner and start."""
    if not len(rows):
        return owner, rows
    order = np.lexsort((rows[:, 0], owner))
    owner, rows = owner[order], rows[order]
    ends = pd.Series(rows[:, 1]).groupby(owner).cummax().to_numpy()
    opens = np.append(0, np.flatnonzero((owner[1:] != owner[:-1]) | (rows[1:, 0] - ends[:-1] > gap)) + 1)
    return owner[opens], np.column_stack([rows[opens, 0], np.maximum.reduceat(rows[:, 1], opens), np.add.reduceat(rows[:, 2:], opens, axis=0)])


def timed_sessions(events: DataFrame, gap_seconds: int, delay: str, taxonomy: Taxonomy = DEFAULT_TAXONOMY, groups: int = USER_GROUPS) -> DataFrame:
    """X2 by the rule of X1: one row per closed session of a stream of typed events with an ``event_id``.

    Revenue is summed in whole 1e-9 units, exact up to 9.2e9 a session.
    """
    t, gap = taxonomy, int(gap_seconds * 1_000_000)
    kind = lambda name: (F.col("event_type") == name).cast("long")
    nano = F.when(F.col("event_type") == t.purchase, F.col("price")).cast("double").try_cast(EXACT)
    rows = (events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
            .select("user_id", "event_time", epoch_micros(F.col("event_time")).alias("us"), kind(t.view).alias("view"), kind(t.cart).alias("cart"),
                    kind(t.purchase).alias("purchase"), F.coalesce((nano * 1_000_000_000).cast("long"), F.lit(0)).alias("nano")))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users, closed, owner, *held = state.get if state.exists else ([] for _ in range(3 + len(_SESSION)))
        users, closed, owner = np.array(users, object), np.array(closed, np.int64), np.array(owner, np.int64)
        sessions = np.array(held, np.int64).T.reshape(-1, len(_SESSION))
        if not state.hasTimedOut:
            for pdf in frames:  # a hot user's events come in bounded pieces
                new = np.column_stack([pdf["us"], pdf["us"], np.ones(len(pdf), np.int64), pdf["view"], pdf["cart"], pdf["purchase"], pdf["nano"]])
                codes, users = pd.factorize(np.append(users, pdf["user_id"].to_numpy(object)), use_na_sentinel=False)
                owner = np.append(owner, codes[len(closed):])  # those known before have the first codes, in their order
                closed = np.append(closed, np.zeros(len(users) - len(closed), np.int64))
                owner, sessions = folded_by(owner, np.concatenate([sessions, new.astype(np.int64)]), gap)
        passed = state.getCurrentWatermarkMs()
        done = sessions[:, 1] + gap <= passed * 1000  # an event that is not late is after the watermark
        out, of = sessions[done], owner[done]
        sessions, owner = sessions[~done], owner[~done]
        users = np.array([None if pd.isna(u) else u for u in users], object)
        frame = pd.DataFrame(out, columns=_SESSION)
        frame.insert(0, "session", closed[of] + np.arange(len(of)) - np.searchsorted(of, of))
        frame.insert(0, "user_id", users[of])
        if len(users):
            closed = closed + np.bincount(of, minlength=len(users))
            state.update((users.tolist(), closed.tolist(), owner.tolist(), *(sessions[:, c].tolist() for c in range(len(_SESSION)))))
        if len(sessions):
            state.setTimeoutTimestamp(max(passed + 1, math.floor((int(sessions[:, 1].min()) + gap) / 1000)))
        if len(out):
            yield frame

    grouped = rows.withColumn("user_group", F.pmod(F.xxhash64("user_id"), F.lit(groups)))
    found = grouped.groupBy("user_group").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: F.timestamp_micros(c)
    revenue = (F.col("revenue_nano").cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("double")
    return found.select(F.concat("user_id", F.lit("-"), F.col("session").cast("string")).alias("user_session"), "user_id",
                        time("start_us").alias("session_start"), time("end_us").alias("session_end"), *SUMS[:-1], revenue.alias("purchase_revenue_usd"))


def daily_totals(events: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Events, distinct users, per-type counts and revenue per UTC day (X3's columns) of a table of typed events."""
    t = taxonomy
    etype = F.col("event_type")
    return events.groupBy(F.to_date("event_time").alias("event_dt")).agg(
        F.count(F.lit(1)).alias("total_events"), F.count_distinct("user_id").alias("users"), F.count_if(etype == t.view).alias("page_views"),
        F.count_if(etype == t.cart).alias("add_to_cart_events"), F.count_if(etype == t.purchase).alias("purchase_events"),
        F.coalesce(exact_sum(F.when(etype == t.purchase, F.col("price"))), F.lit(0.0)).alias("purchase_revenue_usd"))


def run_daily(events: DataFrame, name: str, delay_seconds: int, root: str | None = None, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> dict[str, str]:
    """X3 with corrections: run a stream of typed events with an ``event_id`` over the files present now.

    Returns the folders of three tables: ``days`` (one row a day, always that of all rows which have arrived), ``late``
    (rows that were more than ``delay_seconds`` behind the latest event of the batches before) and ``log`` (all rows).
    With the same ``root`` and ``name`` it goes on from its checkpoint.
    """
    spark = configure(events.sparkSession)
    if root is None:
        root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{spark.sparkContext.applicationId}"
    base = f"{root.rstrip('/')}/{name}"
    out = {k: f"{base}/{k}" for k in ("days", "late", "log")}
    latest = F.max("event_time").alias("latest")
    schema = events.schema

    def arrive(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if batch.isEmpty():
            batch.agg(latest).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")
            return
        own = f"{out['log']}/batch={number}"
        batch.withColumn("event_date", F.to_date("event_time")).write.mode("overwrite").partitionBy("event_date").parquet(own)
        arrived = session.read.schema(schema.add("event_date", "date")).parquet(own)
        # one row a batch; those of later batches can only be left from an attempt that failed
        marks = session.read.schema("latest timestamp, batch long").option("basePath", f"{base}/marks")
        before = marks.parquet(f"{base}/marks/batch=*").where(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None
        if before is not None:
            behind = F.col("event_time") < F.lit(before) - F.make_dt_interval(secs=F.lit(delay_seconds))
            arrived.where(behind).drop("event_date").write.mode("overwrite").parquet(f"{out['late']}/batch={number}")
        days = [r["event_date"] for r in arrived.select("event_date").distinct().collect()]  # calendar days of one batch
        log = session.read.schema(schema.add("event_date", "date").add("batch", "long")).option("basePath", out["log"]).parquet(f"{out['log']}/batch=*")
        touched = log.where(F.col("event_date").isin(days) & (F.col("batch") <= number)).dropDuplicates(["event_id"])
        (daily_totals(touched, taxonomy).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("event_dt").parquet(out["days"]))
        arrived.agg(latest).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")

    query = (events.writeStream.foreachBatch(arrive).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return out
