"""Streams that account for every row, against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from clickpath.streaming import jobs as SJ
from clickpath.streaming import stateful as ST

GAP = 3600
T0 = datetime(2024, 1, 1)


def plain_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_folding_in_any_order(seed):
    rng = random.Random(seed)
    times = [rng.randrange(0, 3000) for _ in range(200)]
    held = np.zeros((0, 3), np.int64)
    rng.shuffle(times)
    for k in range(0, 200, 37):
        part = np.array([(t, t, 1) for t in times[k:k + 37]], np.int64)
        held = ST.folded(np.concatenate([held, part]), 20)
    assert [tuple(r) for r in held.tolist()] == plain_sessions(times, 20)


@pytest.mark.parametrize("seed", range(3))
def test_users_folded_together(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(5), rng.randrange(0, 3000)) for _ in range(200)]
    owner, held = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    for k in range(0, 200, 37):
        part = rows[k:k + 37]
        owner, held = ST.folded_by(np.append(owner, [u for u, _ in part]), np.concatenate([held, np.array([(t, t, 1) for _, t in part], np.int64)]), 20)
    assert [(int(u), *r) for u, r in zip(owner, held.tolist())] == [
        (u, *r) for u in range(5) for r in plain_sessions([t for v, t in rows if v == u], 20)]


def test_users_share_a_state(spark, tmp_path):
    """Users of one group are numbered apart, over restarts; the number of states is bounded, whatever the number of users."""
    log, root = str(tmp_path / "log"), str(tmp_path / "s")

    def run(groups):
        stream = ST.timed_sessions(SJ.stream_events(spark, log), GAP, "30 minutes", groups=groups)
        rows = spark.read.parquet(SJ.run_to_table(stream, f"t{groups}", root)).collect()
        return sorted((r.user_session, r.event_count, (r.session_end - r.session_start).total_seconds() / 60) for r in rows)

    deliver(spark, log, [event(u, u, user=u) for u in range(20)] + [event(100, 50, user=3), event(101, 300, user=5)])
    run(1), run(7)
    deliver(spark, log, [event(102, 310, user=5), event(103, 320, user=3), event(104, 900, user=1), event(105, 1500, user=2)])
    wanted = sorted([(f"{u}-0", 1 + (u == 3), 47.0 if u == 3 else 0.0) for u in range(20)]
                    + [("5-1", 2, 10.0), ("3-1", 1, 0.0), ("1-1", 1, 0.0)])
    assert run(1) == run(7) == wanted


def deliver(spark, log, rows):
    spark.createDataFrame(rows, SJ.RAW_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(log)


def event(k, minutes, user=1, kind="view", price=1.0):
    return (k, T0 + timedelta(minutes=minutes), user, kind, price, '{"k": 5}')


def test_sessions_by_the_batch_rule(spark, tmp_path):
    """A gap of exactly the limit does not break; keys go on over restarts; repeats count once; a late row opens nothing."""
    log, root = str(tmp_path / "log"), str(tmp_path / "s")

    def run():
        stream = ST.timed_sessions(SJ.stream_events(spark, log), GAP, "30 minutes")
        rows = spark.read.parquet(SJ.run_to_table(stream, "t", root)).collect()
        return sorted((r.user_session, r.event_count, r.purchase_count, r.purchase_revenue_usd,
                       (r.session_end - r.session_start).total_seconds() / 60) for r in rows)

    deliver(spark, log, [event(1, 0), event(2, 60), event(3, 121, kind="purchase", price=2.5), event(4, 130), event(1, 0), event(9, 0, user=2)])
    run()
    deliver(spark, log, [event(4, 130), event(5, 125, kind="purchase", price=0.1), event(6, 400), event(7, 10)])  # 7 is late
    first = run()
    assert ("1-0", 2, 0, 0.0, 60.0) in first and ("2-0", 1, 0, 0.0, 0.0) in first
    deliver(spark, log, [event(8, 900), event(10, 901, user=2)])
    assert run() == [("1-0", 2, 0, 0.0, 60.0), ("1-1", 3, 2, 2.6, 9.0), ("1-2", 1, 0, 0.0, 0.0), ("2-0", 1, 0, 0.0, 0.0)]


def test_days_with_corrections(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "d")
    run = lambda: ST.run_daily(SJ.stream_events(spark, log), "d", 3600, root)
    day = lambda out: {str(r.event_dt): (r.total_events, r.users, r.purchase_revenue_usd)
                       for r in spark.read.parquet(out["days"]).collect()}
    deliver(spark, log, [event(1, 0), event(2, 1500, user=2, kind="purchase", price=3.5)])
    assert day(run()) == {"2024-01-01": (1, 1, 0.0), "2024-01-02": (1, 1, 3.5)}
    deliver(spark, log, [event(1, 0), event(3, 30, user=3), event(4, 1490, user=2)])  # a repeat, a late row, one in time
    out = run()
    assert day(out) == {"2024-01-01": (2, 2, 0.0), "2024-01-02": (2, 1, 3.5)}
    assert sorted(r.event_id for r in spark.read.parquet(out["late"]).collect()) == [1, 3]
    assert day(run()) == day(out)  # nothing new, nothing changed
    # a batch that is repeated after a failure finds its own rows and overwrites them
    assert spark.read.parquet(out["log"]).count() == 5
