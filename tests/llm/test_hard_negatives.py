"""Operator 13 against its SQL and a plain version."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from clickpath.llm import hard_negatives as hn
from clickpath.llm import queries, sql

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<float>, id string, score double"


def plain(rows):
    """Rows (id, label, vector) by the definition."""
    part = [(i, x, [math.floor(256 * c) for c in e]) for i, x, e in rows
            if i is not None and x is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for i, x, e in {(i, x, tuple(e)) for i, x, e in part if i % 100 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(e, f)), j, y) for j, y, f in part if j != i))
        for ps, j, _ in [r for r in scored if r[2] == x][:5]:
            some = [r for r in scored if r[2] != x and 30 * -ps <= 100 * -r[0] <= 90 * -ps][:10]
            out += [(i, j, n + 1, k, -ps, -s) for n, (s, k, _) in enumerate(some)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, x, e, "clash", 0.0) for i, x, e in rows], SCHEMA).repartition(5)
    got = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), **options)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql.HARD_NEGATIVES})").fetchall()
    got = [tuple(r) for r in queries.op13_hard_negatives(spark, f"/root/testdata/{sf}").select(*COLUMNS).collect()]
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("blocks", [(4096, 16384, 1 << 21), (16, 3, 50)])
def test_ties_hot_labels_and_small_blocks(spark, monkeypatch, blocks):
    for name, value in zip(("CELL", "GROUP", "BLOCK_SCORES"), blocks):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(5)
    rows = []
    for k in range(400):
        # coarse components make ties; a third of all rows has one label and one vector
        hot = k % 3 == 0
        e = [0.5] * 4 if hot else [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]
        rows.append((k * 25, 1 if hot else rng.randint(0, 4), e))
    rows += rows[:8] + [(100, 3, [1.0, 1.0, 0.0, 0.0])]  # repeated rows, an anchor with two vectors
    assert mined(spark, rows) == plain(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 1, [-1.0, 0.0]), (3, 2, [0.5, 0.0]), (4, 2, [0.95, 0.0]), (5, None, [0.5, 0.0]),
            (6, 2, None), (7, 2, [nan, 0.0]), (8, 2, [inf, 0.0]), (9, 2, [None, 0.5]), (None, 2, [0.5, 0.0]), (100, 3, [1.0, 1.0]),
            (200, 1, []), (10, 2, [0.4]), (300, 9, [1.0, 1.0, 1.0]), (-100, 2, [0.3, 0.3]), (11, 2, [0.3, 0.0, 5.0])]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []


def test_scores_beyond_exact_floats():
    import numpy as np

    a, b = np.array([[2 ** 30 + 1, 3]]), np.array([[2 ** 30 + 1, 1]])
    assert hn.scores_of(a, b).tolist() == [[(2 ** 30 + 1) ** 2 + 3]]
