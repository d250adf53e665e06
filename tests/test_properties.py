"""Property checks (hypothesis): rank sums, U0 + U1 = n0 n1, order invariance."""

import pandas as pd
from hypothesis import given, settings, strategies as st

from clickpath.operators import stats as ST
from clickpath.operators.ranks import average_rank, rank_histogram

values = st.lists(st.integers(min_value=0, max_value=6), min_size=12, max_size=60)


@settings(max_examples=8, deadline=None)
@given(values)
def test_rank_sum_is_triangular(spark, xs):
    df = spark.createDataFrame(pd.DataFrame({"v": [float(x) for x in xs]}))
    r = rank_histogram(df, "v", buckets=4).select(average_rank("cnt").alias("r"), "cnt")
    total = sum(row.r * row.cnt for row in r.collect())
    n = len(xs)
    assert abs(total - n * (n + 1) / 2) < 1e-9


@settings(max_examples=6, deadline=None)
@given(values, st.randoms(use_true_random=False))
def test_mwu_symmetry_and_order_invariance(spark, xs, rnd):
    n = len(xs)
    g = [i % 2 for i in range(n)]
    pdf = pd.DataFrame({"m": [float(x) for x in xs], "y": g})
    a = ST.mann_whitney(spark.createDataFrame(pdf), "m", "y", "h").first()
    flipped = ST.mann_whitney(spark.createDataFrame(pdf.assign(y=1 - pdf.y)), "m", "y", "h").first()
    n0, n1 = g.count(0), g.count(1)
    assert abs(a.statistic + flipped.statistic - n0 * n1) < 1e-9
    shuffled = pdf.sample(frac=1.0, random_state=rnd.randint(0, 10_000))
    b = ST.mann_whitney(spark.createDataFrame(shuffled), "m", "y", "h").first()
    assert abs(a.statistic - b.statistic) < 1e-9 and abs(a.p_value - b.p_value) < 1e-12


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 1)), min_size=20, max_size=80),
       st.randoms(use_true_random=False))
def test_chi_square_order_invariant(spark, rows, rnd):
    pdf = pd.DataFrame(rows, columns=["c", "y"])
    a = ST.chi_square(spark.createDataFrame(pdf), "c", "y", "h").first()
    b = ST.chi_square(spark.createDataFrame(pdf.sample(frac=1.0, random_state=rnd.randint(0, 10_000))), "c", "y", "h").first()
    assert a.status == b.status
    if a.status == "completed":
        assert abs(a.statistic - b.statistic) < 1e-9
