"""Hypothesis tests against brute-force formulas, p-value tails and goldens."""

import math

import numpy as np
import pandas as pd
import pytest

from clickpath.functions import tails
from clickpath.operators import stats as ST


def brute_chi2(pdf, a, b):
    table = pd.crosstab(pdf[a], pdf[b]).to_numpy().astype(float)
    n = table.sum()
    e = np.outer(table.sum(1), table.sum(0)) / n
    dof = (table.shape[0] - 1) * (table.shape[1] - 1)
    o = table
    if dof == 1:
        d = e - o
        o = o + np.minimum(0.5, np.abs(d)) * np.sign(d)
    stat = ((o - e) ** 2 / e).sum()
    v = math.sqrt(stat / n / max(min(table.shape) - 1, 1))
    return stat, dof, v, int(n)


def _frame(spark, n=600, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "session_key": [f"s{i}" for i in range(n)],
        "cat": rng.choice(list("abcde"), size=n, p=[.4, .3, .2, .07, .03]),
        "two": rng.choice(["x", "y"], size=n),
        "y": rng.integers(0, 2, size=n),
        "m": np.round(rng.gamma(2.0, 3.0, size=n), 1),
        "d": rng.integers(0, 5, size=n),
    })
    # a sparse cell: category 'e' never has y == 1
    pdf.loc[pdf.cat == "e", "y"] = 0
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("a,b", [("cat", "y"), ("two", "y"), ("cat", "d")])
def test_chi_square_matches_full_grid(spark, a, b):
    pdf, df = _frame(spark)
    row = ST.chi_square(df, a, b, "h").first()
    stat, dof, v, n = brute_chi2(pdf, a, b)
    assert row.status == "completed"
    assert row.statistic == pytest.approx(stat, rel=1e-9)
    assert row.degrees_of_freedom == dof and row.n == n
    assert row.effect_size == pytest.approx(v, rel=1e-9)
    assert row.p_value == pytest.approx(tails.chi2_sf(stat, dof), rel=1e-9)


def test_chi_square_skip_contract(spark):
    pdf, df = _frame(spark)
    assert ST.chi_square(df.where("cat = 'a'"), "cat", "y", "h").first().status == "skipped"
    assert ST.chi_square(df, "missing_col", "y", "h").first().reason.startswith("Missing required columns")


def test_mann_whitney_matches_brute(spark):
    pdf, df = _frame(spark)
    row = ST.mann_whitney(df, "m", "y", "h").first()
    ranks = pdf.m.rank(method="average")
    r0 = ranks[pdf.y == 0].sum()
    n0, n1 = int((pdf.y == 0).sum()), int((pdf.y == 1).sum())
    u0 = r0 - n0 * (n0 + 1) / 2
    assert row.statistic == pytest.approx(u0, rel=1e-12)
    assert row.effect_size == pytest.approx(2 * u0 / (n0 * n1) - 1, rel=1e-9)
    assert row.group_0_median == pytest.approx(pdf.m[pdf.y == 0].median())
    assert row.group_1_median == pytest.approx(pdf.m[pdf.y == 1].median())
    assert 0 <= row.p_value <= 1


def test_mann_whitney_small_groups(spark):
    import pandas as pd
    pdf = pd.DataFrame({"m": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0], "y": [0, 0, 0, 0, 1, 1, 1, 1, 1]})
    assert ST.mann_whitney(spark.createDataFrame(pdf), "m", "y", "h").first().status == "skipped"  # sizes 4 and 5
    pdf = pd.DataFrame({"m": [float(x) for x in range(10)], "y": [0] * 5 + [1] * 5})
    row = ST.mann_whitney(spark.createDataFrame(pdf), "m", "y", "h").first()
    assert row.statistic == 0.0
    # normal tail with continuity correction: U = 25, mean 12.5, variance 25 * 11 / 12
    assert row.p_value == pytest.approx(2 * tails.norm_sf(12 / math.sqrt(25 * 11 / 12)))
    # the exact distribution on demand: 2 / C(10, 5) for complete separation
    assert tails.mwu_p(0.0, 5, 5, 0.0, method="exact")[0] == pytest.approx(2 / math.comb(10, 5))
    with pytest.raises(ValueError):
        tails.mwu_p(0.0, 8, 10 ** 9, 0.0, method="exact")


def test_kruskal_matches_formula(spark):
    pdf, df = _frame(spark)
    row = ST.kruskal(df, "cat", "m", "h").first()
    keep = pdf.groupby("cat").m.transform("size") >= 5
    sub = pdf[keep]
    r = sub.m.rank(method="average")
    n = len(sub)
    s = sum(r[sub.cat == c].sum() ** 2 / (sub.cat == c).sum() for c in sub.cat.unique())
    h = 12 / (n * (n + 1)) * s - 3 * (n + 1)
    t = sub.m.value_counts().to_numpy().astype(float)
    h /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    k = sub.cat.nunique()
    assert row.statistic == pytest.approx(h, rel=1e-9)
    assert row.groups == k and row.effect_size == pytest.approx((h - k + 1) / (n - k), rel=1e-9)


def test_kruskal_identical_values_is_skipped(spark):
    pdf = pd.DataFrame({"c": ["a"] * 6 + ["b"] * 6, "v": [1.0] * 12})
    assert ST.kruskal(spark.createDataFrame(pdf), "c", "v", "h").first().status == "skipped"


def test_spearman_matches_pandas(spark):
    pdf, df = _frame(spark)
    row = ST.spearman(df, "m", "d", "h").first()
    rho = pdf.m.rank().corr(pdf.d.rank())
    assert row.statistic == pytest.approx(rho, rel=1e-9)
    small = spark.createDataFrame(pdf.head(9))
    assert ST.spearman(small, "m", "d", "h").first().status == "skipped"  # n = 9


def test_tails_known_values():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert tails.norm_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-9)
    assert tails.t_two_sided(2.228138851986274, 10) == pytest.approx(0.05, rel=1e-8)
    assert tails.chi2_sf(5054.274825425806, 20) == 0.0


def test_goldens_from_published_outputs():
    # FIXTURES.md section 4: the report of the published confusion counts
    from clickpath.operators.model import _report
    import json
    rep = json.loads(_report(109918, 6596, 278, 5808))
    assert rep["accuracy"] == pytest.approx(0.943931484502447, rel=1e-12)
    assert rep["1"]["precision"] == pytest.approx(0.46823605288616577, rel=1e-12)
    assert rep["1"]["recall"] == pytest.approx(0.954321393361814, rel=1e-12)
    assert rep["1"]["f1-score"] == pytest.approx(0.6282314764737696, rel=1e-12)


def test_mwu_exact_distribution_sums_to_one():
    for m, n in [(3, 4), (5, 8), (8, 8)]:
        assert tails.mwu_exact_sf(0, m, n) == pytest.approx(1.0)
        assert tails.mwu_exact_sf(m * n, m, n) == pytest.approx(1 / math.comb(m + n, m))


def test_mwu_normal_tail_golden():
    # FIXTURES.md section 4: tie-free normal p of the published U with the first group pair
    p, method = tails.mwu_p(5301748831.5, 466054, 24344, 0.0)
    assert method == "asymptotic"
    assert p == pytest.approx(1.51655e-66, rel=1e-5)


def test_tails_against_other_forms():
    # Poisson form of an even chi-square, symmetric limits of t, and large degrees of freedom
    assert tails.chi2_sf(9.0, 4) == pytest.approx(math.exp(-4.5) * 5.5, rel=1e-12)
    assert tails.chi2_sf(0.0, 3) == 1.0
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-9)
    assert tails.t_two_sided(1.0, 2) == pytest.approx(1 - 1 / math.sqrt(3), rel=1e-9)
    for t in (1e-5, 0.5, 1.96, 6.0):
        assert tails.t_two_sided(t, 1e9) == pytest.approx(2 * tails.norm_sf(t), rel=1e-6)
    a, b = tails.chi2_sf(100_100, 100_000), tails.chi2_sf(100_100, 100_001)
    assert a == pytest.approx(b, rel=1e-2) and a < b


def test_normality_suite_matches_brute_force(spark):
    from statistics import NormalDist

    from clickpath.plans.pipeline import pipeline

    sessions = pipeline(spark, "/root/testdata/sf0.001").sessions
    got = ST.normality_suite(sessions).collect()
    assert len(got) == 2 * len(ST.NORMALITY_SUITE)
    pdf = sessions.toPandas()
    for row in got:
        group_col = next(g for m, g, _ in ST.NORMALITY_SUITE if m == row.metric)
        v = pdf[(pdf[group_col].astype(str) == row.group) & pdf[row.metric].notna()][row.metric].astype(float)
        z = ((v.rank(method="average") - 0.375) / (len(v) + 0.25)).map(NormalDist().inv_cdf)
        assert row.n == len(v)
        assert row.statistic == pytest.approx(np.corrcoef(v, z)[0, 1] ** 2, abs=1e-7)
        d = v - v.mean()
        assert row.skewness == pytest.approx((d ** 3).mean() / (d ** 2).mean() ** 1.5, rel=1e-9)
        assert row.kurtosis == pytest.approx((d ** 4).mean() / (d ** 2).mean() ** 2 - 3, rel=1e-9)


def test_normality_tells_normal_from_skewed(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": np.r_[rng.normal(size=800), rng.exponential(size=800), np.ones(5), [1.0, 2.0]],
                        "g": ["n"] * 800 + ["x"] * 800 + ["flat"] * 5 + ["few"] * 2})
    rows = {r.group: r for r in ST.normality_suite(spark.createDataFrame(pdf), [("a", "g", "label")]).collect()}
    assert rows["n"].interpretation == "normal-like" and rows["n"].statistic > 0.99
    assert rows["x"].interpretation == "non-normal" and rows["x"].p_value < 1e-6
    assert (rows["flat"].reason, rows["few"].reason) == ("All values are identical.", "Fewer than 3 observations.")


def test_chi_square_margins_multiply_as_doubles(spark):
    """Cells of two billion sessions: margins whose product passes a long."""
    cells = spark.createDataFrame([("a", "0", 2_000_000_000), ("a", "1", 2_100_000_000), ("b", "0", 2_200_000_000), ("b", "1", 2_000_000_000)],
                                  "_a string, _b string, _o long")
    from pyspark.sql import functions as F
    r, c = cells.groupBy("_a").agg(F.sum("_o").alias("_r")), cells.groupBy("_b").agg(F.sum("_o").alias("_c"))
    e = F.col("_r").cast("double") * F.col("_c").cast("double") / F.lit(8.3e9)
    assert cells.join(r, "_a").join(c, "_b").select(F.sum(e)).first()[0] == pytest.approx(8.3e9)
