"""Hypothesis tests as Spark jobs.

Every test reduces the session table to ONE result row with distributed
aggregates; only that row's numbers go through a scalar finisher (a pandas UDF
for the p-value). Rank statistics read ``ranks.rank_histogram``, so no step
sorts all rows in one partition. A missing column, too little variation or too
few rows gives a ``skipped`` row with a reason, never an exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from clickpath.functions.tails import chi2_sf_udf, francia_p_udf, mwu_p_udf, normal_quantile_sql, t_two_sided_udf
from clickpath.operators.ranks import average_rank, rank_histogram

RESULT_SCHEMA = T.StructType([
    T.StructField("test", T.StringType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("statistic", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("degrees_of_freedom", T.DoubleType()),
    T.StructField("effect_size", T.DoubleType()),
    T.StructField("effect_size_name", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("group_0_median", T.DoubleType()),
    T.StructField("group_1_median", T.DoubleType()),
    T.StructField("groups", T.LongType()),
])
RESULT_COLUMNS = [f.name for f in RESULT_SCHEMA.fields]


def _null(name: str) -> F.Column:
    return F.lit(None).cast(RESULT_SCHEMA[name].dataType).alias(name)


def _finish(row: DataFrame, values: dict) -> DataFrame:
    """Project aggregate rows onto the fixed result schema (plus the test id)."""
    cols = []
    for f in RESULT_SCHEMA.fields:
        cols.append(values[f.name].cast(f.dataType).alias(f.name) if f.name in values else _null(f.name))
    if "_t" in values:
        cols.append(values["_t"].alias("_t"))
    return row.select(*cols)


def skipped(spark, test: str, hypothesis: str, reason: str) -> DataFrame:
    row = {c: None for c in RESULT_COLUMNS}
    row.update(test=test, hypothesis=hypothesis, status="skipped", reason=reason)
    return spark.createDataFrame([row], RESULT_SCHEMA)


def _missing(df: DataFrame, cols: list[str]) -> bool:
    return any(c not in df.columns for c in cols)


# ---------------------------------------------------------------------------
# Batched test families. A "spec" is (column a, column b, filter flag or None,
# hypothesis). All specs of one family run as ONE job: the session table is
# melted to (test id, a, b) rows -- one scan, partial aggregation keyed by the
# test id absorbs the row expansion -- and every aggregate is grouped by the
# test id, so k tests cost one pass and one set of shuffles.
# ---------------------------------------------------------------------------
def _melt(df: DataFrame, specs: list[tuple], a_type: str, b_type: str) -> DataFrame:
    rows = []
    for i, (a, b, where, _) in enumerate(specs):
        keep = (F.col(where) == 1) if where else F.lit(True)
        rows.append(F.struct(F.lit(i).alias("_t"), F.col(a).cast(a_type).alias("_a"),
                             F.col(b).cast(b_type).alias("_b"), keep.alias("_keep")))
    melted = df.select(F.explode(F.array(*rows)).alias("_m")).select("_m.*")
    return melted.where(F.col("_keep") & F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_keep")


def _labels(specs: list[tuple], test: str) -> dict:
    hyp = F.create_map(*[x for i, sp in enumerate(specs) for x in (F.lit(i), F.lit(sp[3]))])
    return {"test": F.lit(test), "hypothesis": hyp[F.col("_t")]}


def _run_family(df: DataFrame, specs: list[tuple], test: str, runner) -> DataFrame:
    """Skipped rows for specs with missing columns; one batched job for the rest."""
    spark = df.sparkSession
    present = [(i, sp) for i, sp in enumerate(specs) if not _missing(df, [sp[0], sp[1]])]
    parts = []
    for i, sp in enumerate(specs):
        if _missing(df, [sp[0], sp[1]]):
            parts.append(skipped(spark, test, sp[3], f"Missing required columns: {sp[0]}, {sp[1]}.")
                         .withColumn("_t", F.lit(i)))
    if present:
        idx = [i for i, _ in present]
        out = runner(df, [sp for _, sp in present])
        remap = F.create_map(*[x for j, i in enumerate(idx) for x in (F.lit(j), F.lit(i))])
        parts.append(out.withColumn("_t", remap[F.col("_t")]))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def _chi2_batch(df: DataFrame, specs: list[tuple]) -> DataFrame:
    """Pearson chi-square per test (Yates-corrected when dof = 1), with Cramer's V.

    The contingency table is never materialised as a full grid: with expected
    counts e = r_i c_j / n, the sum over all cells of (o - e)^2 / e equals the sum
    over observed cells plus (n - sum of observed e), because an empty cell
    contributes exactly its e. For the 2x2 Yates case the four expected counts
    follow from the two row and two column totals.
    """
    sub = _melt(df, specs, "string", "string")
    cells = sub.groupBy("_t", "_a", "_b").agg(F.count(F.lit(1)).alias("_o"))
    rows = cells.groupBy("_t", "_a").agg(F.sum("_o").alias("_r"))
    cols = cells.groupBy("_t", "_b").agg(F.sum("_o").alias("_c"))
    tot = cells.groupBy("_t").agg(F.sum("_o").alias("_n"))
    j = cells.join(rows, ["_t", "_a"]).join(cols, ["_t", "_b"]).join(tot, "_t")
    e = F.col("_r").cast("double") * F.col("_c").cast("double") / F.col("_n").cast("double")
    o = F.col("_o").cast("double")
    diff = e - o
    yates_o = o + F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)

    def g_zero(ex):  # Yates term of an empty cell
        return F.pow(F.greatest(ex - 0.5, F.lit(0.0)), 2) / ex

    agg = j.groupBy("_t").agg(
        F.sum("_o").alias("n"),
        F.count_distinct("_a").alias("r"),
        F.count_distinct("_b").alias("k"),
        F.sum(F.pow(o - e, 2) / e).alias("s_plain"),
        F.sum(e).alias("s_e"),
        F.sum(F.pow(yates_o - e, 2) / e).alias("s_yates"),
        F.sum(g_zero(e)).alias("s_gobs"),
        F.min("_r").alias("r1"), F.max("_r").alias("r2"), F.min("_c").alias("c1"), F.max("_c").alias("c2"),
    )
    agg = _complete(df, agg, len(specs))
    n = F.col("n").cast("double")
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    grid = [(a, b) for a in ("r1", "r2") for b in ("c1", "c2")]
    g_all = sum(g_zero(F.col(a).cast("double") * F.col(b).cast("double") / n) for a, b in grid)
    stat = F.when(dof == 1, F.col("s_yates") + (g_all - F.col("s_gobs"))).otherwise(F.col("s_plain") + (n - F.col("s_e")))
    ok = F.coalesce((F.col("r") >= 2) & (F.col("k") >= 2), F.lit(False))
    v = F.sqrt(stat / n / F.greatest(F.least(F.col("r") - 1, F.col("k") - 1), F.lit(1)))
    return _finish(agg, {
        **_labels(specs, "Chi-square"), "_t": F.col("_t"),
        "status": F.when(ok, "completed").otherwise("skipped"),
        "reason": F.when(ok, None).otherwise(F.lit("Not enough category/outcome variation.")),
        "statistic": F.when(ok, stat), "p_value": F.when(ok, chi2_sf_udf(stat, dof.cast("double"))),
        "degrees_of_freedom": F.when(ok, dof), "effect_size": F.when(ok, v),
        "effect_size_name": F.when(ok, F.lit("Cramer's V")), "n": F.when(ok, F.col("n")),
    })


def _complete(df: DataFrame, agg: DataFrame, count: int) -> DataFrame:
    """One row per test id even when a test kept no rows (an empty test is skipped)."""
    ids = df.sparkSession.range(count).select(F.col("id").cast("int").alias("_t"))
    return ids.join(agg, "_t", "left")


def _median_pick(count: str, value: str) -> tuple[F.Column, F.Column, F.Column]:
    total = F.col(f"total_{count}").cast("double")
    before, n = F.col(f"before_{count}"), F.col(count)
    pos = (total - 1) * 0.5
    lo, hi = F.floor(pos), F.ceil(pos)
    v = F.col(value).cast("double")
    return (F.max(F.when((before <= lo) & (lo < before + n), v)), F.max(F.when((before <= hi) & (hi < before + n), v)),
            F.max(pos))


def _interp(lo: str, hi: str, pos: str) -> F.Column:
    p = F.col(pos)
    return F.when(F.floor(p) == F.ceil(p), F.col(lo)).otherwise(
        (F.ceil(p) - p) * F.col(lo) + (p - F.floor(p)) * F.col(hi))


def _mwu_batch(df: DataFrame, specs: list[tuple]) -> DataFrame:
    """Mann-Whitney U of group 0 (two-sided p), rank-biserial correlation and
    both group medians, all from one rank histogram per test."""
    sub = _melt(df, specs, "double", "double").where(F.col("_b").isin(0, 1))
    ranked = rank_histogram(sub, "_a", by=["_t"], bounds_by="_t", counts={
        "cnt": F.count(F.lit(1)), "c0": F.count_if(F.col("_b") == 0), "c1": F.count_if(F.col("_b") == 1),
    })
    lo0, hi0, pos0 = _median_pick("c0", "_a")
    lo1, hi1, pos1 = _median_pick("c1", "_a")
    agg = ranked.groupBy("_t").agg(
        F.max("total_c0").alias("n0"), F.max("total_c1").alias("n1"),
        F.sum(F.col("c0") * average_rank("cnt")).alias("r0"),
        F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("tie"),
        lo0.alias("lo0"), hi0.alias("hi0"), pos0.alias("pos0"), lo1.alias("lo1"), hi1.alias("hi1"), pos1.alias("pos1"),
    )
    agg = _complete(df, agg, len(specs)).fillna(0, subset=["n0", "n1"]).fillna(0.0, subset=["tie"])
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    u0 = F.col("r0") - n0 * (n0 + 1) / 2
    ok = (F.col("n0") >= 5) & (F.col("n1") >= 5)
    return _finish(agg, {
        **_labels(specs, "Mann-Whitney U"), "_t": F.col("_t"),
        "status": F.when(ok, "completed").otherwise("skipped"),
        "reason": F.when(ok, None).otherwise(F.lit("Not enough observations in both groups.")),
        "statistic": F.when(ok, u0), "p_value": F.when(ok, mwu_p_udf(u0, n0, n1, F.col("tie"))),
        "effect_size": F.when(ok, 2 * u0 / (n0 * n1) - 1),
        "effect_size_name": F.when(ok, F.lit("Rank-biserial correlation")),
        "n": F.when(ok, F.col("n0") + F.col("n1")),
        "group_0_median": F.when(ok, _interp("lo0", "hi0", "pos0")),
        "group_1_median": F.when(ok, _interp("lo1", "hi1", "pos1")),
    })


def _kw_batch(df: DataFrame, specs: list[tuple], min_group: int = 5) -> DataFrame:
    """Kruskal-Wallis H (tie-corrected) over groups with at least ``min_group`` rows."""
    sub = _melt(df, specs, "string", "double")
    # everything below reads (value, group) cells, never the melted rows
    cells = sub.groupBy("_t", "_b", "_a").agg(F.count(F.lit(1)).alias("_c"))
    sizes = cells.groupBy("_t", "_a").agg(F.sum("_c").alias("_n")).where(F.col("_n") >= min_group)
    cells = cells.join(sizes.select("_t", "_a"), ["_t", "_a"], "left_semi")
    ranked = rank_histogram(cells, "_b", by=["_t"], bounds_by="_t", counts={"cnt": F.sum("_c")}).select(
        "_t", "_b", average_rank("cnt").alias("_rank"), F.col("cnt").alias("_tv"))
    tv = F.col("_tv").cast("double")
    # tie term sum_v (t^3 - t) spread over the (value, group) cells: c * (t^2 - 1)
    rsum = cells.join(ranked, ["_t", "_b"]).groupBy("_t", "_a").agg(
        F.sum(F.col("_c") * F.col("_rank")).alias("_R"), F.sum("_c").alias("_nc"),
        F.sum(F.col("_c") * (tv * tv - 1)).alias("_tie"))
    agg = rsum.groupBy("_t").agg(F.sum(F.col("_R") * F.col("_R") / F.col("_nc")).alias("s"),
                                  F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k"),
                                  F.sum("_tie").alias("tie"))
    agg = _complete(df, agg, len(specs)).fillna(0, subset=["k"]).fillna(0.0, subset=["tie"])
    n = F.col("n").cast("double")
    k = F.col("k").cast("double")
    corr = F.lit(1.0) - F.try_divide(F.col("tie"), n * n * n - n)
    # UDF arguments are evaluated for every row, so no division may fail here
    h = F.try_divide(F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("s") - 3 * (n + 1), corr)
    enough = F.col("k") >= 2
    ok = enough & F.coalesce(corr > 0, F.lit(False))
    reason = F.when(~enough, F.lit("Not enough groups with sufficient observations.")).when(
        ~ok, F.lit("All numbers are identical."))
    return _finish(agg, {
        **_labels(specs, "Kruskal-Wallis"), "_t": F.col("_t"),
        "status": F.when(ok, "completed").otherwise("skipped"), "reason": F.when(ok, None).otherwise(reason),
        "statistic": F.when(ok, h), "p_value": F.when(ok, chi2_sf_udf(h, k - 1)),
        "degrees_of_freedom": F.when(ok, k - 1),
        "effect_size": F.when(ok & (n > k), (h - k + 1) / (n - k)),
        "effect_size_name": F.when(ok, F.lit("Epsilon squared")), "n": F.when(ok, F.col("n")),
        "groups": F.when(ok, F.col("k")),
    })


def _spearman_batch(df: DataFrame, specs: list[tuple], min_rows: int = 10) -> DataFrame:
    """Pearson correlation of mid-ranks, from a joint (x, y) histogram and the
    two marginal rank histograms; sums are centred on the known mean rank."""
    sub = _melt(df, specs, "double", "double")
    joint = sub.groupBy("_t", "_a", "_b").agg(F.count(F.lit(1)).alias("_w"))
    rx = rank_histogram(joint, "_a", by=["_t"], bounds_by="_t", counts={"cnt": F.sum("_w")}).select(
        "_t", "_a", average_rank("cnt").alias("_rx"), F.col("total_cnt").alias("_n"))
    ry = rank_histogram(joint, "_b", by=["_t"], bounds_by="_t", counts={"cnt": F.sum("_w")}).select(
        "_t", "_b", average_rank("cnt").alias("_ry"))
    j = joint.join(rx, ["_t", "_a"]).join(ry, ["_t", "_b"])
    mean_rank = (F.col("_n").cast("double") + 1) / 2
    dx, dy, w = F.col("_rx") - mean_rank, F.col("_ry") - mean_rank, F.col("_w").cast("double")
    agg = j.groupBy("_t").agg(F.sum("_w").alias("n"), F.sum(w * dx * dy).alias("sxy"),
                              F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"))
    agg = _complete(df, agg, len(specs)).fillna(0, subset=["n"])
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    rho = F.when(rho > 1.0, 1.0).when(rho < -1.0, -1.0).otherwise(rho)
    n = F.col("n").cast("double")
    dof = n - 2
    t = F.when(F.abs(rho) >= 1.0, F.signum(rho) * float("inf")).otherwise(rho * F.sqrt(dof / ((1 - rho) * (1 + rho))))
    ok = F.col("n") >= min_rows
    return _finish(agg, {
        **_labels(specs, "Spearman correlation"), "_t": F.col("_t"),
        "status": F.when(ok, "completed").otherwise("skipped"),
        "reason": F.when(ok, None).otherwise(F.lit("Not enough observations.")),
        "statistic": F.when(ok, rho), "p_value": F.when(ok, t_two_sided_udf(t, dof)),
        "effect_size": F.when(ok, rho), "effect_size_name": F.when(ok, F.lit("Spearman rho")),
        "n": F.when(ok, F.col("n")),
    })


_FAMILIES = {
    "chi2": ("Chi-square", _chi2_batch),
    "mwu": ("Mann-Whitney U", _mwu_batch),
    "kw": ("Kruskal-Wallis", _kw_batch),
    "spearman": ("Spearman correlation", _spearman_batch),
}


# Per family, the reason of a test with too little variation and the name of its effect size.
TWIN_LABELS = {
    "chi2": ("Not enough category/outcome variation.", "Cramer''s V"),
    "mwu": ("Not enough observations in both groups.", "Rank-biserial correlation"),
    "kw": ("Not enough groups with sufficient observations.", "Epsilon squared"),
    "spearman": ("Not enough observations.", "Spearman rho"),
}


def run_family(df: DataFrame, kind: str, specs: list[tuple]) -> DataFrame:
    """Result rows (with test id ``_t`` = position in ``specs``) for one test family."""
    test, runner = _FAMILIES[kind]
    return _run_family(df, specs, test, runner)


def _single(df: DataFrame, kind: str, a: str, b: str, hypothesis: str) -> DataFrame:
    return run_family(df, kind, [(a, b, None, hypothesis)]).drop("_t")


def chi_square(df: DataFrame, category: str, outcome: str, hypothesis: str) -> DataFrame:
    """Chi-square independence test with Cramer's V (one result row)."""
    return _single(df, "chi2", category, outcome, hypothesis)


def mann_whitney(df: DataFrame, metric: str, outcome: str, hypothesis: str) -> DataFrame:
    """Two-sided Mann-Whitney U of group 0 vs group 1 of ``outcome``."""
    return _single(df, "mwu", metric, outcome, hypothesis)


def kruskal(df: DataFrame, category: str, metric: str, hypothesis: str) -> DataFrame:
    """T4: Kruskal-Wallis H with epsilon squared."""
    return _single(df, "kw", category, metric, hypothesis)


def spearman(df: DataFrame, x: str, y: str, hypothesis: str) -> DataFrame:
    """T5: Spearman rank correlation with a t-distribution p-value."""
    return _single(df, "spearman", x, y, hypothesis)


# ---------------------------------------------------------------------------
# The fixed 16-test suite
# ---------------------------------------------------------------------------
# The suite's tests, in order: (kind, column a, column b,
# session filter, hypothesis text).
SUITE = [
    ("chi2", "device_category", "converted_purchase", None, "Purchase conversion differs by device category."),
    ("chi2", "traffic_medium", "converted_purchase", None, "Purchase conversion differs by traffic medium."),
    ("chi2", "landing_category_grouped", "converted_purchase", None,
     "Purchase conversion differs by product/category entry point."),
    ("chi2", "landing_category_grouped", "reached_cart", "reached_product_detail",
     "Product-detail-to-cart behavior differs by category."),
    ("chi2", "device_category", "reached_cart", "reached_product_detail", "Product-detail-to-cart behavior differs by device."),
    ("chi2", "device_category", "converted_purchase", "reached_checkout", "Checkout completion differs by device."),
    ("mwu", "engagement_seconds_winsorized", "converted_purchase", None,
     "Converted sessions have different engagement time than non-converted sessions."),
    ("mwu", "session_duration_sec_winsorized", "converted_purchase", None,
     "Converted sessions have different duration than non-converted sessions."),
    ("mwu", "event_count_winsorized", "reached_cart", None,
     "Cart-intent sessions have different event volume than non-cart sessions."),
    ("mwu", "avg_item_price_usd", "converted_purchase", None,
     "Converted sessions involve different average item prices than non-converted sessions."),
    ("kw", "device_category", "journey_depth", None, "Journey depth differs by device category."),
    ("kw", "traffic_medium", "journey_depth", None, "Journey depth differs by traffic medium."),
    ("kw", "landing_category_grouped", "journey_depth", None, "Journey depth differs by product/category entry point."),
    ("kw", "landing_category_grouped", "engagement_seconds_winsorized", None,
     "Engagement time differs by product/category entry point."),
    ("spearman", "event_count_winsorized", "journey_depth", None,
     "Event volume is associated with deeper journey progression."),
    ("spearman", "unique_products", "journey_depth", None,
     "Unique product breadth is associated with deeper journey progression."),
]


def run_test(sessions: DataFrame, index: int) -> DataFrame:
    """One test of the suite (one result row)."""
    kind, a, b, where, text = SUITE[index]
    return run_family(sessions, kind, [(a, b, where, text)]).drop("_t")


def hypothesis_suite(sessions: DataFrame) -> DataFrame:
    """All 16 tests as one table in suite order (``test_order``): one batched job per family."""
    parts = []
    for kind in _FAMILIES:
        members = [(i, sp) for i, sp in enumerate(SUITE) if sp[0] == kind]
        res = run_family(sessions, kind, [sp[1:] for _, sp in members])
        order = F.create_map(*[x for j, (i, _) in enumerate(members) for x in (F.lit(j), F.lit(i))])
        parts.append(res.withColumn("test_order", order[F.col("_t")]).drop("_t"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("test_order")


def significant_count(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Completed tests with p < alpha."""
    return tests.agg(F.count_if((F.col("status") == "completed") & (F.col("p_value") < alpha)).alias("significant_tests"))


def test_table_feed(tests: DataFrame, top: int = 8) -> DataFrame:
    """First completed tests in suite order, p as ``.2e``, effect as ``.3f``."""
    done = tests.where(F.col("status") == "completed").orderBy("test_order").limit(top)
    return done.select(
        "test_order", "test", "hypothesis",
        F.format_string("%.2e", F.col("p_value")).alias("p_value_display"),
        "effect_size_name",
        F.format_string("%.3f", F.col("effect_size")).alias("effect_size_display"),
    )


# ---------------------------------------------------------------------------
# Normality of every group, on all of its rows
# ---------------------------------------------------------------------------
NORMALITY_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("statistic", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("skewness", T.DoubleType()),
    T.StructField("kurtosis", T.DoubleType()),
    T.StructField("interpretation", T.StringType()),
    T.StructField("label", T.StringType()),
])

# The three (metric, group, label) checks of the normality suite.
NORMALITY_SUITE = [
    ("engagement_seconds_winsorized", "converted_purchase", "Engagement time normality by purchase outcome."),
    ("session_duration_sec_winsorized", "converted_purchase", "Session duration normality by purchase outcome."),
    ("event_count_winsorized", "reached_cart", "Event count normality by cart-intent outcome."),
]


def normality_suite(sessions: DataFrame, checks: list[tuple] = NORMALITY_SUITE) -> DataFrame:
    """The Shapiro-Francia statistic of every (metric, group): the squared correlation of the
    values with the normal scores of their mid-ranks, (rank - 3/8) / (n + 1/4), with skewness and excess kurtosis.

    All rows count. The session table is melted once, the rank histogram gives each distinct value its
    mid-rank without sorting a group in one task, and everything else is sums over that histogram. The
    p-value formula is published for up to 5,000 rows; larger groups carry it on.
    """
    present = [(i, m, g, label) for i, (m, g, label) in enumerate(checks) if not _missing(sessions, [m, g])]
    if not present:
        return sessions.sparkSession.createDataFrame([], NORMALITY_SCHEMA)
    rows = [F.struct(F.lit(i).alias("_t"), F.col(m).cast("double").alias("_v"), F.col(g).cast("string").alias("_g"))
            for i, m, g, _ in present]
    melted = sessions.select(F.explode(F.array(*rows)).alias("_m")).select("_m.*")
    melted = melted.where(F.col("_v").isNotNull() & F.col("_g").isNotNull())
    ranked = rank_histogram(melted, "_v", by=["_t", "_g"], bounds_by="_t").select(
        "_t", "_g", "_v", "cnt", ((average_rank("cnt") - 0.375) / (F.col("total_cnt") + 0.25)).alias("_p"))
    ranked = ranked.withColumn("_z", F.expr(normal_quantile_sql("_p")))
    # moments about the mean: the means are one row a group
    means = ranked.groupBy("_t", "_g").agg((F.sum(F.col("cnt") * F.col("_v")) / F.sum("cnt")).alias("_mv"),
                                           (F.sum(F.col("cnt") * F.col("_z")) / F.sum("cnt")).alias("_mz"))
    both = ranked.join(means, ["_t", "_g"])
    c, dv, dz = F.col("cnt").cast("double"), F.col("_v") - F.col("_mv"), F.col("_z") - F.col("_mz")
    sums = both.groupBy("_t", "_g").agg(
        F.sum("cnt").alias("n"), F.sum(c * dv * dv).alias("v2"), F.sum(c * dz * dz).alias("z2"), F.sum(c * dv * dz).alias("vz"),
        F.sum(c * dv * dv * dv).alias("v3"), F.sum(c * dv * dv * dv * dv).alias("v4"))
    n, v2 = F.col("n").cast("double"), F.col("v2")
    w = F.col("vz") * F.col("vz") / (v2 * F.col("z2"))
    few, flat = F.col("n") < 3, v2 <= 0
    ok = ~few & ~flat
    lookup = lambda k: F.create_map(*[x for spec in present for x in (F.lit(spec[0]), F.lit(spec[k]))])[F.col("_t")]
    out = sums.select(
        F.col("_t"), lookup(1).alias("metric"), F.col("_g").alias("group"), F.when(ok, "completed").otherwise("skipped").alias("status"),
        F.when(few, "Fewer than 3 observations.").when(flat, "All values are identical.").otherwise("").alias("reason"), "n",
        F.when(ok, w).alias("statistic"),
        F.when(ok, F.sqrt(n) * F.col("v3") / F.pow(v2, 1.5)).alias("skewness"),
        F.when(ok, n * F.col("v4") / (v2 * v2) - 3).alias("kurtosis"), lookup(3).alias("label"))
    out = out.withColumn("p_value", francia_p_udf(F.col("statistic"), F.col("n").cast("double")))
    out = out.withColumn("interpretation", F.when(F.col("p_value") < 0.05, "non-normal").when(F.col("p_value").isNotNull(), "normal-like")
                         .otherwise("Insufficient data."))
    return out.orderBy("_t", "group").select(*[f.name for f in NORMALITY_SCHEMA.fields])
