"""Distributed ranking and exact quantiles against pandas / numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clickpath.operators.ranks import average_rank, grouped_quantiles, quantiles, rank_histogram


def _frame(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], size=n, p=[0.7, 0.2, 0.1]),
        "v": np.round(rng.exponential(10, size=n), 1),  # many ties
    })
    return pdf, spark.createDataFrame(pdf)


def test_global_ranks_match_pandas(spark):
    pdf, df = _frame(spark)
    ranked = rank_histogram(df, "v", buckets=16).select("v", average_rank("cnt").alias("r")).toPandas()
    got = dict(zip(ranked.v, ranked.r))
    expected = pdf.assign(r=pdf.v.rank(method="average")).drop_duplicates("v")
    assert all(abs(got[v] - r) < 1e-9 for v, r in zip(expected.v, expected.r))


def test_grouped_ranks_match_pandas(spark):
    pdf, df = _frame(spark)
    ranked = rank_histogram(df, "v", by=["g"], buckets=8).select("g", "v", average_rank("cnt").alias("r")).toPandas()
    got = {(g, v): r for g, v, r in zip(ranked.g, ranked.v, ranked.r)}
    pdf = pdf.assign(r=pdf.groupby("g").v.rank(method="average")).drop_duplicates(["g", "v"])
    assert all(abs(got[(g, v)] - r) < 1e-9 for g, v, r in zip(pdf.g, pdf.v, pdf.r))


def test_quantiles_both_paths(spark):
    pdf, df = _frame(spark)
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    exact = np.quantile(pdf.v.to_numpy(), probs)
    small = quantiles(df, ["v"], probs)["v"]
    large = quantiles(df, ["v"], probs)["v"]
    assert np.allclose(small, exact, rtol=0, atol=1e-9)
    assert np.allclose(large, exact, rtol=0, atol=1e-9)


def test_grouped_median(spark):
    pdf, df = _frame(spark)
    got = grouped_quantiles(df, "v", [0.5], ["g"]).toPandas().set_index("g")["q0"]
    expected = pdf.groupby("g").v.median()
    assert np.allclose(got.sort_index().to_numpy(), expected.sort_index().to_numpy())


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert quantiles(df, ["v"], [0.5]) == {"v": None}
    assert rank_histogram(df, "v").count() == 0


def test_quantiles_many_large_columns(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": np.round(rng.normal(size=2000), 3), "b": rng.integers(0, 50, size=2000).astype(float),
                        "c": np.where(rng.random(2000) < 0.3, np.nan, rng.random(2000))})
    df = spark.createDataFrame(pdf).withColumn("c", F.when(F.isnan("c"), None).otherwise(F.col("c")))
    probs = [0.25, 0.5, 0.75]
    got = quantiles(df, ["a", "b", "c"], probs)
    for col in "abc":
        assert np.allclose(got[col], np.nanquantile(pdf[col].to_numpy(), probs), atol=1e-12)
