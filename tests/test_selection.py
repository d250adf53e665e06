"""Exact selection of ranks against numpy, also where every interval has to be narrowed."""

import math

import numpy as np
import pandas as pd
import pytest

from clickpath.operators import ranks
from clickpath.operators.sessions import top_levels, counted_levels
from clickpath.operators import sessions as sessions_module

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values: dict):
    pdf = pd.DataFrame({k: pd.array(v, dtype="Float64") for k, v in values.items()})
    df = spark.createDataFrame([tuple(None if x is pd.NA else float(x) for x in r) for r in pdf.itertuples(index=False)],
                               ", ".join(f"{k} double" for k in values)).repartition(5)
    got = ranks.quantiles(df, list(values), PROBS)
    for k, v in values.items():
        v = np.array([x for x in v if x is not None], float)
        assert got[k] == pytest.approx(list(np.quantile(v, PROBS)), rel=1e-12, abs=1e-300, nan_ok=True), k


@pytest.mark.parametrize("listed, accuracy", [(50_000, 10_000), (40, 200)])
def test_quantiles_match_numpy(spark, monkeypatch, listed, accuracy):
    monkeypatch.setattr(ranks, "LISTED_ROWS", listed)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = np.random.default_rng(7)
    n = 20_000
    check(spark, {
        "smooth": list(rng.normal(size=n)), "ties": list(rng.integers(0, 6, n).astype(float)),
        "mostly_zero": list(np.where(rng.random(n) < 0.9, 0.0, rng.random(n))), "wide": list(10.0 ** rng.uniform(-300, 300, n)),
        "signed": list(np.where(rng.random(n) < 0.5, -1.0, 1.0) * rng.random(n)), "one": [3.5] * n,
        "few": [1.0, 2.0] + [None] * (n - 2)})


def test_small_and_odd_columns(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, nan, None, -inf), (2.0, 1.0, None, 5.0), (4.0, nan, None, inf)], "a double, b double, c double, d double")
    got = ranks.select_ranks(df, {"a": [0.5, 0.9], "b": [0.0, 1.0], "c": [0.5], "d": [0.0, 0.5, 1.0]})
    assert got["a"] == [(2.0, 2.0, 1.0), (2.0, 4.0, 1.8)] and got["c"] is None
    assert got["b"][0][0] == 1.0 and math.isnan(got["b"][1][0])  # NaN is larger than any number
    assert [x[0] for x in got["d"]] == [-inf, 5.0, inf]
    assert ranks.select_ranks(df.limit(0), {"a": [0.5]}) == {"a": None}


def test_a_scaled_median_needs_no_second_pass(spark):
    from clickpath.operators.sessions import winsor_bounds
    df = spark.createDataFrame([(float(x),) for x in [1, 5, 7, 1001]], "engagement_time_msec double")
    low, high, h = winsor_bounds(df)["engagement_time_msec"]["middle"]
    assert ranks.between_ranks(low / 1000, high / 1000, h) == np.quantile([0.001, 0.005, 0.007, 1.001], 0.5)


def test_top_levels_with_few_counters(spark, monkeypatch):
    """A flat column leaves the sketch unsure, so it is counted in full; a skewed one is not."""
    monkeypatch.setattr(sessions_module, "TRACKED_LEVELS", 64)
    monkeypatch.setattr(sessions_module, "SPARE_LEVELS", 4)
    rng = np.random.default_rng(3)
    flat = [f"f{k % 3000:04d}" for k in range(9000)]
    skewed = [f"s{int(x)}" for x in rng.geometric(0.3, 9000)]
    rows = list(zip(flat, skewed, ["x"] * 4500 + ["y"] * 4500, [None] * 9000))
    df = spark.createDataFrame(rows, "flat string, skewed string, two string, none string").repartition(4)
    full = {c: [x for _, x in v] for c, v in counted_levels(df, dict.fromkeys(df.columns), 5).items()}
    counted = []
    monkeypatch.setattr(sessions_module, "counted_levels", lambda d, levels, n: counted.append(levels) or counted_levels(d, levels, n))
    assert top_levels(df, df.columns, 5) == full
    assert full["two"] == ["x", "y"] and full["none"] == ["unknown"] and full["flat"] == [f"f{k:04d}" for k in range(5)]
    assert list(counted[1]) == ["flat"]
