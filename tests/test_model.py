"""Model metrics and guards."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickpath.operators import model as M
from clickpath.operators.model import rank_metrics, train_purchase_model


def naive_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg])


def naive_ap(y, s):
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        p, r = tp / sel.sum(), tp / (y == 1).sum()
        ap += (r - prev_r) * p
        prev_r = r
    return ap


def test_rank_metrics_with_ties(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, size=300)
    s = np.round(np.clip(y * 0.3 + rng.random(300) * 0.7, 0, 1), 1)  # heavy ties
    df = spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))
    got = rank_metrics(df)
    assert got["roc_auc"] == pytest.approx(naive_auc(y, s), rel=1e-12)
    assert got["average_precision"] == pytest.approx(naive_ap(y, s), rel=1e-12)


def test_one_class_is_skipped(spark):
    df = spark.createDataFrame([(f"s{i}", 0) for i in range(30)], ["session_key", "converted_purchase"])
    res = train_purchase_model(df)
    assert res.performance.first().status == "skipped"
    assert res.importance.count() == 0


def test_model_on_fixture(spark):
    from clickpath.plans.pipeline import pipeline

    res = pipeline(spark, "/root/testdata/sf0.001").model
    perf = res.performance.first()
    assert perf.status == "completed"
    assert perf.train_rows + perf.test_rows == 397
    assert 0.5 < perf.roc_auc <= 1.0
    names = [r.feature for r in res.importance.collect()]
    assert any(n.startswith("num__") for n in names) and any(n.startswith("cat__") for n in names)


def newton_logistic(X, y, s, iters=50):
    """argmin 0.5|w|^2 + sum_i s_i * logloss_i with an unpenalised intercept."""
    Xb = np.hstack([X, np.ones((len(X), 1))])
    w = np.zeros(Xb.shape[1])
    reg = np.eye(Xb.shape[1])
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = reg @ w + Xb.T @ (s * (p - y))
        H = reg + Xb.T @ (Xb * (s * p * (1 - p))[:, None])
        w -= np.linalg.solve(H, g)
    return w


def test_coefficients_match_newton_solve(spark):
    from clickpath.operators.model import with_split

    rng = np.random.default_rng(11)
    n = 600
    x1, x2 = rng.normal(size=n), rng.exponential(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x1 - 0.5 * x2 - 0.7)))).astype(int)
    pdf = pd.DataFrame({"session_key": [f"k{i}" for i in range(n)], "converted_purchase": y,
                        "event_count_winsorized": x1, "page_view_count": x2})
    df = spark.createDataFrame(pdf)
    res = train_purchase_model(df)
    coef = {r.feature: r.coefficient for r in res.importance.collect()}

    train = with_split(df, name="_t").where("_t = 0").toPandas()
    X = train[["event_count_winsorized", "page_view_count"]].to_numpy()
    X = (X - X.mean(0)) / X.std(0)  # population sd, as the model scales
    yt = train.converted_purchase.to_numpy()
    s = np.where(yt == 1, len(yt) / (2 * yt.sum()), len(yt) / (2 * (len(yt) - yt.sum())))
    w = newton_logistic(X, yt, s)
    assert coef["num__event_count_winsorized"] == pytest.approx(w[0], rel=1e-3)
    assert coef["num__page_view_count"] == pytest.approx(w[1], rel=1e-3)


def test_split_is_about_a_quarter_per_class(spark):
    from clickpath.operators.model import with_split
    from clickpath.plans.pipeline import pipeline

    s = with_split(pipeline(spark, "/root/testdata/sf0.01").sessions, name="_t")
    for r in s.groupBy("converted_purchase").agg(F.avg("_t").alias("share")).collect():
        assert 0.2 < r.share < 0.3


def test_unseen_level_gets_no_column(spark):
    from clickpath.operators.model import with_split

    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"session_key": [f"u{i}" for i in range(n)], "converted_purchase": rng.integers(0, 2, size=n),
                        "event_count_winsorized": rng.random(n)})
    df = with_split(spark.createDataFrame(pdf), name="_t")
    # 'tablet' appears on test rows only; 'desktop' / 'mobile' on training rows
    df = df.withColumn("device_category", F.when(F.col("_t") == 1, F.lit("tablet"))
                       .otherwise(F.when(F.col("event_count_winsorized") > 0.5, "desktop").otherwise("mobile"))).drop("_t")
    res = train_purchase_model(df)
    names = {r.feature for r in res.importance.collect()}
    assert {"cat__device_category_desktop", "cat__device_category_mobile"} <= names
    assert "cat__device_category_tablet" not in names
    assert res.performance.first().test_rows > 0  # unseen rows are scored (all-zero one-hot)


def test_saved_model_scores_new_tables(spark, tmp_path):
    """A model read back scores as the one that was saved; unseen levels, nulls and absent columns have defined scores."""
    from clickpath.operators.model import PurchaseModel

    rng = np.random.default_rng(8)
    n = 600
    y = rng.integers(0, 2, size=n)
    pdf = pd.DataFrame({
        "session_key": [f"s{i}" for i in range(n)], "converted_purchase": y,
        "event_count_winsorized": rng.random(n) * 4 + y, "page_view_count": rng.integers(0, 9, size=n),
        "device_category": rng.choice(["desk'top", "mobile\\x", "tablet"], size=n), "country": rng.choice([f"c{k:02d}" for k in range(40)], size=n),
    })
    df = spark.createDataFrame(pdf)
    res = train_purchase_model(df)
    path = str(tmp_path / "model")
    res.model.save(path)
    res.model.save(path)  # again
    loaded = PurchaseModel.load(path)
    want = {r.session_key: r.score for r in res.scored.select("session_key", "score").collect()}
    got = loaded.score(df).toPandas()
    assert list(got.columns) == [*df.columns, "score"] and len(got) == n
    assert max(abs(want[k] - s) for k, s in zip(got.session_key, got.score)) < 1e-12

    one = lambda **row: loaded.score(spark.createDataFrame([row], ", ".join(
        f"{k} {'double' if k in ('event_count_winsorized', 'page_view_count') else 'string'}" for k in row))).first().score
    base = {"session_key": "x", "event_count_winsorized": 2.0, "page_view_count": 3.0, "device_category": "tablet", "country": "c01"}
    median = float(np.median(pdf.event_count_winsorized[pdf.session_key.isin(
        [r.session_key for r in res.scored.where("_test = 0").select("session_key").collect()])]))
    assert one(**{**base, "event_count_winsorized": None}) == pytest.approx(one(**{**base, "event_count_winsorized": median}), abs=1e-12)
    assert one(**{**base, "country": "nowhere"}) == one(**{**base, "country": "other"})
    assert one(**{**base, "device_category": None}) == one(**{k: v for k, v in base.items() if k != "device_category"})
    assert 0 <= one(session_key="x", event_count_winsorized=float("nan")) <= 1


def test_saved_model_limits_a_row_once(spark):
    """a row's level is found once a category, in a step of its own, not once for each column."""
    from pyspark.ml.feature import SQLTransformer

    kept = [f"l{k}" for k in range(25)]
    made = {}
    original = M.PipelineModel
    try:
        M.PipelineModel = lambda stages: made.setdefault("stages", stages)
        M.PurchaseModel.fitted(None, {"n": (0.0, 0.0, 1.0)}, {"c": (kept, [*kept, "other"])})
    finally:
        M.PipelineModel = original
    text = [x.getStatement() for x in made["stages"] if isinstance(x, SQLTransformer)]
    assert sum(t.count("CASE WHEN") for t in text) == 1


def test_training_keeps_no_second_copy(spark, monkeypatch):
    """the optimiser caches its blocks; the training rows handed to it are not persisted beside them."""
    seen = {}

    class Stop(Exception):
        pass

    def fit(self, rows, params=None):
        seen["level"], seen["files"] = rows.storageLevel, [f for f in rows.inputFiles() if "/tables/frame-" in f]
        raise Stop

    monkeypatch.setattr(M.LogisticRegression, "fit", fit)
    rows = [(f"k{i}", i % 2, float(i), "abc"[i % 3]) for i in range(80)]
    df = spark.createDataFrame(rows, "session_key string, converted_purchase int, event_count_winsorized double, device_category string")
    with pytest.raises(Stop):
        M.train_purchase_model(df)
    assert not seen["level"].useMemory and not seen["level"].useDisk and seen["files"]
