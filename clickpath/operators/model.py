"""Purchase-propensity model (M1-M15) on Spark ML.

* features: 13 numeric + 7 categorical columns; categoricals are limited to
  their 25 most frequent levels over the whole table (before the split)
* split: the quarter of each class with the smallest MD5 of seed and key is the test part
* numeric scaling: mean / population standard deviation of the training rows
  (one aggregate row); zero variance -> divide by 1
* one-hot: one column per training level (sorted); unseen levels -> all zeros
* class-balanced L2 logistic regression: weights n / (2 n_c), and
  ``regParam = 1 / sum(weights)`` maps the objective 0.5|w|^2 + C sum s_i l_i
  (C = 1) onto Spark's weighted-mean loss; gradients are tree-aggregated
  across executors
* metrics: confusion counts by one groupBy; ROC AUC and average precision
  exactly from the rank histogram of the scores (ties count one half for AUC)
* review queue: non-buyers scoring at least max(0.5, exact 90th percentile)

Only bounded results reach the driver: class counts, the scaling row, at most
26 levels per categorical, the coefficient vector and the confusion counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickpath.context import checkpoint_dir, written
from clickpath.functions.columns import clean_category, exact_avg, nan_to_null
from clickpath.operators.ranks import average_rank, quantiles, rank_histogram
from clickpath.operators.sessions import limit_cardinality, limited, top_levels

TARGET = "converted_purchase"
SEED = 42

# The model's feature lists.
NUMERIC_FEATURES = [
    "session_duration_sec_winsorized", "event_count_winsorized", "page_view_count", "view_item_list_count",
    "view_item_count", "add_to_cart_count", "begin_checkout_count", "scroll_count", "user_engagement_count",
    "engagement_seconds_winsorized", "journey_depth_pre_purchase", "bounce_like_session", "cart_without_checkout",
]
CATEGORICAL_FEATURES = [
    "device_category", "operating_system", "country", "traffic_source", "traffic_medium", "landing_path",
    "session_weekday",
]
SEGMENT_KEYS = ["ux_intent_segment", "device_category", "source_medium", "landing_path"]

PERFORMANCE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("train_rows", T.LongType()), T.StructField("test_rows", T.LongType()),
    T.StructField("positive_rate_train", T.DoubleType()), T.StructField("positive_rate_test", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()), T.StructField("average_precision", T.DoubleType()),
    T.StructField("classification_report", T.StringType()), T.StructField("confusion_matrix", T.StringType()),
    T.StructField("iterations", T.LongType()),
])
IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("coefficient", T.DoubleType()),
    T.StructField("abs_coefficient", T.DoubleType()),
])


#: Levels kept of each category.
TOP_LEVELS = 25


def model_frame(sessions: DataFrame, top_n: int = TOP_LEVELS) -> DataFrame:
    """M2: the session table with every categorical feature limited to its top levels."""
    cols = [c for c in CATEGORICAL_FEATURES if c in sessions.columns]
    return limit_cardinality(sessions, cols, top_n)


def with_split(sessions: DataFrame, key: str = "session_key", seed: int = SEED, test_fraction: float = 0.25,
               name: str = "_test") -> DataFrame:
    """M3: ``name`` = 1 on the test rows, the same share of each class.

    In each class the rows with the smallest hashes of their key (the first 13 hexadecimal digits of an
    MD5) are the test rows; the hash at the cut comes from the rank histogram, one number a class.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13)
    hashed = F.conv(digits, 16, 10).cast("bigint")
    ranked = rank_histogram(sessions.select(F.col(TARGET), hashed.alias("_u")), "_u", by=[TARGET])
    wanted = F.round(F.col("total_cnt") * test_fraction)
    cuts = ranked.groupBy(TARGET).agg(F.max(F.when(F.col("before_cnt") < wanted, F.col("_u"))).alias("cut")).collect()
    flag = F.lit(0)
    for r in cuts:  # one row a class
        if r["cut"] is not None:
            flag = F.when(F.col(TARGET).eqNullSafe(F.lit(r[TARGET])), (hashed <= F.lit(r["cut"])).cast("int")).otherwise(flag)
    return sessions.withColumn(name, flag)


def _safe(a: float, b: float) -> float:
    return float(a / b) if b else 0.0


def rank_metrics(scored: DataFrame, score: str = "score", label: str = "label") -> dict:
    """Exact ROC AUC (Mann-Whitney form, ties 1/2) and step-wise average precision."""
    ranked = rank_histogram(scored.select(F.col(score).alias("_s"), F.col(label).alias("_y")), "_s", counts={
        "cnt": F.count(F.lit(1)), "pos": F.count_if(F.col("_y") == 1), "neg": F.count_if(F.col("_y") == 0),
    })
    # precision at threshold s counts the rows scoring >= s
    tp = F.col("total_pos") - F.col("before_pos")
    fp = F.col("total_neg") - F.col("before_neg")
    row = ranked.agg(
        F.sum(F.col("pos") * average_rank("cnt")).alias("r_pos"),
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("ap_sum"),
    ).first()
    n_pos, n_neg = row["n_pos"] or 0, row["n_neg"] or 0
    auc = (row["r_pos"] - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) if n_pos and n_neg else None
    ap = row["ap_sum"] / n_pos if n_pos else None
    return {"roc_auc": auc, "average_precision": ap}


def _report(tn: int, fp: int, fn: int, tp: int) -> str:
    def cls(tp_, fp_, fn_):
        p = _safe(tp_, tp_ + fp_)
        r = _safe(tp_, tp_ + fn_)
        return {"precision": p, "recall": r, "f1-score": _safe(2 * p * r, p + r), "support": float(tp_ + fn_)}
    c0, c1 = cls(tn, fn, fp), cls(tp, fp, fn)
    total = tn + fp + fn + tp
    macro = {k: (c0[k] + c1[k]) / 2 for k in ("precision", "recall", "f1-score")}
    weighted = {k: _safe(c0[k] * c0["support"] + c1[k] * c1["support"], total) for k in ("precision", "recall", "f1-score")}
    return json.dumps({"0": c0, "1": c1, "accuracy": _safe(tn + tp, total),
                       "macro avg": {**macro, "support": float(total)},
                       "weighted avg": {**weighted, "support": float(total)}})


class PropensityResult:
    def __init__(self, performance: DataFrame, importance: DataFrame, high_intent: DataFrame, scored: DataFrame | None,
                 model: "PurchaseModel | None" = None):
        self.performance = performance
        self.importance = importance
        self.high_intent = high_intent
        self.scored = scored
        self.model = model


def _text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


class PurchaseModel:
    """M4-M8 fitted: imputation, scaling, one-hot levels and coefficients as one ``PipelineModel``, for tables that it was not
    trained on. Missing numbers get the training median, unseen levels count as ``other`` (no column, if training had no such
    row), missing categories as ``unknown``; a feature whose column the table lacks is missing in every row."""

    def __init__(self, stages: PipelineModel, columns: dict[str, str]):
        self.stages = stages
        self.columns = columns  # feature column -> kind

    @classmethod
    def fitted(cls, model, numeric: dict[str, tuple[float, float, float]], categorical: dict[str, tuple[list[str], list[str]]]) -> "PurchaseModel":
        """``numeric``: column -> (fill, mean, scale); ``categorical``: column -> (levels kept, levels with a coefficient)."""
        parts = [f"(coalesce(`_num_{c}`, {_number(fill)}) - {_number(mean)}) / {_number(scale)}" for c, (fill, mean, scale) in numeric.items()]
        limits = []
        for c, (kept, coded) in categorical.items():
            level = f"CASE WHEN `_cat_{c}` IN ({', '.join(map(_text, kept))}) THEN `_cat_{c}` ELSE 'other' END" if kept else "'other'"
            limits.append(f"{level} AS `_level_{c}`")
            parts += [f"CAST(`_level_{c}` = {_text(x)} AS DOUBLE)" for x in coded]
        names = [f"_f{k}" for k in range(len(parts))]
        # a step of its own, so that a row's level is found once and not for each of its columns
        levels = SQLTransformer(statement=f"SELECT {', '.join(['*', *limits])} FROM __THIS__")
        features = SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS {n}" for e, n in zip(parts, names)) + " FROM __THIS__")
        stages = PipelineModel([levels, features, VectorAssembler(inputCols=names, outputCol="features"), model])
        return cls(stages, {**dict.fromkeys(numeric, "numeric"), **dict.fromkeys(categorical, "categorical")})

    def save(self, path: str) -> None:
        """Write the model to a shared folder; an earlier one there is replaced."""
        self.stages.write().overwrite().save(f"{path}/stages")
        spark = SparkSession.active()
        spark.createDataFrame(list(self.columns.items()), "name string, kind string").write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, path: str) -> "PurchaseModel":
        rows = SparkSession.active().read.parquet(f"{path}/columns").collect()
        return cls(PipelineModel.load(f"{path}/stages"), {r["name"]: r["kind"] for r in rows})

    def score(self, sessions: DataFrame) -> DataFrame:
        """``sessions`` with ``score``, the predicted probability of a purchase."""
        there = lambda c, kind: F.col(c) if c in sessions.columns else F.lit(None).cast(kind)
        ready = sessions.withColumns({
            f"_num_{c}" if kind == "numeric" else f"_cat_{c}":
                nan_to_null(there(c, "double").cast("double")) if kind == "numeric" else clean_category(there(c, "string"))
            for c, kind in self.columns.items()})
        scored = self.stages.transform(ready)
        return scored.select(*[scored[f"`{c}`"] for c in sessions.columns], vector_to_array("probability")[1].alias("score"))


def train_purchase_model(sessions: DataFrame, seed: int = SEED, max_iter: int = 1500) -> PropensityResult:
    spark = sessions.sparkSession
    empty_imp = spark.createDataFrame([], IMPORTANCE_SCHEMA)

    def skip(reason: str) -> PropensityResult:
        perf = spark.createDataFrame([{"status": "skipped", "reason": reason}], PERFORMANCE_SCHEMA)
        return PropensityResult(perf, empty_imp, spark.createDataFrame([], high_intent_schema()), None)

    # M1 guards: class counts (at most a handful of rows)
    if TARGET not in sessions.columns:
        return skip("Target has fewer than two classes.")
    numeric = [c for c in NUMERIC_FEATURES if c in sessions.columns]
    categorical = [c for c in CATEGORICAL_FEATURES if c in sessions.columns]
    # one pass: rows per class (a handful) and, per class, the training rows missing each numeric feature
    sessions = with_split(sessions, seed=seed)
    is_train = F.col("_test") == 0
    per_class = sessions.groupBy(TARGET).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(is_train & F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(numeric)],
    ).collect()
    classes = {r[TARGET]: r["_rows"] for r in per_class}
    missing = {c: sum(r[f"_null_{i}"] for r in per_class) for i, c in enumerate(numeric)}
    if len(classes) < 2:
        return skip("Target has fewer than two classes.")
    if min(classes.values()) < 10:
        return skip("At least one target class has fewer than 10 rows.")

    # M2: the levels kept of each category, for the frame and for the saved model alike
    levels = top_levels(sessions, categorical, TOP_LEVELS)
    frame = sessions.withColumns({**{c: limited(c, levels[c]) for c in categorical}, "label": F.col(TARGET).cast("double")})
    # the review-queue roll-up reads these; a table without them still trains
    absent = {c: F.lit("unknown") for c in SEGMENT_KEYS + ["ux_intent_segment"] if c not in frame.columns}
    absent.update({c: F.lit(None).cast("double") for c in
                   ["reached_cart", "reached_checkout", "engagement_seconds_winsorized", "journey_depth_pre_purchase"]
                   if c not in frame.columns})
    frame = frame.withColumns(absent) if absent else frame
    keep = ["session_key", "label", "_test", *SEGMENT_KEYS, "reached_cart", "reached_checkout",
            "engagement_seconds_winsorized", "journey_depth_pre_purchase", "ux_intent_segment"]
    keep = list(dict.fromkeys(c for c in keep if c in frame.columns))
    # read by every pass below: cleaned, limited and split once
    frame = written(frame.select(*dict.fromkeys([*keep, *numeric, *categorical])), "frame")
    train = frame.where(F.col("_test") == 0)

    # training statistics: one aggregate row + bounded level lists
    # M4 imputation: training median for numeric features that hold missing values (the saved model fills any). Categorical features
    # need none: limiting to the top levels maps a missing level to "unknown", their most-frequent fill.
    fill_num = [c for c in numeric if missing[c] > 0]
    medians = quantiles(train, numeric, [0.5])
    if fill_num:
        frame = frame.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit((medians[c] or [0.0])[0]))
                                   for c in fill_num})
        train = frame.where(F.col("_test") == 0)

    stats = train.agg(
        F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_pos"),
        *[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(numeric)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(numeric)],
    ).first()
    # categoricals are already cleaned and limited by model_frame: at most 26 levels each, of their distinct combinations
    coded = train.select(*categorical).distinct().agg(
        *[F.sort_array(F.collect_set(F.col(c))).alias(c) for c in categorical]).first() if categorical else {}
    n_train, n_pos = stats["_n"], stats["_pos"] or 0
    if n_train == 0 or n_pos in (0, n_train):
        return skip("Training split has fewer than two classes.")
    w_pos, w_neg = n_train / (2.0 * n_pos), n_train / (2.0 * (n_train - n_pos))

    feats, names, scales = [], [], {}
    for i, c in enumerate(numeric):
        mean, sd = stats[f"m_{i}"] or 0.0, stats[f"s_{i}"] or 0.0
        scales[c] = ((medians.get(c) or [mean])[0], mean, sd if sd > 0 else 1.0)
        feats.append(((F.col(c).cast("double") - mean) / (sd if sd > 0 else 1.0)).alias(f"_f{len(feats)}"))
        names.append(f"num__{c}")
    for c in categorical:
        for level in coded[c]:
            feats.append((F.col(c) == F.lit(level)).cast("double").alias(f"_f{len(feats)}"))
            names.append(f"cat__{c}_{level}")
    fcols = [f"_f{i}" for i in range(len(feats))]
    design = VectorAssembler(inputCols=fcols, outputCol="features").transform(
        frame.select(*keep, *feats).withColumn("weight", F.when(F.col("label") == 1, w_pos).otherwise(w_neg)))

    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / n_train,
                            elasticNetParam=0.0, standardization=False, fitIntercept=True, maxIter=max_iter,
                            tol=1e-6)
    # the optimiser keeps its own blocks of the training rows for its passes; a persisted copy would hold them twice
    model = lr.fit(design.where(F.col("_test") == 0).select("features", "label", "weight"))
    iterations = model.summary.totalIterations
    # read back from the shared folder: a fitted model's training summary holds the session, which can't be sent to tasks
    # once the session has observed a query
    place = f"{checkpoint_dir(spark).rstrip('/')}/tables/model-{uuid.uuid4().hex[:12]}"
    model.save(place)
    model = LogisticRegressionModel.load(place)

    # scores are read by several bounded aggregates below: written once to the shared folder
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/scored-{uuid.uuid4().hex[:12]}"
    model.transform(design).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability").write.parquet(path)
    scored = spark.read.parquet(path)
    test = scored.where(F.col("_test") == 1)
    cm = {(int(r[0]), int(r[1])): r[2] for r in test.groupBy("label", "prediction").count().collect()}
    tn, fp, fn, tp = cm.get((0, 0), 0), cm.get((0, 1), 0), cm.get((1, 0), 0), cm.get((1, 1), 0)
    n_test = tn + fp + fn + tp
    precision, recall = _safe(tp, tp + fp), _safe(tp, tp + fn)
    ranks = rank_metrics(test)
    perf_row = {
        "status": "completed", "reason": None, "train_rows": int(n_train), "test_rows": int(n_test),
        "positive_rate_train": _safe(n_pos, n_train), "positive_rate_test": _safe(fn + tp, n_test),
        "accuracy": _safe(tn + tp, n_test), "precision": precision, "recall": recall,
        "f1": _safe(2 * precision * recall, precision + recall), **ranks,
        "classification_report": _report(tn, fp, fn, tp), "confusion_matrix": json.dumps([[tn, fp], [fn, tp]]),
        "iterations": int(iterations),
    }
    perf = spark.createDataFrame([perf_row], PERFORMANCE_SCHEMA)
    coef = [float(x) for x in model.coefficients.toArray()]
    importance = spark.createDataFrame(
        [(n, c, abs(c)) for n, c in zip(names, coef)], IMPORTANCE_SCHEMA).orderBy(F.desc("abs_coefficient"), "feature")
    high = high_intent_segments(scored.withColumn(TARGET, F.col("label").cast("int")), "score")
    fitted = PurchaseModel.fitted(model, scales, {c: (levels[c], coded[c]) for c in categorical})
    return PropensityResult(perf, importance, high, scored, fitted)


def high_intent_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in SEGMENT_KEYS] + [
        T.StructField("sessions", T.LongType()),
        T.StructField("avg_predicted_purchase_probability", T.DoubleType()),
        T.StructField("cart_rate", T.DoubleType()), T.StructField("checkout_rate", T.DoubleType()),
        T.StructField("avg_engagement_seconds", T.DoubleType()), T.StructField("avg_journey_depth", T.DoubleType()),
    ])


def high_intent_threshold(scored: DataFrame, score: str, floor: float = 0.5, q: float = 0.9) -> float:
    """max(floor, exact q-quantile of all scores)."""
    qs = quantiles(scored, [score], [q])[score]
    return max(floor, qs[0]) if qs is not None else floor


def high_intent_segments(scored: DataFrame, score: str = "score") -> DataFrame:
    """Non-buyers at or above the threshold, rolled up by segment keys."""
    threshold = high_intent_threshold(scored, score)
    hot = scored.where((F.col(TARGET) == 0) & (F.col(score) >= F.lit(threshold)))
    return hot.groupBy(*SEGMENT_KEYS).agg(
        F.count("session_key").alias("sessions"),
        F.avg(score).alias("avg_predicted_purchase_probability"),
        F.avg("reached_cart").alias("cart_rate"),
        F.avg("reached_checkout").alias("checkout_rate"),
        exact_avg("engagement_seconds_winsorized").alias("avg_engagement_seconds"),
        F.avg("journey_depth_pre_purchase").alias("avg_journey_depth"),
    ).orderBy(F.desc("sessions"), F.desc("avg_predicted_purchase_probability"))


def coefficient_feed(importance: DataFrame, top: int = 20) -> DataFrame:
    """Top coefficients by absolute value, re-sorted by signed value."""
    return importance.orderBy(F.desc("abs_coefficient"), "feature").limit(top).orderBy("coefficient")
