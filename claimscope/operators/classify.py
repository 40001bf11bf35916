"""Splits, class balance, MLlib classifiers, their evaluation and choice."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.skew import running_total, running_totals
from claimscope.operators.neighbours import distinct_points, nearest_neighbours, weighed
from claimscope.operators.outliers import with_rates
from claimscope.session import materialise

MODELS = ["random_forest", "logistic_regression", "gradient_boosting", "neural_network", "linear_svm"]


# --- splits and balance ------------------------------------------------------------


def stratified_split(
    rows: DataFrame, key: str, label: str, shares: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 42
) -> DataFrame:
    """Add ``part`` (train, validation, test): the same shares of every label.

    Places within a label follow a hash of the key and are counted chunk by chunk, so a
    label holding most of the rows is never sorted in one task.
    """
    if rows.select(label).distinct().count() < 2:
        raise ValueError("both classes are required")
    spot = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    placed = running_total(rows.withColumns({"_spot": spot, "_one": F.lit(1)}), [label], ["_spot", key], "_one", "_place")
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    share = F.col("_place") / F.col("_size")
    part = F.when(share <= shares[0], "train").when(share <= shares[0] + shares[1], "validation").otherwise("test")
    return placed.join(F.broadcast(sizes), label).withColumn("part", part).drop("_spot", "_one", "_place", "_size")


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` dealing the rows of every label out in turn, in hashed order."""
    spot = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    placed = running_total(rows.withColumns({"_spot": spot, "_one": F.lit(1)}), [label], ["_spot", key], "_one", "_place")
    fold = ((F.col("_place") - 1) % folds).cast("int")
    return placed.withColumn("fold", fold).drop("_spot", "_one", "_place")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes x rows of the class); one row per class."""
    counts = {row[0]: row[1] for row in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(float(total)) / (F.lit(len(counts)) * F.col("class_count"))
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("class_count")).withColumn("class_weight", weight)


def with_class_weight(rows: DataFrame, label: str) -> DataFrame:
    return rows.join(F.broadcast(class_weights(rows, label).drop("class_count")), label)


def oversample(rows: DataFrame, key: str, label: str, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Even out two classes with synthetic minority rows.

    A synthetic row lies between a minority row and one of its ``k`` nearest other rows among all
    rows of the minority. A row with a null feature, or without any other, is copied.
    """
    counts = dict(sorted(((r[0], r[1]) for r in rows.groupBy(label).count().collect()), key=lambda x: x[1]))
    (minor, few), (_, many) = list(counts.items())[0], list(counts.items())[-1]
    missing = many - few
    small = rows.where(F.col(label) == minor).select(key, *[F.col(f).cast("double").alias(f) for f in features])
    k = max(1, min(k, few - 1))
    whole, rest = divmod(missing, few)
    spot = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    placed = running_total(small.withColumns({"_spot": spot, "_one": F.lit(1)}), [], ["_spot", key], "_one", "_place")
    copies = F.lit(whole) + F.when(F.col("_place") <= rest, 1).otherwise(0)
    wanted = placed.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    wanted = wanted.withColumns(
        {
            "_pick": F.pmod(F.xxhash64(key, "_copy", F.lit(seed)), F.lit(k)).cast("int"),
            "_step": F.pmod(F.xxhash64(key, "_copy", F.lit(seed + 1)), F.lit(10**6)) / 10**6,
        }
    )
    points = distinct_points(small, features)
    found = nearest_neighbours(points, points, features, k + 1)
    near = found.select("point", weighed(F.col("neighbours"), k, F.col("point")).alias("near"))
    near = points.join(near, "point").select("near", *features)
    # the neighbour that holds the picked one of the k rows
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("long").alias("point"))
    picked = F.aggregate(
        "near", start,
        lambda a, x: F.when(a["rows"] > F.col("_pick"), a).otherwise(F.struct((a["rows"] + x["rows"]).alias("rows"), x["point"].alias("point"))),
    )["point"]
    others = points.select(F.col("point").alias("_other"), *[F.col(f).alias(f"_to_{f}") for f in features])
    paired = wanted.join(near, features, "left").withColumn("_other", picked).join(others, "_other", "left")
    made = {f: F.coalesce(F.col(f) + F.col("_step") * (F.col(f"_to_{f}") - F.col(f)), F.col(f)) for f in features}
    name = F.concat(F.col(key).cast("string"), F.lit("-S"), F.col("_copy").cast("string")).alias(key)
    synthetic = paired.select(name, *[c.alias(f) for f, c in made.items()], F.lit(minor).alias(label), F.lit(True).alias("synthetic"))
    original = rows.select(F.col(key).cast("string"), *[F.col(f).cast("double") for f in features], label)
    return original.withColumn("synthetic", F.lit(False)).unionByName(synthetic)


# --- models ------------------------------------------------------------------------


def estimator(name: str, features: int, **changes) -> Estimator:
    """One of the classifiers with its default settings."""
    common = {"featuresCol": "features", "labelCol": "label"}
    weighted = {**common, "weightCol": "class_weight"}
    if name == "random_forest":
        return RandomForestClassifier(**{**weighted, "numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 2, "maxMemoryInMB": 1024, "seed": 42, **changes})
    if name == "logistic_regression":
        return LogisticRegression(**{**weighted, "regParam": 0.01, "maxIter": 1000, **changes})
    if name == "gradient_boosting":
        settings = {"maxIter": 200, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
        return GBTClassifier(**{**weighted, **settings, **changes})
    if name == "neural_network":
        layers = [features, 100, 50, 2]
        return MultilayerPerceptronClassifier(**{**common, "layers": layers, "maxIter": 500, "seed": 42, **changes})
    if name == "linear_svm":
        return LinearSVC(**{**weighted, "regParam": 0.01, "maxIter": 1000, **changes})
    raise ValueError(f"unknown model {name}")


def pipeline(name: str, features: list[str], **changes) -> Pipeline:
    """Median imputation, assembly, scaling, then the classifier."""
    filled = [f"{f}_filled" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True),
            estimator(name, len(features), **changes),
        ]
    )


def prepared(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Double features, 0/1 ``label`` and ``class_weight``."""
    typed = rows.withColumns(
        {**{f: F.col(f).cast("double") for f in features}, "label": F.col(label).cast("double")}
    )
    return with_class_weight(typed, "label")


#: Fewer rows than this are trained on as they lie; no part of more holds over ``PART_ROWS``.
LEAST_TO_DEAL = 10_000
PART_ROWS = 200_000


def dealt_evenly(rows: DataFrame) -> DataFrame:
    """Rows in equal parts, at least one a core: each of very many passes takes as long as its largest part."""
    total = rows.count()
    if total < LEAST_TO_DEAL:
        return rows
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // PART_ROWS)))


def train(
    rows: DataFrame, name: str, features: list[str], label: str, penalty: float = 1.0, **changes
) -> PipelineModel:
    """Fit one classifier; linear models weigh their errors ``penalty`` times against the penalty term.

    MLlib divides the loss by the sum of the class weights, which is the number of rows. ``rows`` are read
    several times: they should be a stored table, or a part of one.
    """
    fit_rows = prepared(rows, features, label)
    if name in ("logistic_regression", "linear_svm"):
        changes.setdefault("regParam", 1 / (penalty * max(fit_rows.count(), 1)))
    if name == "neural_network":
        fit_rows = dealt_evenly(fit_rows)
    return pipeline(name, features, **changes).fit(fit_rows)


def fraud_probability(model: PipelineModel) -> Column:
    """Second class of the probability; a margin is mapped by the logistic curve."""
    last = model.stages[-1]
    if last.hasParam("probabilityCol"):
        return vector_to_array("probability")[1]
    margin = vector_to_array("rawPrediction")[1]
    return 1 / (1 + F.exp(-margin))


def predict(model: PipelineModel, rows: DataFrame, features: list[str], key: str, keep: list[str] | None = None) -> DataFrame:
    """Label, probability, confidence and band of every row."""
    typed = rows.withColumns({f: F.col(f).cast("double") for f in features})
    found = model.transform(typed).withColumn("fraud_probability", fraud_probability(model))
    p = F.col("fraud_probability")
    predicted = F.col("prediction").cast("long")
    band = F.when(predicted == 1, F.when(p > 0.8, "HIGH").otherwise("MEDIUM")).otherwise(
        F.when(1 - p > 0.8, "LOW").otherwise("MEDIUM")
    )
    return found.select(
        key, *(keep or []), predicted.alias("predicted"), p.alias("fraud_probability"),
        F.greatest(p, 1 - p).alias("confidence"), band.alias("band"),
    )


def soft_vote(predictions: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of saved probability columns, and the majority label."""
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    return predictions.withColumn("ensemble_probability", mean).withColumn(
        "ensemble_prediction", (F.col("ensemble_probability") >= 0.5).cast("long")
    )


# --- evaluation ----------------------------------------------------------------------


def confusion(rows: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit, truth = F.col(score) >= threshold, F.col(label).cast("boolean")

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = rows.agg(
        count(hit & truth).alias("tp"), count(hit & ~truth).alias("fp"),
        count(~hit & truth).alias("fn"), count(~hit & ~truth).alias("tn"),
    )
    return with_rates(counts)


def ranking_metrics(rows: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by rank sums and average precision, with ties taken together.

    Works on positives and negatives per distinct score, cumulated chunk by chunk.
    """
    truth = F.col(label).cast("boolean")
    groups = materialise(
        rows.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("falling")).agg(
            F.count(F.when(truth, 1)).alias("pos"), F.count(F.when(~truth, 1)).alias("neg")
        )
    )
    ranked = running_totals(groups, [], ["falling"], {"pos": "tp", "neg": "fp"})
    totals = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = float(totals["p"] or 0), float(totals["n"] or 0)
    concordant = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return ranked.agg(
        (F.sum(concordant) / F.lit(p * n)).alias("roc_auc"),
        (F.sum(F.col("pos") * precision) / F.lit(p)).alias("average_precision"),
    )


def evaluate(rows: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """All classification metrics in one row."""
    ranks = ranking_metrics(rows, score, label).first()
    return confusion(rows, score, label, threshold).withColumns(
        {c: F.lit(ranks[c]) for c in ("roc_auc", "average_precision")}
    )


def cross_validate(
    rows: DataFrame, key: str, name: str, features: list[str], label: str, folds: int = 5, **changes
) -> DataFrame:
    """Mean and deviation of every metric over stratified folds."""
    dealt = materialise(stratified_folds(rows.select(key, label, *features), key, label, folds))
    parts = []
    for fold in range(folds):
        model = train(dealt.where(F.col("fold") != fold), name, features, label, **changes)
        found = predict(model, dealt.where(F.col("fold") == fold), features, key, [label])
        parts.append(evaluate(found, "fraud_probability", label).withColumn("fold", F.lit(fold)))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    metrics = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "false_positive_rate"]
    long = together.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    )
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("folds")
    )


GRIDS = {
    "random_forest": {"numTrees": [10, 20], "maxDepth": [4, 8]},
    "logistic_regression": {"regParam": [0.001, 0.01, 0.1]},
    "gradient_boosting": {"maxDepth": [3, 5], "stepSize": [0.1, 0.2]},
}


def grid_search(
    rows: DataFrame, key: str, name: str, features: list[str], label: str,
    grid: dict[str, list] | None = None, folds: int = 3, parallelism: int = 4, **changes,
) -> tuple[PipelineModel, DataFrame]:
    """Best pipeline by ROC AUC over stratified folds, and the score of every setting."""
    steps = pipeline(name, features, **changes)
    last = steps.getStages()[-1]
    builder = ParamGridBuilder()
    grid = grid or GRIDS[name]
    for parameter, values in grid.items():
        builder = builder.addGrid(last.getParam(parameter), values)
    settings = builder.build()
    searcher = CrossValidator(
        estimator=steps, estimatorParamMaps=settings, numFolds=folds, parallelism=parallelism, foldCol="fold",
        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"),
    )
    dealt = materialise(prepared(stratified_folds(rows.select(key, label, *features), key, label, folds), features, label))
    fitted = searcher.fit(dealt)
    scores = [
        ("; ".join(sorted(f"{p.name}={v}" for p, v in setting.items())), float(score))
        for setting, score in zip(settings, fitted.avgMetrics)
    ]
    return fitted.bestModel, rows.sparkSession.createDataFrame(scores, "settings string, roc_auc double")


# --- importance, selection, targets ------------------------------------------------------


def model_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance per feature: impurity gain of trees, |coefficient| of linear models."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = np.abs(last.coefficients.toArray())
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def mean_importance(tables: list[DataFrame]) -> DataFrame:
    """Average over the models of an ensemble."""
    together = tables[0]
    for table in tables[1:]:
        together = together.unionByName(table)
    return together.groupBy("feature").agg(F.avg("importance").alias("importance"))


def mutual_information(rows: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of each binned feature with the label, in nats.

    Bins are of equal width between minimum and maximum.
    """
    spans = rows.agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def binned(c: str) -> Column:
        low, high = float(spans[f"{c}_lo"]), float(spans[f"{c}_hi"])
        width = (high - low) or 1.0
        place = F.least(F.floor((F.col(c) - low) / width * bins), F.lit(bins - 1)).cast("long")
        return F.when(F.col(c).isNotNull(), place)

    long = rows.select(
        F.col(label).cast("boolean").alias("y"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), binned(c).alias("bin")) for c in features])),
    ).where("bin IS NOT NULL")
    joint = long.groupBy("feature", "bin").agg(
        F.count(F.when(F.col("y"), 1)).alias("ones"), F.count(F.when(~F.col("y"), 1)).alias("zeros")
    )
    marginal = joint.groupBy("feature").agg(F.sum("ones").alias("one_total"), F.sum("zeros").alias("zero_total"))
    total = F.col("one_total") + F.col("zero_total")

    def term(part: str, whole: str) -> Column:
        expected = (F.col("ones") + F.col("zeros")) * F.col(whole) / total
        return F.when(F.col(part) > 0, F.col(part) / total * F.log(F.col(part) / expected)).otherwise(0.0)

    return (
        joint.join(F.broadcast(marginal), "feature")
        .groupBy("feature")
        .agg(F.sum(term("ones", "one_total") + term("zeros", "zero_total")).alias("mutual_information"))
    )


def common_features(tables: list[DataFrame]) -> list[str]:
    """Columns all tables share, in the order of the first."""
    return [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]


def target_check(metrics: DataFrame) -> DataFrame:
    """Whether each model meets the accuracy and false-positive targets."""
    accurate = F.col("accuracy") >= K.TARGET_ACCURACY
    quiet = F.col("false_positive_rate") <= K.TARGET_FPR
    return metrics.withColumns(
        {"meets_accuracy": accurate, "meets_fpr": quiet, "meets_targets": accurate & quiet}
    )


def best_model(metrics: DataFrame, by: str = "f1") -> DataFrame:
    return metrics.agg(F.max_by("model", F.struct(by, "model")).alias("best_model"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
