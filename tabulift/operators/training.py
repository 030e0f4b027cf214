"""Training, evaluation and cross-validation of several models."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulift.functions.schema import col, free_name
from tabulift.operators import metrics, neighbours
from tabulift.operators.estimators import (
    CLASSIFIER_NEIGHBOURS,
    CLASSIFIERS,
    REGRESSOR_NEIGHBOURS,
    REGRESSORS,
    FittedClassifier,
    FittedRegressor,
    fit_classifier,
    fit_regressor,
)
from tabulift.operators.profile import smallest_class
from tabulift.operators.split import FOLDS, SEED, kfold, stratified_kfold
from tabulift.operators.target import BINARY, REGRESSION, is_classification
from tabulift.plans.scratch import held
from tabulift.sources.models import model_file_name


@dataclass(frozen=True)
class Scored:
    """A test table with actual and predicted values and, for classes, a score expression per class."""

    table: DataFrame
    label: str
    prediction: str
    scores: dict = field(default_factory=dict)


def catalogue(kind: str) -> tuple[str, ...]:
    if is_classification(kind):
        return CLASSIFIERS
    if kind == REGRESSION:
        return REGRESSORS
    raise ValueError(f"unsupported problem type: {kind}")


class _Neighbours:
    """Nearest-neighbour model: keeps the train table and joins it when asked for predictions."""

    def __init__(self, train: DataFrame, features, target: str, key: str, classes: bool):
        self.train, self.features, self.target, self.key, self.classes = train, features, target, key, classes

    def score(self, test: DataFrame) -> Scored:
        find = neighbours.knn_classifier if self.classes else neighbours.knn_regressor
        found = find(self.train, test, self.features, self.key, self.key, self.target)
        joined = test.select(col(self.key).alias("key"), col(self.target).alias("actual")).join(found, "key")
        if not self.classes:
            return Scored(joined, "actual", "prediction")
        table = joined.select(F.col("actual").cast("string").alias("actual"), F.col("prediction").cast("string").alias("predicted"), "votes")
        names = [r[0] for r in self.train.select(col(self.target).cast("string")).distinct().collect()]  # one per class
        return Scored(table, "actual", "predicted", {c: F.coalesce(F.try_element_at("votes", F.lit(c)), F.lit(0.0)) for c in names})


class _Pipeline:
    def __init__(self, fitted, target: str, classes: bool):
        self.fitted, self.target, self.classes = fitted, target, classes

    def score(self, test: DataFrame) -> Scored:
        made, predicted = self.fitted.transform(test), self.fitted.predicted(test)
        if not self.classes:
            return Scored(made, self.target, predicted)
        label = free_name(made.columns, "class_text")
        return Scored(made.withColumn(label, col(self.target).cast("string")), label, predicted, self.fitted.scores(test))


def fit_model(name: str, train: DataFrame, features: Sequence[str], target: str, kind: str, key: str | None = None, **overrides):
    """Fit one catalogue model; ``key`` (a unique column) is needed by the nearest-neighbour models."""
    classes = is_classification(kind)
    if name not in catalogue(kind):
        raise ValueError(f"{name} is not a model for: {kind}")
    if name in (CLASSIFIER_NEIGHBOURS, REGRESSOR_NEIGHBOURS):
        if key is None:
            raise ValueError("nearest neighbours need a key column")
        return _Neighbours(train, list(features), target, key, classes)
    fit = fit_classifier if classes else fit_regressor
    return _Pipeline(fit(name, train, features, target, **overrides), target, classes)


def save_trained(model, name: str, folder: str) -> str:
    """Write any model that ``fit_model`` gave, neighbours too, below ``folder`` and return its path."""
    path = f"{folder.rstrip('/')}/{model_file_name(name)}"
    about = {"target": model.target, "classes": model.classes}
    if isinstance(model, _Neighbours):
        spark = model.train.sparkSession
        model.train.select(*[col(c) for c in dict.fromkeys([model.key, *model.features, model.target])]).write.mode("overwrite").parquet(f"{path}/train")
        about |= {"key": model.key, "features": model.features}
    else:
        model.fitted.model.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        about |= {"features": list(model.fitted.features)}
        if model.classes:
            about |= {"labels": list(model.fitted.classes), "score_column": model.fitted.score_column}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load_trained(spark: SparkSession, path: str):
    """The model that ``save_trained`` wrote, with its classes and scores."""
    about = json.loads("".join(r[0] for r in spark.read.text(f"{path}/about").collect()))
    if "key" in about:
        return _Neighbours(spark.read.parquet(f"{path}/train"), about["features"], about["target"], about["key"], about["classes"])
    fitted = PipelineModel.load(f"{path}/pipeline")
    features = tuple(about["features"])
    made = FittedClassifier(fitted, tuple(about["labels"]), about["score_column"], features) if about["classes"] else FittedRegressor(fitted, features)
    return _Pipeline(made, about["target"], about["classes"])


def evaluate(scored: Scored, kind: str) -> dict[str, float | None]:
    """Metric values of one scored table. The model is applied once; the metrics read its kept scores."""
    scores = {c: f"score{i}" for i, c in enumerate(scored.scores)}
    used = scored.table.select(
        col(scored.label).alias("label"),
        col(scored.prediction).alias("prediction"),
        *[scored.scores[c].alias(name) for c, name in scores.items()],
    )
    with held(used) as rows:
        if not is_classification(kind):
            return metrics.regression_metrics(rows).first().asDict()
        values = metrics.classification_metrics(rows).first().asDict()
        if kind == BINARY and len(scores) == 2:
            positive = max(scores)
            values["roc_auc"] = metrics.roc_auc(rows, "label", scores[positive], positive).first()[0]
        elif scores:
            by_class = {c: F.col(name) for c, name in scores.items()}
            values["roc_auc_ovr"] = metrics.roc_auc_ovr(rows, "label", by_class).first()[0]
        return values


@dataclass(frozen=True)
class Training:
    """Fitted models, (model, metric, value) rows, (model, error) rows and a summary.

    For classes there are also (model, actual, predicted, n, of_actual, of_predicted) and (model, class, precision, recall, f1, support)
    rows. ``scored`` holds each model's test table with its score columns, for curves and for actual against predicted values.
    """

    models: dict[str, object]
    metrics: DataFrame
    errors: DataFrame
    message: str
    confusion: DataFrame | None = None
    report: DataFrame | None = None
    scored: dict[str, Scored] = field(default_factory=dict)


def _of_every_model(scored: dict[str, Scored], rows) -> DataFrame | None:
    parts = []
    for name, s in scored.items():
        pairs = s.table.select(col(s.label).cast("string").alias("label"), col(s.prediction).cast("string").alias("prediction"))
        parts.append(rows(pairs).select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def train_models(
    names: Sequence[str], train: DataFrame, test: DataFrame, features: Sequence[str], target: str, kind: str, key: str | None = None
) -> Training:
    """Fit and evaluate the named models; a model that fails is reported and does not stop the others."""
    spark = train.sparkSession
    train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
    fitted, rows, errors, scored = {}, [], [], {}
    whole = test
    for name in names:
        try:
            model = fit_model(name, train, features, target, kind, key)
            values = evaluate(model.score(test), kind)
        except Exception as problem:  # noqa: BLE001 - one bad model must not lose the others
            errors.append((name, f"{type(problem).__name__}: {problem}"))
            continue
        fitted[name] = model
        scored[name] = model.score(whole)
        rows += [(name, m, None if v is None else float(v)) for m, v in values.items()]
    train.unpersist()
    test.unpersist()
    message = f"trained {len(fitted)} of {len(names)} model(s)" if names else "no models selected"
    return Training(
        fitted,
        spark.createDataFrame(rows, "model string, metric string, value double"),
        spark.createDataFrame(errors, "model string, error string"),
        message,
        _of_every_model(scored, metrics.confusion_cells) if is_classification(kind) else None,
        _of_every_model(scored, metrics.classification_report) if is_classification(kind) else None,
        scored,
    )


FOLD_SCHEMA = "model string, fold int, metric string, test double, train double"


def fold_scores(
    name: str,
    folded: DataFrame,
    features: Sequence[str],
    target: str,
    kind: str,
    key: str | None,
    folds: int,
    parallelism: int = 2,
    column: str = "fold",
) -> list[tuple]:
    """(model, fold, metric, test, train) rows of one model, fit and score times among the metrics. ``column`` holds the folds."""

    def one(fold: int) -> list[tuple]:
        train, test = folded.filter(col(column) != fold), folded.filter(col(column) == fold)
        start = time.perf_counter()
        model = fit_model(name, train, features, target, kind, key)
        fit_time = time.perf_counter() - start
        start = time.perf_counter()
        on_test = evaluate(model.score(test), kind)
        score_time = time.perf_counter() - start
        on_train = evaluate(model.score(train), kind)
        rows = [(name, fold, m, v, on_train[m]) for m, v in on_test.items()]
        return [*rows, (name, fold, "fit_time", fit_time, None), (name, fold, "score_time", score_time, None)]

    pool = ThreadPool(max(1, min(parallelism, folds)))
    try:
        return [row for rows in pool.map(inheritable_thread_target(one), range(folds)) for row in rows]
    finally:
        pool.close()


def summarise_folds(scores: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the test scores, mean of the train scores and their gap."""
    means = scores.groupBy("model", "metric").agg(
        F.avg("test").alias("mean"), F.stddev_pop("test").alias("std"), F.avg("train").alias("train_mean")
    )
    return overfit_gap(means)


def overfit_gap(summary: DataFrame) -> DataFrame:
    """Add train mean minus test mean; times have no train value and therefore no gap."""
    return summary.withColumn("overfit", F.col("train_mean") - F.col("mean"))


@dataclass(frozen=True)
class CrossValidation:
    scores: DataFrame
    summary: DataFrame
    errors: DataFrame
    message: str


def cross_validate(
    names: Sequence[str],
    df: DataFrame,
    features: Sequence[str],
    target: str,
    kind: str,
    key: str,
    folds: int = FOLDS,
    parallelism: int = 2,
    seed: int = SEED,
) -> CrossValidation:
    """Cross-validate the named models on class-balanced folds, or plain folds where classes are too small or absent."""
    spark = df.sparkSession
    catalogue(kind)
    if is_classification(kind) and smallest_class(df, target) >= folds:
        folded, note = stratified_kfold(df, target, key, folds, seed), "class-balanced folds"
    else:
        folded, note = kfold(df, key, folds, seed), "plain folds"
    # The folds follow from the key, so partitions that are lost and computed again are the same.
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    rows, errors = [], []
    for name in names:
        try:
            rows += fold_scores(name, folded, features, target, kind, key, folds, parallelism, free_name(df.columns, "fold"))
        except Exception as problem:  # noqa: BLE001 - one bad model must not lose the others
            errors.append((name, f"{type(problem).__name__}: {problem}"))
    folded.unpersist()
    scores = spark.createDataFrame(rows, FOLD_SCHEMA)
    return CrossValidation(
        scores, summarise_folds(scores), spark.createDataFrame(errors, "model string, error string"), f"{note}; {len(errors)} failed"
    )
