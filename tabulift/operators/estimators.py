"""The model catalogue: each entry maps the defaults a user expects to parameters of Spark ML estimators.

The two nearest-neighbour models are joins, not estimators (see ``neighbours``); ``training`` runs them beside these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulift.functions.schema import col, double_value, free_name
from tabulift.operators.boosting import BoostedTrees
from tabulift.operators.forest import BINS, RegressionForest
from tabulift.operators.kernel import RandomFourierFeatures, dealt_for_kernel, fit_support_vector_regressor, scale_gamma

# Settings of the models.
SEED = 42
LOGISTIC_ITERATIONS = 2000
TREES = 100
BOOSTING = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
DEEPEST_TREE = 30  # the deepest that Spark grows; stands for unbounded
PENALTY = 1.0
FOREST_SETTINGS = {"numTrees", "maxDepth", "maxBins", "bootstrap", "seed"}  # others are those of Spark's own forest

# How trees are grown: fine bins, and node ids kept between levels so that deep trees do not replay their splits.
GROWING = {"maxBins": 256, "cacheNodeIds": True, "maxMemoryInMB": 1024, "seed": SEED}

# Names of the models.
CLASSIFIERS = (
    "Logistic Regression",
    "Random Forest Classifier",
    "Gradient Boosting Classifier",
    "Support Vector Classifier",
    "K-Nearest Neighbors Classifier",
    "Decision Tree Classifier",
    "Gaussian Naive Bayes",
)
REGRESSORS = (
    "Linear Regression",
    "Ridge Regression",
    "Lasso Regression",
    "Random Forest Regressor",
    "Gradient Boosting Regressor",
    "Support Vector Regressor (SVR)",
    "K-Nearest Neighbors Regressor",
    "Decision Tree Regressor",
)
CLASSIFIER_NEIGHBOURS = "K-Nearest Neighbors Classifier"
REGRESSOR_NEIGHBOURS = "K-Nearest Neighbors Regressor"


class Names:
    """The columns that a pipeline adds, each with a name that no feature has."""

    def __init__(self, features: Sequence[str]):
        self.features, self.label, self.class_text, self.prediction, self.raw, self.probability, self.predicted, self.lifted, self.platt_raw, self.platt = (
            free_name(features, n)
            for n in (
                "features", "label", "class_text", "prediction", "rawPrediction", "probability", "predicted", "kernel_features", "platt_raw",
                "platt_prediction",
            )
        )

    def of_classifier(self) -> dict[str, str]:
        return {"featuresCol": self.features, "labelCol": self.label, "predictionCol": self.prediction, "rawPredictionCol": self.raw}

    def of_regressor(self) -> dict[str, str]:
        return {"featuresCol": self.features, "labelCol": self.label, "predictionCol": self.prediction}


def _applied(model: PipelineModel, df: DataFrame, features: Sequence[str], added: dict[str, str]) -> DataFrame:
    """The table with columns of a pipeline, ``added`` under the names it tells. The pipeline sees the features only, so other columns may have any name."""
    row = free_name(features, "row")
    inputs = [col(f) for f in dict.fromkeys(features)]
    made = model.transform(df.select(F.struct(*[col(c) for c in df.columns]).alias(row), *inputs))
    return made.select(*[F.col(row).getField(c).alias(c) for c in df.columns], *[col(c).alias(n) for c, n in added.items()])


@dataclass(frozen=True)
class FittedClassifier:
    """A fitted pipeline that adds ``predicted`` (class as text) and a score column, with underscores if the table has columns of these names."""

    model: PipelineModel
    classes: tuple[str, ...]
    score_column: str
    features: tuple[str, ...]

    def _added(self, df: DataFrame) -> dict[str, str]:
        predicted = free_name(df.columns, "predicted")
        return {Names(self.features).predicted: predicted, self.score_column: free_name([*df.columns, predicted], self.score_column)}

    def transform(self, df: DataFrame) -> DataFrame:
        return _applied(self.model, df, self.features, self._added(df))

    def predicted(self, df: DataFrame) -> str:
        """The name of the predictions for a table."""
        return self._added(df)[Names(self.features).predicted]

    def scores(self, df: DataFrame | None = None) -> dict[str, Column]:
        """Score expression per class over the transformed table (of ``df``, if its names matter)."""
        scores = vector_to_array(col(self.score_column if df is None else self._added(df)[self.score_column]))
        return {c: F.get(scores, i) for i, c in enumerate(self.classes)}


@dataclass(frozen=True)
class FittedRegressor:
    """A fitted pipeline that adds ``prediction``, with underscores if the table has a column of this name."""

    model: PipelineModel
    features: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return _applied(self.model, df, self.features, {Names(self.features).prediction: self.predicted(df)})

    def predicted(self, df: DataFrame) -> str:
        return free_name(df.columns, "prediction")


def _classifier_stages(name: str, df: DataFrame, features: Sequence[str], classes: int, overrides: dict) -> tuple[list, str]:
    """Estimator stages over the vector of features and the label, and the name of their score column."""
    names = Names(features)
    common = names.of_classifier()

    def with_(defaults: dict) -> dict:
        return {**common, **defaults, **overrides}

    probable = {"probabilityCol": names.probability}
    if name == "Logistic Regression":
        strength = PENALTY / max(1, df.count())
        settings = {"regParam": strength, "standardization": False, "maxIter": LOGISTIC_ITERATIONS, **probable}
        return [LogisticRegression(**with_(settings))], names.probability
    if name == "Random Forest Classifier":
        return [RandomForestClassifier(**with_({"numTrees": TREES, "maxDepth": DEEPEST_TREE, **GROWING, **probable}))], names.probability
    if name == "Decision Tree Classifier":
        return [DecisionTreeClassifier(**with_({"maxDepth": DEEPEST_TREE, **GROWING, **probable}))], names.probability
    if name == "Gaussian Naive Bayes":
        return [NaiveBayes(**with_({"modelType": "gaussian", **probable}))], names.probability
    if name == "Gradient Boosting Classifier":
        return [BoostedTrees(**with_({**BOOSTING, **probable, "inputs": len(features), "classes": classes}))], names.probability
    if name == "Support Vector Classifier":
        lift = RandomFourierFeatures(
            inputCol=names.features, outputCol=names.lifted, gamma=scale_gamma(df, features), inputs=len(features), seed=SEED
        )
        strength = 1.0 / (PENALTY * max(1, df.count()))
        on_lifted = {**common, "featuresCol": names.lifted}
        margin = LinearSVC(**{**on_lifted, "regParam": strength, "standardization": False, "maxIter": 100, **overrides})
        separator = margin if classes <= 2 else OneVsRest(classifier=margin, **on_lifted)
        # Probabilities by a logistic model on the margins (Platt, 1999).
        platt = LogisticRegression(
            featuresCol=names.raw, labelCol=names.label, rawPredictionCol=names.platt_raw, predictionCol=names.platt, **probable
        )
        return [lift, separator, platt], names.probability
    raise ValueError(f"unknown classifier: {name}")


def fit_classifier(name: str, df: DataFrame, features: Sequence[str], target: str, **overrides) -> FittedClassifier:
    """Fit a catalogue classifier on numeric features. Keyword arguments override its Spark parameters. Columns may have any names."""
    names, features = Names(features), tuple(features)
    inputs = [col(f) for f in dict.fromkeys(features)]
    train = df.select(*inputs, col(target).cast("string").alias(names.class_text))
    indexer = StringIndexer(inputCol=names.class_text, outputCol=names.label, stringOrderType="alphabetAsc", handleInvalid="error").fit(train)
    classes = tuple(indexer.labels)
    assembler = VectorAssembler(inputCols=list(features), outputCol=names.features, handleInvalid="error")
    stages, score = _classifier_stages(name, train, features, len(classes), overrides)
    back = IndexToString(inputCol=names.prediction, outputCol=names.predicted, labels=list(classes))
    indexed = indexer.transform(train)
    if name == "Support Vector Classifier":
        indexed = dealt_for_kernel(indexed, indexed.count())
    fitted = Pipeline(stages=[assembler, *stages, back]).fit(indexed)
    return FittedClassifier(fitted, classes, score, features)


def _regressor(name: str, df: DataFrame, target: str, names: Names, inputs: int, overrides: dict):
    common = names.of_regressor()

    def with_(defaults: dict) -> dict:
        return {**common, **defaults, **overrides}

    if name == "Linear Regression":
        return LinearRegression(**with_({"regParam": 0.0, "solver": "normal"}))
    if name == "Ridge Regression":
        # Spark divides the squared penalty by the spread of the label, so the strength is multiplied by it.
        n, spread = df.agg(F.count(F.lit(1)), F.stddev_pop(double_value(df, target))).first()
        strength = PENALTY * (spread or 0.0) / max(1, n)
        return LinearRegression(**with_({"regParam": strength, "elasticNetParam": 0.0, "standardization": False, "solver": "normal"}))
    if name == "Lasso Regression":
        return LinearRegression(**with_({"regParam": PENALTY, "elasticNetParam": 1.0, "standardization": False, "maxIter": 1000}))
    if name == "Random Forest Regressor":
        if set(overrides) <= FOREST_SETTINGS and overrides.get("maxBins", 0) <= BINS:
            return RegressionForest(**with_({"numTrees": TREES, "maxDepth": DEEPEST_TREE, "seed": SEED, "inputs": inputs}))
        return RandomForestRegressor(
            **with_({"numTrees": TREES, "maxDepth": DEEPEST_TREE, "featureSubsetStrategy": "all", **GROWING})
        )
    if name == "Decision Tree Regressor":
        return DecisionTreeRegressor(**with_({"maxDepth": DEEPEST_TREE, **GROWING}))
    if name == "Gradient Boosting Regressor":
        return BoostedTrees(**with_({**BOOSTING, "inputs": inputs}))
    raise ValueError(f"unknown regressor: {name}")


def fit_regressor(name: str, df: DataFrame, features: Sequence[str], target: str, **overrides) -> FittedRegressor:
    """Fit a catalogue regressor on numeric features. Keyword arguments override its parameters."""
    names, features = Names(features), tuple(features)
    if name == "Support Vector Regressor (SVR)":
        return FittedRegressor(fit_support_vector_regressor(df, features, target, seed=SEED, names=names, **overrides), features)
    assembler = VectorAssembler(inputCols=list(features), outputCol=names.features, handleInvalid="error")
    train = df.select(*[col(f) for f in dict.fromkeys(features)], double_value(df, target).alias(names.label))
    return FittedRegressor(Pipeline(stages=[assembler, _regressor(name, df, target, names, len(features), overrides)]).fit(train), features)
