"""Models beat the constant baseline; neighbours equal brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulift.operators import kernel, metrics, neighbours, split, training
from tabulift.operators.estimators import CLASSIFIERS, REGRESSORS, fit_classifier, fit_regressor
from tabulift.operators.target import BINARY, MULTICLASS, REGRESSION
from tabulift.sources.models import load_model, model_file_name, save_model

FEATURES = ["a", "b"]
FEW = {"numTrees": 10, "maxDepth": 6}
LIGHT = {
    "Random Forest Classifier": FEW, "Random Forest Regressor": FEW, "Gradient Boosting Classifier": {"maxIter": 5},
    "Gradient Boosting Regressor": {"maxIter": 20}, "Support Vector Classifier": {"maxIter": 20}, "Support Vector Regressor (SVR)": {"rounds": 6},
}


@pytest.fixture(scope="module")
def points(spark):
    random = np.random.default_rng(5)
    xy = random.uniform(-2, 2, (600, 2))
    number = 30 * np.sin(xy[:, 0]) + 10 * xy[:, 1] + random.normal(0, 1, 600)
    rows = [
        (i, float(a), float(b), float(z), int(a + b > 0), ("low", "mid", "top")[int(a > -0.7) + int(a > 0.7)])
        for i, ((a, b), z) in enumerate(zip(xy, number))
    ]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, z double, two int, three string").repartition(3).persist()
    yield split.train_test_split(df, "two", "k")
    df.unpersist()


@pytest.mark.parametrize("name", CLASSIFIERS)
@pytest.mark.parametrize("target,kind", [("two", BINARY), ("three", MULTICLASS)])
def test_classifiers_beat_the_constant(points, name, target, kind):
    model = training.fit_model(name, points.train, FEATURES, target, kind, "k", **LIGHT.get(name, {}))
    values = training.evaluate(model.score(points.test), kind)
    share = points.test.groupBy(target).count().agg(F.max("count") / F.sum("count")).first()[0]
    assert values["accuracy"] > share + 0.1
    assert values["roc_auc" if kind == BINARY else "roc_auc_ovr"] > 0.75


@pytest.mark.parametrize("name", REGRESSORS)
def test_regressors_beat_the_constant(points, name):
    model = training.fit_model(name, points.train, FEATURES, "z", REGRESSION, "k", **LIGHT.get(name, {}))
    assert training.evaluate(model.score(points.test), REGRESSION)["r2"] > 0.5


def test_save_and_load(spark, points, tmp_path):
    assert model_file_name("Support Vector Classifier") == "support_vector_classifier_trained_model"
    model = fit_classifier("Support Vector Classifier", points.train, FEATURES, "two", maxIter=5)
    path = save_model(model.model, "Support Vector Classifier", str(tmp_path))
    first = model.transform(points.test).select("k", "predicted").collect()
    again = load_model(path).transform(points.test).select("k", "predicted").collect()
    assert sorted(first) == sorted(again)


@pytest.mark.parametrize("name,target", [("Support Vector Classifier", "two"), ("Support Vector Regressor (SVR)", "z")])
def test_kernel_features_are_in_small_parts(points, monkeypatch, name, target):
    """Also of a table that one task would read, as a small file is."""
    monkeypatch.setattr(kernel, "TASK_NUMBERS", 20 * kernel.DIMENSIONS)
    parts, mapped = [], kernel.RandomFourierFeatures._transform
    monkeypatch.setattr(kernel.RandomFourierFeatures, "_transform", lambda self, df: parts.append(df.rdd.getNumPartitions()) or mapped(self, df))
    train = points.train.coalesce(1)
    fit_classifier(name, train, FEATURES, target, maxIter=2) if target == "two" else fit_regressor(name, train, FEATURES, target, rounds=2)
    assert parts[0] >= train.count() / 20


def test_ridge_equals_the_closed_form(points):
    data = np.array([(r["a"], r["b"], r["z"]) for r in points.train.collect()])
    x, y = data[:, :2] - data[:, :2].mean(axis=0), data[:, 2] - data[:, 2].mean()
    expected = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
    found = fit_regressor("Ridge Regression", points.train, FEATURES, "z").model.stages[-1].coefficients
    assert list(found) == pytest.approx(list(expected), rel=1e-6)


def test_one_failing_model_does_not_stop_the_others(points):
    done = training.train_models(["Linear Regression", "no such model"], points.train, points.test, FEATURES, "z", REGRESSION, "k")
    assert list(done.models) == ["Linear Regression"]
    assert [r["model"] for r in done.errors.collect()] == ["no such model"]
    assert {r["metric"] for r in done.metrics.collect()} == {"r2", "mae", "mse", "rmse"}


@pytest.mark.parametrize("name", ["Gaussian Naive Bayes", "K-Nearest Neighbors Classifier"])
def test_saved_classifiers_score_as_before(spark, points, tmp_path, name):
    model = training.fit_model(name, points.train, FEATURES, "two", BINARY, "k")
    again = training.load_trained(spark, training.save_trained(model, name, str(tmp_path)))
    assert training.evaluate(again.score(points.test), BINARY) == training.evaluate(model.score(points.test), BINARY)


def test_trained_models_have_cells_and_reports(points):
    done = training.train_models(["Gaussian Naive Bayes"], points.train, points.test, FEATURES, "two", BINARY, "k")
    assert sum(r["n"] for r in done.confusion.collect()) == points.test.count()
    assert {r["class"] for r in done.report.collect()} >= {"0", "1", "accuracy"}
    assert set(done.scored) == {"Gaussian Naive Bayes"}


def test_cross_validation(points):
    done = training.cross_validate(["Linear Regression"], points.table, FEATURES, "z", REGRESSION, "k", folds=3)
    rows = {r["metric"]: r for r in done.summary.collect()}
    assert rows["r2"]["mean"] > 0.5 and abs(rows["r2"]["overfit"]) < 0.1
    assert rows["fit_time"]["overfit"] is None
    assert done.errors.count() == 0 and done.message.startswith("plain folds")


def _brute(train, test, k):
    out = {}
    for key, *p in test:
        ranked = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, *q in train)
        out[key] = [j for _, j in ranked[:k]]
    return out


@pytest.mark.parametrize("box_rows", [20_000, 40])
def test_neighbours_equal_brute_force(spark, monkeypatch, box_rows):
    """Also with many boxes, a third of all rows at one point, and ties between keys."""
    monkeypatch.setattr(neighbours, "BOX_ROWS", box_rows)
    random = np.random.default_rng(11)
    places = np.round(np.concatenate([random.normal(0, 5, (600, 2)), np.full((300, 2), 1.0)]), 1)
    train = [(i, float(a), float(b)) for i, (a, b) in enumerate(places)]
    test = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(random.normal(0, 6, (200, 2)), 1))]
    test += [(200 + i, 1.0, 1.0) for i in range(100)]
    schema = "k bigint, a double, b double"
    left = spark.createDataFrame(train, schema).withColumn("y", F.col("k"))
    found = neighbours.nearest(left, spark.createDataFrame(test, schema), FEATURES, "k", "k", "y", k=4).collect()
    lists = {}
    for r in sorted(found, key=lambda r: (r["test_key"], r["place"])):
        lists.setdefault(r["test_key"], []).append(r["train_key"])
    assert lists == _brute(train, test, 4)


def test_fewer_train_rows_than_neighbours(spark):
    train = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 7.0)], "k bigint, a double, y double")
    test = spark.createDataFrame([(9, 0.2)], "k bigint, a double")
    assert neighbours.knn_regressor(train, test, ["a"], "k", "k", "y").first()["prediction"] == 6.0


def test_regression_metrics_of_a_perfect_model(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("label"), F.col("id").cast("double").alias("prediction"))
    assert tuple(metrics.regression_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0)
