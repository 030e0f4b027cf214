"""Boosting against a plain version that looks at all rows, and models that are saved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulift.operators import boosting
from tabulift.operators.estimators import fit_classifier, fit_regressor
from tabulift.plans.quantiles import split_points
from tabulift.sources.models import load_model, save_model


def plain_tree(x, g, h, depth, scale):
    """A function from rows to leaf values."""
    best = None
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= t
                a, b = g[low], g[~low]
                gain = len(a) * len(b) / len(g) * (a.mean() - b.mean()) ** 2
                if best is None or gain > best[0] * (1 + 1e-9) + 1e-13:
                    best = gain, f, t
    if best is None or best[0] <= 1e-12:
        value = scale * g.sum() / h.sum() if h.sum() > 1e-150 else 0.0
        return lambda rows: np.full(len(rows), value)
    _, f, t = best
    low = x[:, f] <= t
    left, right = (plain_tree(x[m], g[m], h[m], depth - 1, scale) for m in (low, ~low))
    return lambda rows: np.where(rows[:, f] <= t, left(rows), right(rows))


def plain_scores(x, y, classes, rounds, depth):
    if not classes:
        scores, scale = np.full((len(x), 1), y.mean()), 1.0
    elif classes == 2:
        scores, scale = np.full((len(x), 1), np.log(y.mean() / (1 - y.mean()))), 1.0
    else:
        scores, scale = np.tile(np.log([np.mean(y == k) for k in range(classes)]), (len(x), 1)), (classes - 1) / classes
    for _ in range(rounds):
        g, h = boosting.gradients(scores, y, classes)
        scores = scores + 0.1 * np.column_stack([plain_tree(x, g[:, k], h[:, k], depth, scale)(x) for k in range(scores.shape[1])])
    return scores


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 40, 500) / 3, r.integers(0, 9, 500), np.full(500, 2.0), r.normal(0, 1, 500).round(1)])
    number = 3 * np.sin(x[:, 0]) + x[:, 1] + r.normal(0, 0.3, 500)
    three = np.digitize(number + r.normal(0, 1, 500), [1.5, 5.0])
    rows = [(i, *map(float, row), float(n), f"c{c}", f"t{int(n > 3)}") for i, (row, n, c) in enumerate(zip(x, number, three))]
    df = spark.createDataFrame(rows, "k int, a double, b double, same double, d double, number double, three string, two string").repartition(5)
    return df, x, number, three


FEATURES = ["a", "b", "same", "d"]


@pytest.mark.parametrize("target,classes", [("number", 0), ("two", 2), ("three", 3)])
@pytest.mark.parametrize("depth,rounds,written", [(3, 4, 3), (1, 3, 10)])
def test_same_as_all_rows(points, monkeypatch, target, classes, depth, rounds, written):
    monkeypatch.setattr(boosting, "WRITTEN", written)
    df, x, number, three = points
    y = {"number": number, "two": (number > 3).astype(float), "three": three.astype(float)}[target]
    expected = plain_scores(x, y, classes, rounds, depth)
    settings = {"maxDepth": depth, "maxIter": rounds}
    if not classes:
        model = fit_regressor("Gradient Boosting Regressor", df, FEATURES, target, **settings)
        found = [r["prediction"] for r in model.transform(df).orderBy("k").collect()]
        assert found == pytest.approx(expected[:, 0].tolist(), rel=1e-9)
        return
    model = fit_classifier("Gradient Boosting Classifier", df, FEATURES, target, **settings)
    made = model.transform(df).orderBy("k").select("predicted", *[p.alias(f"p{i}") for i, p in enumerate(model.scores().values())]).collect()
    p = 1 / (1 + np.exp(-expected)) if classes == 2 else np.exp(expected) / np.exp(expected).sum(axis=1, keepdims=True)
    p = np.column_stack([1 - p, p]) if classes == 2 else p
    assert np.array([r[1:] for r in made]) == pytest.approx(p, rel=1e-8)
    assert [r["predicted"] for r in made] == [model.classes[i] for i in p.argmax(axis=1)]


def test_saved_trees(spark, points, tmp_path):
    df = points[0]
    model = fit_classifier("Gradient Boosting Classifier", df, FEATURES, "three", maxIter=3)
    again = load_model(save_model(model.model, "Gradient Boosting Classifier", str(tmp_path)))
    first, second = (m.transform(df).select("k", "predicted").orderBy("k").collect() for m in (model, again))
    assert first == second


def test_classes_that_need_no_tree(spark):
    df = spark.range(20).select(F.lit(1.0).alias("x"), F.when(F.col("id") < 15, "a").otherwise("b").alias("y"))
    made = fit_classifier("Gradient Boosting Classifier", df, ["x"], "y", maxIter=2).transform(df)
    assert {r["predicted"] for r in made.collect()} == {"a"}
    one = df.where("y = 'a'")
    assert {r["predicted"] for r in fit_classifier("Gradient Boosting Classifier", one, ["x"], "y", maxIter=2).transform(one).collect()} == {"a"}


def test_points_between_values(spark):
    df = spark.range(5000).select((F.col("id") % 5).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(None).cast("double").alias("none"))
    few, many, none = split_points(df, [F.col(c) for c in ("few", "many", "none")], 64)
    assert few == [0.5, 1.5, 2.5, 3.5] and none == []
    assert 50 < len(many) < 64 and many == sorted(set(many))


def test_rounds_use_all_cores(points, monkeypatch):
    """Also for a table that one task would read; and no task gets more rows when the table grows."""
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    parts, kept = [], boosting.durable
    monkeypatch.setattr(boosting, "durable", lambda df: parts.append(df.rdd.getNumPartitions()) or kept(df))
    fit_regressor("Gradient Boosting Regressor", points[0].coalesce(1), FEATURES, "number", maxIter=1)
    assert parts[0] == 13
