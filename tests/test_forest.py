"""The forest against a plain tree over all rows, and at a size that Spark's deep trees do not take."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulift.operators import forest
from tabulift.operators.estimators import fit_regressor
from tabulift.sources.models import load_model, save_model


def plain(x, y, w, depth):
    """A function from rows to the leaf values of one tree."""
    best = (1e-12 * w.sum() * np.ptp(y) ** 2, None, None)
    if depth and np.ptp(y):
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= t
                a, b = w[low].sum(), w[~low].sum()
                gain = a * b / w.sum() * ((w * y)[low].sum() / a - (w * y)[~low].sum() / b) ** 2
                if gain > best[0] * (1 + 1e-9):
                    best = gain, f, t
    if best[1] is None:
        value = (w * y).sum() / w.sum()
        return lambda rows: np.full(len(rows), value)
    _, f, t = best
    low = x[:, f] <= t
    left, right = (plain(x[m], y[m], w[m], depth - 1) for m in (low, ~low))
    return lambda rows: np.where(rows[:, f] <= t, left(rows), right(rows))


def _rows(n=300):
    r = np.random.default_rng(7)
    x = np.column_stack([r.integers(0, 40, n), r.integers(0, 5, n), np.full(n, 3)]).astype(np.uint8)
    return x, np.round(x[:, 0] * 0.7 - x[:, 1] ** 2 + r.normal(0, 2, n), 3), r.poisson(1.0, n).astype(np.uint8)


@pytest.mark.parametrize("depth", [0, 1, 4, 30])
def test_grown_as_a_plain_tree(depth):
    x, y, w = _rows()
    used = w > 0
    feature, bin_, left, value = forest.grow(x[used].T, w[used], y[used], depth)
    found = value[forest.descend(x.T, feature, bin_, left)]
    assert found == pytest.approx(plain(x[used].astype(float), y[used], w[used].astype(float), depth)(x.astype(float)).tolist(), rel=1e-9)


@pytest.mark.parametrize("local", [1 << 18, 60, 0])
def test_one_tree_without_samples(spark, monkeypatch, tmp_path, local):
    """Also when the upper levels, or all of them, are split on sums; and after saving."""
    monkeypatch.setattr(forest, "LOCAL_ROWS", local)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 20)
    x, y, _ = _rows()
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, a double, b double, same double, bins double").repartition(3)
    model = fit_regressor("Random Forest Regressor", df, ["a", "b", "same"], "bins", numTrees=1, bootstrap=False, maxDepth=9)
    again = load_model(save_model(model.model, "Random Forest Regressor", str(tmp_path)))
    expected = plain(x.astype(float), y, np.ones(len(y)), 9)(x.astype(float)).tolist()
    for out in (model.transform(df), again.transform(df)):
        assert [r["prediction"] for r in out.orderBy("k").collect()] == pytest.approx(expected, rel=1e-9)


def test_many_deep_trees_end(spark):
    """Twenty thousand rows and forty trees: Spark's own forest keeps sums of all bins for every one of its million nodes."""
    h = F.xxhash64("id")
    df = spark.range(20000).select((h % 50).cast("double").alias("a"), F.col("id").cast("double").alias("b"), (F.pmod(h, F.lit(977)) + F.col("id") % 31).cast("double").alias("y"))
    start = time.time()
    made = fit_regressor("Random Forest Regressor", df, ["a", "b"], "y", numTrees=40).transform(df)
    assert made.where("prediction is not null and prediction between 0 and 1010").count() == 20000
    assert time.time() - start < 60


@pytest.mark.parametrize("missing", ["null", "'NaN'"])
def test_missing_labels_fail(spark, missing):
    df = spark.range(10).selectExpr("double(id) AS a", f"CASE WHEN id = 3 THEN double({missing}) ELSE double(id) END AS y")
    with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
        fit_regressor("Random Forest Regressor", df, ["a"], "y", numTrees=2)
