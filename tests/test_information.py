"""Neighbour estimates of mutual information against brute force on the same prepared values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulift.plans import ranks
from tabulift.operators import importance, information


def _digamma(x):
    return np.array([information.digamma_number(int(v)) for v in x])


def test_digamma(spark):
    values = [1, 2, 3, 10, 1000]
    harmonic = [-0.5772156649015329 + sum(1 / i for i in range(1, v)) for v in values]
    assert [information.digamma_number(v) for v in values] == pytest.approx(harmonic, abs=1e-9)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert [r[0] for r in df.select(information.digamma(F.col("v"))).collect()] == pytest.approx(harmonic, abs=1e-9)


def _brute_classes(x, y, k=3):
    kept = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[kept], y[kept]
    m, ks, sizes = [], [], []
    for i in range(len(x)):
        same = np.sort(np.abs(x[y == y[i]] - x[i]))
        kk = min(k, len(same) - 1)
        m.append(np.sum(np.abs(x - x[i]) < same[kk]))
        ks.append(kk)
        sizes.append(len(same))
    return max(0.0, information.digamma_number(len(x)) + _digamma(ks).mean() - _digamma(sizes).mean() - _digamma(m).mean())


def _brute_numbers(x, y, k=3):
    far = np.maximum(np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None]))
    r = np.sort(far, axis=1)[:, k]
    nx = (np.abs(x[:, None] - x[None]) < r[:, None]).sum(axis=1)
    ny = (np.abs(y[:, None] - y[None]) < r[:, None]).sum(axis=1)
    return max(0.0, information.digamma_number(len(x)) + information.digamma_number(k) - _digamma(nx).mean() - _digamma(ny).mean())


@pytest.fixture(scope="module")
def table(spark):
    random = np.random.default_rng(2)
    a, b = random.normal(0, 1, 700), random.integers(0, 5, 700)
    a[:230] = 0.25  # a third of the rows at one value
    c = np.where(a + random.normal(0, 0.5, 700) > 0.3, "up", "down")
    c[0], c[1], c[2] = "single", "pair", "pair"
    z = 2 * a + random.normal(0, 0.3, 700)
    rows = [(i, float(p), float(q), str(r), float(s)) for i, (p, q, r, s) in enumerate(zip(a, b, c, z))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c string, z double").repartition(3)


@pytest.mark.parametrize("block", [100_000, 50])
def test_class_estimate(table, monkeypatch, block):
    monkeypatch.setattr(information, "BLOCK_ROWS", block)
    values = information._prepared(table, ["a", "b"], "id")
    rows = table.select(values["a"].alias("a"), values["b"].alias("b"), "c").collect()
    found = {r[0]: r[1] for r in information.neighbour_classification(table, "c", "id", ["a", "b"]).collect()}
    y = np.array([r["c"] for r in rows])
    for n in ("a", "b"):
        assert found[n] == pytest.approx(_brute_classes(np.array([r[n] for r in rows]), y), abs=1e-9)
    assert found["a"] > found["b"]


def test_number_estimate(table):
    values = information._prepared(table, ["a", "b", "z"], "id")
    rows = table.select(*[values[n].alias(n) for n in "abz"]).collect()
    found = {r[0]: r[1] for r in information.neighbour_regression(table, "z", "id", ["a", "b"]).collect()}
    z = np.array([r["z"] for r in rows])
    for n in ("a", "b"):
        assert found[n] == pytest.approx(_brute_numbers(np.array([r[n] for r in rows]), z), abs=1e-9)


def test_importance_with_neighbours(table):
    rows = importance.feature_importance(table.select("id", "a", "b", "c"), "c", neighbours_key="id").collect()
    assert [r["feature"] for r in rows] == ["a", "b"]


def test_ranges_follow_the_rows(spark, monkeypatch):
    """The tasks that sort the rows grow in number, not in size, whatever number of partitions the session shuffles into."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 100)
    df = spark.range(4000).select(((F.col("id") * 37) % 4001).cast("double").alias("x"), (F.col("id") % 2).alias("g"), F.lit(1).alias("one"))
    made = ranks.running_totals(df, "x", {"one": "before"}, by=["g"], rows=4000)
    plan = made._sc._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
    shuffles = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(shuffles) == 1 and ", 80)" in shuffles[0] and plan.count("Exchange hashpartitioning") == 3  # and two of the totals
    for g in (0, 1):
        assert [r["before"] for r in made.where(f"g = {g}").orderBy("x").collect()] == list(range(2000))
    assert ranks._range_count(df, 4000) == 40
