"""Quantiles, ranks and running totals against brute force, with limits lowered so that every path runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulift.plans import quantiles, ranks

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _samples():
    random = np.random.default_rng(7)
    return {
        "spread": random.normal(0, 1, 5000),
        "outliers": np.concatenate([random.normal(0, 1, 4990), random.normal(0, 1e12, 10)]),
        "hot": np.concatenate([np.full(2500, 3.0), random.normal(3, 1, 2500)]),
        "few": random.integers(0, 4, 5000).astype(float),
        "constant": np.full(5000, 7.0),
    }


@pytest.mark.parametrize("pick_rows", [1 << 20, 20])
def test_exact_quantiles(spark, monkeypatch, pick_rows):
    monkeypatch.setattr(quantiles, "PICK_ROWS", pick_rows)
    samples = _samples()
    rows = [tuple(map(float, r)) for r in zip(*samples.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in samples)).repartition(5)
    found = quantiles.exact_quantiles(df, {n: F.col(n) for n in samples}, PROBABILITIES)
    for name, values in samples.items():
        expected = np.quantile(values, PROBABILITIES)
        assert [found[name].at[p] for p in PROBABILITIES] == pytest.approx(list(expected), rel=1e-12, abs=1e-12), name
        assert found[name].count == 5000


def test_quantiles_survive_a_wrong_sketch(spark, monkeypatch):
    """Brackets that miss the rank are widened; the result stays exact."""
    real = quantiles._sketch
    calls = []

    def misleading(df, values, probes):
        calls.append(1)
        out = real(df, values, probes)
        if len(calls) == 1:
            out = [(n, lo, hi, [hi] * len(q)) for n, lo, hi, q in out]
        return out

    monkeypatch.setattr(quantiles, "_sketch", misleading)
    monkeypatch.setattr(quantiles, "PICK_ROWS", 50)
    values = np.random.default_rng(1).normal(0, 1, 3000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5])
    assert found["x"].at[0.25] == pytest.approx(np.quantile(values, 0.25))
    assert len(calls) > 1


def test_quantiles_of_little_or_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    found = quantiles.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert found["a"].count == 0 and found["a"].at[0.5] is None
    assert found["b"].at[0.5] == 1.0
    empty = quantiles.exact_quantiles(df.limit(0), {"b": F.col("b")}, [0.5])
    assert empty["b"].count == 0


def test_running_totals(spark):
    random = np.random.default_rng(3)
    rows = [(g, float(v), int(n)) for g in ("a", "b") for v, n in zip(random.permutation(500), random.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    found = {(r["g"], r["v"]): r["before"] for r in ranks.running_totals(df, "v", {"n": "before"}, by=["g"]).collect()}
    for g in ("a", "b"):
        total = 0
        for _, v, n in sorted(r for r in rows if r[0] == g):
            assert found[g, v] == total
            total += n


@pytest.mark.parametrize("prefix", [1, 3])
def test_hash_cutoffs_cut_at_the_wanted_ranks(spark, monkeypatch, prefix):
    monkeypatch.setattr(ranks, "HASH_PREFIX", prefix)
    df = spark.range(3001).select("id", F.when(F.col("id") < 2000, "big").when(F.col("id") < 3000, "small").alias("c"))
    wanted = F.array(F.lit(1), F.floor(F.col("n") / 2), F.col("n"))
    placed = ranks.passed_cutoffs(df, "id", 42, "c", wanted, "beyond")
    sizes = {(r["c"], r["beyond"]): r["count"] for r in placed.groupBy("c", "beyond").count().collect()}
    assert sizes == {("big", 0): 1, ("big", 1): 999, ("big", 2): 1000, ("small", 0): 1, ("small", 1): 499, ("small", 2): 500, (None, 0): 1}
    again = ranks.passed_cutoffs(df.repartition(7), "id", 42, "c", wanted, "beyond")
    assert placed.exceptAll(again).isEmpty()


def test_large_dictionaries_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(ranks, "DICTIONARY_ROWS", 10)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("first"), F.col("id").cast("string").alias("category")).repartition(6)
    numbered = ranks.number_rows(df, [F.asc("first")], 1000).collect()
    assert all(r["code"] == r["first"] + 1 for r in numbered)
