"""Tables whose columns have the names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

from tabulift.operators import clean, encode, profile, split, training
from tabulift.operators.estimators import Names, fit_classifier, fit_regressor

INNER = [
    "label", "features", "class_text", "prediction", "probability", "rawPrediction", "predicted", "kernel_features", "platt_raw",
    "row", "fold", "part", "cutoffs", "class", "class_", "hash", "_hash", "_class", "n_", "_n", "missing", "code_", "category_", "share_", "code_0",
    "_code", "_category", "_share", "count", "value", "column", "features_", "Label", "x0", "c",
]
INNER = list({n.lower(): n for n in reversed(INNER)}.values())


@pytest.fixture(scope="module")
def table(spark):
    """A key, a target of three classes, and one numeric column for each inner name."""
    k = F.col("id")
    return spark.range(240).select(
        k.alias("k"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("y"), *[((k * (i + 3)) % (11 + i) + (k % 3) * 9.0).alias(n) for i, n in enumerate(INNER)]
    )


def same_values(df, table):
    kept = df.select("k", *INNER).orderBy("k").collect()
    assert kept == table.select("k", *INNER).orderBy("k").collect()


@pytest.mark.parametrize("name", ["Logistic Regression", "Gaussian Naive Bayes", "Support Vector Classifier", "Decision Tree Classifier"])
def test_classifiers(spark, table, name):
    fitted = fit_classifier(name, table, INNER, "y", **({"maxDepth": 3} if "Tree" in name else {}))
    out = fitted.transform(table)
    same_values(out, table)
    assert fitted.predicted(table) == "predicted_" and set(out.columns) > set(table.columns)
    assert out.where(F.col("predicted_") == F.col("y")).count() > 200
    scores = out.select(*[c.alias(f"s{i}") for i, c in enumerate(fitted.scores(table).values())]).first()
    assert len(scores) == 3 and None not in scores


@pytest.mark.parametrize("name", ["Linear Regression", "Lasso Regression", "Support Vector Regressor (SVR)", "Decision Tree Regressor"])
def test_regressors(spark, table, name):
    features = [n for n in INNER if n != "prediction"][:8]
    fitted = fit_regressor(name, table, features, "prediction", **({"maxDepth": 3} if "Tree" in name else {}))
    out = fitted.transform(table)
    same_values(out, table)
    assert out.where("prediction_ is null").count() == 0 and fitted.predicted(table) == "prediction_"


def test_saved_and_evaluated(spark, table, tmp_path):
    done = training.train_models(["Gaussian Naive Bayes"], table, table, INNER, "y", "Multiclass Classification")
    assert done.errors.count() == 0
    assert {r["metric"] for r in done.metrics.collect()} >= {"accuracy", "roc_auc_ovr"}
    path = training.save_trained(done.models["Gaussian Naive Bayes"], "Gaussian Naive Bayes", str(tmp_path))
    again = training.load_trained(spark, path).score(table)
    first = done.scored["Gaussian Naive Bayes"]
    assert again.table.select("k", again.prediction).orderBy("k").collect() == first.table.select("k", first.prediction).orderBy("k").collect()


def test_cross_validation(spark, table):
    done = training.cross_validate(["Gaussian Naive Bayes"], table, INNER, "y", "Multiclass Classification", "k", folds=3)
    assert done.errors.count() == 0 and done.scores.select("fold").distinct().count() == 3


def test_splits_and_folds(spark, table):
    plain = [n for n in table.columns if n not in ("part", "fold")]
    for df, suffix in ((table, "_"), (table.select(*plain), "")):
        made = split.stratified_kfold(df, "y", "k", 4)
        assert made.columns == [*df.columns, f"fold{suffix}"]
        assert sorted(r["count"] for r in made.groupBy("y", f"fold{suffix}").count().collect()) == [20] * 12
        parts = split.train_test_split(df, "y", "k", stratify=True, problem_type="Multiclass Classification")
        assert (parts.test.count(), parts.train.count(), parts.test.columns) == (48, 192, df.columns)
        assert parts.column == f"part{suffix}"
        plain_parts = split.train_test_split(df, "y", "k")
        assert plain_parts.test.count() + plain_parts.train.count() == 240 and plain_parts.test.columns == df.columns
        assert split.kfold(df, "k").columns == [*df.columns, f"fold{suffix}"]
    same_values(split.stratified_kfold(table, "y", "k", 4), table)


def test_encoders(spark, table):
    texts = table.select("k", "y", *[F.concat(F.lit("v"), F.col(n).cast("int") % 4).alias(n) for n in INNER])
    ordinal = encode.OrdinalEncoder.fit(texts, "k").transform(texts)
    assert ordinal.columns == texts.columns and ordinal.agg(*[F.min(n).alias(n) for n in INNER]).first() == tuple([1] * len(INNER))
    frequency = encode.FrequencyEncoder.fit(texts).transform(texts)
    assert frequency.columns == texts.columns and 0 < frequency.agg(F.min("_share")).first()[0] < 1
    binary = encode.BinaryEncoder.fit(texts, "k", ["y", "_code", "category_"]).transform(texts.drop("code_0"))
    assert {"y_0", "y_1", "_code_0", "category__0"} <= set(binary.columns)


def test_duplicates(spark, table):
    assert profile.duplicate_count(table.unionByName(table)).first()[0] == 240
    done = clean.clean(table.unionByName(table.limit(5)), missing=clean.IMPUTE, duplicates=clean.DEDUPE)
    assert done.table.count() == 240 and done.duplicates_left == 0


def test_inner_names_are_free():
    names = Names(INNER)
    assert not {n.lower() for n in vars(names).values()} & {n.lower() for n in INNER}
