"""Properties and edge cases of loading, profiling, cleaning, encoding, scaling, splitting and chart data."""

import math

import pytest
from pyspark.sql import functions as F

from tabulift.functions import schema
from tabulift.functions.columns import row_hash
from tabulift.operators import chartdata, clean, encode, importance, metrics, profile, scale, split, target
from tabulift.sources import tables

MESSY = "n bigint, x double, t string, flag boolean"


@pytest.fixture(scope="module")
def messy(spark):
    rows = [
        (1, 1.5, "a", True), (2, None, "b", False), (3, float("nan"), "", None), (4, 4.0, None, True),
        (4, 4.0, None, True), (5, 100.0, "a", False), (None, 2.0, "b", True),
    ]
    return spark.createDataFrame(rows, MESSY)


def test_nan_counts_as_missing(messy):
    found = {r["column"]: (r["missing"], r["percentage"]) for r in profile.missing_profile(messy).collect()}
    assert found == {"n": (1, 14.29), "x": (2, 28.57), "t": (2, 28.57), "flag": (1, 14.29)}
    assert profile.missing_total(messy).first()[0] == 6


def test_booleans_are_not_numeric(messy):
    assert schema.numeric_columns(messy) == ["n", "x"]
    assert schema.string_columns(messy) == ["t"]


def test_unique_counts(messy):
    exact = {r["column"]: r["distinct"] for r in profile.unique_counts(messy).collect()}
    assert exact == {"n": 5, "x": 4, "t": 3, "flag": 2}
    about = {r["column"]: r["distinct"] for r in profile.unique_counts(messy, approximate=True).collect()}
    assert about["n"] == 5


def test_clean_impute_and_dedupe(messy):
    result = clean.clean(messy, treat_empty=True, missing=clean.IMPUTE, duplicates=clean.DEDUPE)
    assert result.duplicates_left == 0
    assert result.missing_left == 1  # booleans are not imputed
    assert dict(result.table.dtypes)["n"] == "double"
    again = clean.clean(result.table, duplicates=clean.DEDUPE)
    assert again.table.count() == result.table.count() == 6


def test_clean_drop(messy):
    result = clean.clean(messy, treat_empty=True, missing=clean.DROP)
    assert result.missing_left == 0 and result.table.count() == 2


def test_clean_keep_changes_nothing(messy):
    result = clean.clean(messy)
    assert result.missing_left == 6 and result.duplicates_left == 1 and result.table.count() == 7


def test_all_missing_columns_stay(spark):
    df = spark.createDataFrame([(None, None, 1.0), (None, None, 2.0)], "a double, b string, c double")
    result = clean.clean(df, missing=clean.IMPUTE)
    assert result.missing_left == 4
    described = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert described["a"]["count"] == 0 and described["a"]["p50"] is None
    assert [tuple(r) for r in profile.describe_categorical(df).collect()] == [("b", 0, 0, None, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], MESSY)
    assert tables.load_status(df)[0] == "empty"
    assert profile.shape(df).first()["rows"] == 0
    assert profile.duplicate_count(df).first()[0] == 0
    assert profile.missing_total(df).first()[0] == 0
    assert clean.clean(df, missing=clean.IMPUTE, duplicates=clean.DEDUPE).table.count() == 0
    assert target.infer_problem_type(df, "n") == target.NO_DATA
    assert chartdata.histogram(df, "x").count() == 0


def test_single_row(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], MESSY)
    row = {r["column"]: r for r in profile.describe_numeric(df).collect()}["x"]
    assert row["p25"] == row["p75"] == 2.0 and row["std"] is None
    assert scale.fit_auto(df).plans == ()
    assert chartdata.histogram(df, "x").agg(F.sum("count")).first()[0] == 1


def test_narrow_types_bounds_are_strict(spark):
    df = spark.createDataFrame([(126, 127, -127, -128, 5), (0, 0, 0, 0, 1 << 40)], "a bigint, b bigint, c bigint, d bigint, e bigint")
    table, report = tables.narrow_types(df)
    kinds = {r["column"]: r["to"] for r in report.collect()}
    assert kinds == {"a": "tinyint", "b": "smallint", "c": "tinyint", "d": "smallint", "e": "bigint"}
    assert [tuple(r) for r in table.collect()] == [tuple(r) for r in df.collect()]


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,amount,name,ok,gone\n1,2.5,"a, b",True,\n2,NA,n/a,False,\n3,1e3,c,True,\n')
    df = tables.load_table(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("amount", "double"), ("name", "string"), ("ok", "boolean"), ("gone", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 2.5, "a, b", True, None), (2, None, None, False, None), (3, 1000.0, "c", True, None),
    ]
    with pytest.raises(tables.UnsupportedFile):
        tables.load_table(spark, "book.xlsx")


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a-b` int, ab int, ` My Col! ` int, `AB` int")
    assert schema.normalize_names(df).columns == ["ab", "ab_2", "my_col", "ab_3"]


def test_one_hot_rows_sum_to_one_and_unknown_to_zero(spark, messy):
    fitted = encode.OneHotEncoder.fit(messy, ["t"])
    hot = fitted.transform(messy)
    names = [c for c in hot.columns if c.startswith("t_")]
    assert set(names) == {"t_a", "t_b", "t_", "t_nan"}
    assert {r[0] for r in hot.select(sum(F.col(n) for n in names)).collect()} == {1}
    other = messy.withColumn("t", F.lit("zzz"))
    assert {r[0] for r in fitted.transform(other).select(sum(F.col(n) for n in names)).collect()} == {0}
    with pytest.raises(ValueError):
        encode.OneHotEncoder.fit(messy, ["t"], max_categories=2)


def test_ordinal_unknown_and_missing(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "k int, c string")
    fitted = encode.OrdinalEncoder.fit(train, "k")
    test = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, c string")
    assert [r["c"] for r in fitted.transform(test).orderBy("k").collect()] == [2, -1, -2]


@pytest.mark.parametrize("limit", [encode.BROADCAST_BYTES, 0])
def test_dictionary_join_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(encode, "BROADCAST_BYTES", limit)
    df = spark.range(500).select("id", F.concat(F.lit("c"), F.col("id") % 37).alias("c"))
    coded = encode.encode(df, "ordinal", order_by="id")
    assert coded.filter(F.col("c") != F.col("id") % 37 + 1).count() == 0


def test_scalers(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("bit"), F.lit(5).alias("same"))
    for kind, check in (
        (scale.MINMAX, lambda r: (r["lo"], r["hi"]) == (0.0, 1.0)),
        (scale.STANDARD, lambda r: math.isclose(r["sd"], 1.0) and abs(r["m"]) < 1e-12),
        (scale.ROBUST, lambda r: math.isclose(r["lo"], (1 - 500.5) / (750.25 - 250.75))),
    ):
        table, plan = scale.scale(df, "manual", kind)
        row = table.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("sd"), F.avg("x").alias("m")).first()
        assert check(row), kind
        assert [r["column"] for r in plan.collect()] == ["x"]
    auto = {r["column"]: (r["scaler"], r["reason"]) for r in scale.scale(df, "auto")[1].collect()}
    assert auto == {"x": ("standard", "wide"), "bit": ("minmax", "default"), "same": ("skip", "constant")}


def test_split_parts_are_disjoint_and_complete(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("c"))
    made = split.train_test_split(df, "c", "id")
    assert made.train.unionAll(made.test).distinct().count() == 5000
    assert abs(made.test.count() - 1000) < 120
    even = split.train_test_split(df, "c", "id", stratify=True, problem_type=target.MULTICLASS)
    assert {r["count"] for r in even.test.groupBy("c").count().collect()} == {333}


def test_stratify_falls_back(spark):
    df = spark.range(50).select("id", F.when(F.col("id") == 0, "rare").otherwise("usual").alias("c"))
    assert "1 row" in split.train_test_split(df, "c", "id", stratify=True, problem_type=target.BINARY).message
    assert "not a classification" in split.train_test_split(df, "c", "id", stratify=True, problem_type=target.REGRESSION).message
    assert split.stratified_kfold(df, "c", "id").filter("fold is null").count() == 0


def test_stratified_folds_differ_by_one_row(spark):
    df = spark.range(1003).select("id", (F.col("id") < 400).alias("c"))
    folds = split.stratified_kfold(df, "c", "id").groupBy("c", "fold").count().collect()
    for c in (True, False):
        sizes = [r["count"] for r in folds if r["c"] == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_auc_of_flipped_scores(spark):
    df = spark.range(2000).select((F.col("id") % 7 < 3).cast("int").alias("label"), (F.col("id") * 37 % 101 / 10).alias("score"))
    straight = metrics.roc_auc(df).first()[0]
    flipped = metrics.roc_auc(df.withColumn("score", -F.col("score"))).first()[0]
    assert straight + flipped == pytest.approx(1.0)
    assert metrics.roc_auc(df.withColumn("score", F.lit(1.0))).first()[0] == 0.5
    assert metrics.roc_auc(df.withColumn("label", F.lit(1))).first()[0] is None


def test_metrics_of_absent_classes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "label string, prediction string")
    grid = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(grid) == 9 and grid["b", "b"] == 0 and grid["a", "b"] == 1
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["b"]["support"] == 0 and report["b"]["recall"] == 0.0 and report["accuracy"]["f1"] == pytest.approx(1 / 3)


def test_sample_has_exact_size(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    sample = chartdata.sample_rows(df, "k", 700)
    assert sample.count() == 700 and sample.distinct().count() == 700
    assert {r["k"] for r in sample.collect()} == {r["k"] for r in chartdata.sample_rows(df.repartition(9), "k", 700).collect()}
    assert chartdata.sample_rows(df, "k", 50_000).count() == 20_000


def test_density_integrates_to_one(spark):
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).cast("double").alias("x"))
    rows = chartdata.kde(df, "x").orderBy("point").collect()
    step = rows[1]["x"] - rows[0]["x"]
    assert len(rows) == 200 and sum(r["density"] for r in rows) * step == pytest.approx(1.0, abs=2e-3)
    assert chartdata.kde(df.withColumn("x", F.lit(1.0)), "x").count() == 0


@pytest.mark.parametrize("width", [8, 9, 12])
def test_correlation_is_the_same_at_every_width(spark, width):
    """Also with nulls, a constant column and an empty one; blocks of pairs change nothing."""
    more = {f"x{i}": (F.col("id") * (7 + i) % 101).cast("double") for i in range(width - 5)}
    df = spark.range(300).select(
        F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") * 31 % 97).alias("b"), F.sqrt("id").alias("c"),
        F.lit(2.5).alias("same"), F.lit(None).cast("double").alias("empty"), *[v.alias(n) for n, v in more.items()],
    )
    found = {(r["a"], r["b"]): r["r"] for r in chartdata.correlation_matrix(df).collect()}
    assert len(found) == width * width
    few = {(r["a"], r["b"]): r["r"] for r in chartdata.correlation_matrix(df.select("a", "b", "c")).collect()}
    assert {k: found[k] for k in few} == pytest.approx(few)
    assert all((v is None) == bool({"same", "empty"} & {*k}) for k, v in found.items())
    assert found["a", "a"] == pytest.approx(1.0)


def test_constant_features_have_no_score(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("y"), (F.col("id") % 7).alias("x"), F.lit(1).alias("same"))
    for f, name in ((importance.f_score_regression, "f_score"), (importance.pearson_abs, "pearson")):
        scores = {r["feature"]: r[name] for r in f(df, "y").collect()}
        assert scores["same"] is None and scores["x"] is not None
    assert importance.feature_importance(df, "y").count() == 2


def test_keys_do_not_share_a_hash(spark):
    rows = [(None, "1"), ("1", None), ("a|b", "c"), ("a", "b|c"), ("\\N", "1"), ("a\\", "|c"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(row_hash(["a", "b"], 1).alias("h")).distinct().count() == len(rows)


def test_rest_is_told_from_a_value_other(spark):
    df = spark.createDataFrame([("Other",)] * 3 + [("a",)] * 2 + [("b",), ("c",)], "v string")
    assert {tuple(r) for r in chartdata.top_k_other(df, "v", 2).collect()} == {("Other", 3), ("a", 2), ("Other*", 2)}


def test_stratified_parts_leave_the_table_in_place(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("class"), F.lit("wide").alias("w"))
    plan = split.stratified_kfold(df, "class", "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_csv_loses_nothing(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text,note\n1,"two\nlines",NA\n2,"say ""so"", then",x\n3,short\n')
    rows = [(1, "two\nlines", None), (2, 'say "so", then', "x"), (3, "short", None)]
    assert [tuple(r) for r in tables.load_csv(spark, str(path)).orderBy("id").collect()] == rows
    assert [tuple(r) for r in tables.load_csv(spark, str(path), "id bigint, text string, note string").orderBy("id").collect()] == rows
    path.write_text("id,text\n1,a\n2,b,surplus\n")
    with pytest.raises(Exception, match="more cells"):
        tables.load_csv(spark, str(path)).collect()


def test_one_hot_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "nan", 5), (2, None, 6), (3, "X", 7), (4, "x", 8)], "id int, v string, v_x int")
    made = encode.OneHotEncoder.fit(df, ["v"], order_by="id").transform(df)
    assert len({c.lower() for c in made.columns}) == len(made.columns) == 6
    assert all(sum(r[c] for c in made.columns if c not in ("id", "v_x")) == 1 for r in made.collect())


def test_importance_guards(spark, messy):
    with pytest.raises(ValueError):
        importance.feature_importance(messy, "nothing")
    with pytest.raises(ValueError):
        importance.feature_importance(messy, "n")
    constant = spark.range(10).select("id", F.lit(1).alias("y"))
    with pytest.raises(ValueError):
        importance.feature_importance(constant, "y")
    assert schema.choose_target(messy, "None") is None


def test_same_answer_with_one_and_many_shuffle_partitions(spark, messy):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, profile.describe_numeric(messy).collect() + profile.unique_counts(messy).collect())))
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
