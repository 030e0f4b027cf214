"""Models, training, cross-validation and persistence."""

from pyspark.sql import functions as F

from catalogue.fixtures import LINE_KEY, PREDICTIONS, predictions, real_labels
from catalogue.registry import query, rounded, table
from tabulift.operators import encode, neighbours, split, training
from tabulift.operators.estimators import fit_classifier, fit_regressor
from tabulift.operators.target import BINARY, MULTICLASS, REGRESSION
from tabulift.plans.scratch import scratch_path
from tabulift.sources.models import load_model, save_model


def _documents(spark, folder):
    """Documents with quality labels and the language as 0/1 columns."""
    df = real_labels(spark, folder).drop("source")
    hot = encode.OneHotEncoder.fit(df, ["lang"], order_by="doc_id")
    made = hot.transform(df)
    return made, [c for c in made.columns if c not in ("doc_id", "quality")]


def _classified(name, target="quality"):
    """Fit on the train part, predict the test part of the labelled documents."""

    def run(spark, folder):
        df, features = _documents(spark, folder)
        parts = split.train_test_split(df, target, "doc_id")
        model = fit_classifier(name, parts.train, features, target)
        return model.transform(parts.test).select("doc_id", F.col(target).alias("actual"), "predicted")

    return run


query("logistic_regression")(_classified("Logistic Regression"))
query("random_forest_classifier")(_classified("Random Forest Classifier"))
query("gbt_classifier")(_classified("Gradient Boosting Classifier"))
query("svm_classifier")(_classified("Support Vector Classifier"))
query("decision_tree_classifier")(_classified("Decision Tree Classifier"))


_NB_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
_NB_STATS = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _NB_FEATURES)
_NB_FLOOR = "(SELECT 1e-9 * greatest(" + ", ".join(f"var_pop({c})" for c in _NB_FEATURES) + ") FROM lineitem)"
_NB_SCORE = " + ".join(
    f"(-0.5 * ln(2 * pi() * (v_{c} + floor_)) - ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + floor_)))" for c in _NB_FEATURES
)


@query(
    "gaussian_nb",
    f"""WITH classes AS (SELECT l_returnflag AS class, ln(count(*) / (SELECT count(*) FROM lineitem)) AS prior, {_NB_STATS},
          {_NB_FLOOR} AS floor_ FROM lineitem GROUP BY l_returnflag)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, arg_max(class, prior + {_NB_SCORE}) AS predicted
        FROM lineitem, classes GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity""",
)
def gaussian_nb(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINE_KEY, *_NB_FEATURES, "l_returnflag")
    return fit_classifier("Gaussian Naive Bayes", df, _NB_FEATURES, "l_returnflag").transform(df).select(*LINE_KEY, "predicted")


_PART_HASH = "CAST('0x' || substr(md5(concat_ws('|', p_partkey, '42')), 1, 8) AS BIGINT)"
_PART_CUT = f"""cut AS (SELECT *, {_PART_HASH} < floor(0.2 * 4294967296) AS held FROM part),
  pairs AS (SELECT t.p_partkey AS k, r.p_partkey AS rk, r.p_type AS cls, r.{{y}} AS y,
      row_number() OVER (PARTITION BY t.p_partkey ORDER BY {{d}}, r.p_partkey) AS place
    FROM cut t JOIN cut r ON t.held AND NOT r.held),
  best AS (SELECT * FROM pairs WHERE place <= 5)"""
_TWO = "(CAST(t.p_size AS DOUBLE) - r.p_size) * (CAST(t.p_size AS DOUBLE) - r.p_size) + (t.p_retailprice - r.p_retailprice) * (t.p_retailprice - r.p_retailprice)"


def _parts(spark, folder):
    return split.train_test_split(table(spark, folder, "part"), "p_type", "p_partkey")


@query(
    "knn_classifier",
    f"""WITH {_PART_CUT.format(y='p_size', d=_TWO)}
        SELECT k AS key, cls AS prediction FROM (SELECT k, cls, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, cls) AS i
        FROM best GROUP BY k, cls) WHERE i = 1""",
)
def knn_classifier(spark, folder):
    parts = _parts(spark, folder)
    return neighbours.knn_classifier(
        parts.train, parts.test, ["p_size", "p_retailprice"], "p_partkey", "p_partkey", "p_type"
    ).select("key", "prediction")


@query(
    "knn_regressor",
    f"""WITH {_PART_CUT.format(y='p_retailprice', d='abs(CAST(t.p_size AS DOUBLE) - r.p_size)')}
        SELECT k AS key, round(avg(y), 6) AS prediction FROM best GROUP BY k""",
)
def knn_regressor(spark, folder):
    parts = _parts(spark, folder)
    return rounded(neighbours.knn_regressor(parts.train, parts.test, ["p_size"], "p_partkey", "p_partkey", "p_retailprice"))


_REGRESSION = ["l_quantity", "l_discount", "l_tax"]


def _regressed(name, features=_REGRESSION, digits=4, **settings):
    """Coefficients and intercept of a linear model of the price, on all line items."""

    def run(spark, folder):
        df = table(spark, folder, "lineitem").select(*features, "l_extendedprice")
        fitted = fit_regressor(name, df, features, "l_extendedprice", **settings).model.stages[-1]
        rows = [*zip(features, map(float, fitted.coefficients)), ("intercept", float(fitted.intercept))]
        return rounded(spark.createDataFrame(rows, "term string, value double"), digits)

    return run


_ONE = ["l_quantity"]
query(
    "linear_regression",
    """SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem
       UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem""",
)(_regressed("Linear Regression", _ONE))
query(
    "ridge_regression",
    """WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1) AS slope,
         avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
       SELECT 'l_quantity' AS term, round(slope, 4) AS value FROM s UNION ALL SELECT 'intercept', round(my - slope * mx, 4) FROM s""",
)(_regressed("Ridge Regression", _ONE))


def _normal_equations(penalty):
    """Slopes of three features from their covariances by determinants, with a squared penalty."""
    f, y = _REGRESSION, "l_extendedprice"
    cells = [f"covar_pop({f[i]}, {f[j]}) * count(*) + {penalty if i == j else 0} AS c{i}{j}" for i in range(3) for j in range(i, 3)]
    cells += [f"covar_pop({x}, {y}) * count(*) AS y{i}, avg({x}) AS m{i}" for i, x in enumerate(f)]
    def m(i, j, k):  # entry with column k replaced by the right side
        return f"y{i}" if j == k else f"c{min(i, j)}{max(i, j)}"
    def det(k):
        return " + ".join(
            f"{m(0, a, k)} * ({m(1, b, k)} * {m(2, c, k)} - {m(1, c, k)} * {m(2, b, k)})" for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1))
        )
    slopes = ", ".join(f"({det(k)}) / ({det(9)}) AS b{k}" for k in range(3))
    terms = " UNION ALL ".join(f"SELECT '{x}' AS term, round(b{k}, 4) AS value FROM b" for k, x in enumerate(f))
    return f"""WITH s AS (SELECT {', '.join(cells)}, avg({y}) AS my FROM lineitem), b AS (SELECT *, {slopes} FROM s)
        {terms} UNION ALL SELECT 'intercept', round(my - b0 * m0 - b1 * m1 - b2 * m2, 4) FROM b"""


query("linear_regression_many", _normal_equations(0))(_regressed("Linear Regression"))
query("ridge_regression_many", _normal_equations(1))(_regressed("Ridge Regression"))
query(
    "lasso_regression_one",
    """WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem),
       b AS (SELECT *, sign(c) * greatest(abs(c) - 1.0, 0) / v AS slope FROM s)
       SELECT 'l_quantity' AS term, round(slope, 2) AS value FROM b UNION ALL SELECT 'intercept', round(my - slope * mx, 2) FROM b""",
)(_regressed("Lasso Regression", _ONE, 2, tol=1e-12))
query("lasso_regression")(_regressed("Lasso Regression"))


def _predicted(name):
    """Fit on the train part, predict the test part: retail price of parts from size, brand, type and supplier count."""

    def run(spark, folder):
        df = table(spark, folder, "part")
        coded = encode.OrdinalEncoder.fit(df, "p_partkey", ["p_brand", "p_type", "p_name"]).transform(df)
        parts = split.train_test_split(coded, "p_retailprice", "p_partkey")
        model = fit_regressor(name, parts.train, ["p_size", "p_brand", "p_type", "p_name"], "p_retailprice")
        return model.transform(parts.test).select("p_partkey", F.col("p_retailprice").alias("actual"), "prediction")

    return run


query("random_forest_regressor")(_predicted("Random Forest Regressor"))
query("gbt_regressor")(_predicted("Gradient Boosting Regressor"))
query("svr")(_predicted("Support Vector Regressor (SVR)"))
query("decision_tree_regressor")(_predicted("Decision Tree Regressor"))


@query("train_models")
def train_models(spark, folder):
    df, features = _documents(spark, folder)
    parts = split.train_test_split(df, "quality", "doc_id", stratify=True, problem_type=BINARY)
    names = ["Logistic Regression", "Decision Tree Classifier", "Gaussian Naive Bayes", "K-Nearest Neighbors Classifier"]
    return training.train_models(names, parts.train, parts.test, features, "quality", BINARY, "doc_id").metrics


_LINE_HELD = "CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42')), 1, 8) AS BIGINT) < floor(0.2 * 4294967296)"
_NB_TRAINED = f"""cut AS (SELECT *, {_LINE_HELD} AS held FROM lineitem), trained AS (SELECT * FROM cut WHERE NOT held),
  classes AS (SELECT l_returnflag AS class, ln(count(*) / (SELECT count(*) FROM trained)) AS prior, {_NB_STATS},
    {_NB_FLOOR.replace("lineitem", "trained")} AS floor_ FROM trained GROUP BY l_returnflag),
  said AS (SELECT l_returnflag AS actual, (SELECT arg_max(class, prior + {_NB_SCORE}) FROM classes) AS predicted FROM cut WHERE held),
  cells AS (SELECT actual, predicted, count(*) AS n FROM said GROUP BY actual, predicted)"""


def _trained(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINE_KEY, *_NB_FEATURES, "l_returnflag")
    parts = split.train_test_split(df, "l_returnflag", list(LINE_KEY))
    return training.train_models(["Gaussian Naive Bayes"], parts.train, parts.test, _NB_FEATURES, "l_returnflag", MULTICLASS)


@query(
    "train_models_confusion",
    f"""WITH {_NB_TRAINED} SELECT 'Gaussian Naive Bayes' AS model, actual, predicted, n,
      CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS of_actual, CAST(sum(n) OVER (PARTITION BY predicted) AS BIGINT) AS of_predicted FROM cells""",
)
def train_models_confusion(spark, folder):
    return _trained(spark, folder).confusion


@query(
    "train_models_report",
    f"""WITH {_NB_TRAINED}, per AS (SELECT c AS class, sum(n) FILTER (WHERE actual = c AND predicted = c) AS hits, sum(n) FILTER (WHERE actual = c) AS support,
          sum(n) FILTER (WHERE predicted = c) AS said FROM cells, (SELECT DISTINCT actual AS c FROM cells) GROUP BY c)
        SELECT 'Gaussian Naive Bayes' AS model, class, round(coalesce(hits / nullif(said, 0), 0), 6) AS precision, round(coalesce(hits / support, 0), 6) AS recall,
          CAST(support AS BIGINT) AS support FROM per""",
)
def train_models_report(spark, folder):
    report = rounded(_trained(spark, folder).report)
    return report.where(~F.col("class").isin("accuracy", "macro avg", "weighted avg")).select("model", "class", "precision", "recall", "support")


@query("train_models_regression")
def train_models_regression(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    parts = split.train_test_split(df, "p_retailprice", "p_partkey")
    names = ["Linear Regression", "Ridge Regression", "Lasso Regression", "K-Nearest Neighbors Regressor"]
    return training.train_models(names, parts.train, parts.test, ["p_size"], "p_retailprice", REGRESSION, "p_partkey").metrics


@query("cross_validate")
def cross_validate(spark, folder):
    df, features = _documents(spark, folder)
    return training.cross_validate(["Gaussian Naive Bayes"], df, features, "quality", BINARY, "doc_id").summary


@query("save_model", "SELECT doc_id, true AS same FROM labels WHERE quality IS NOT NULL")
def saved_model(spark, folder):
    """Whether the model that was read back predicts what the one that was written predicted."""
    df, features = _documents(spark, folder)
    model = fit_classifier("Logistic Regression", df, features, "quality")
    path = save_model(model.model, "Logistic Regression", scratch_path(spark, "models"))
    both = load_model(path).transform(model.transform(df).select("doc_id", F.col("predicted").alias("before"), *features))
    return both.select("doc_id", (F.col("predicted") == F.col("before")).alias("same"))


# One feature of few values: a tree of one split, chosen among the places between neighbouring values.
_SIDES = "sides AS (SELECT t, l_linenumber <= t AS low, {of} FROM lineitem, (SELECT DISTINCT l_linenumber AS t FROM lineitem) GROUP BY ALL)"
_STUMP_CLASS = f"""WITH {_SIDES.format(of="l_returnflag AS c, count(*) AS n")},
  gini AS (SELECT t, sum(rows_ - squares / rows_) AS impurity, count(*) AS parts
    FROM (SELECT t, low, sum(n) AS rows_, sum(n * n) AS squares FROM sides GROUP BY t, low) GROUP BY t),
  best AS (SELECT t FROM gini WHERE parts = 2 ORDER BY impurity, t LIMIT 1),
  leaf AS (SELECT low, arg_max(c, n) AS predicted FROM sides JOIN best USING (t) GROUP BY low)
  SELECT DISTINCT l_linenumber, predicted FROM lineitem, best JOIN leaf ON (l_linenumber <= t) = low"""


def _stump_mean(y, value):
    return f"""WITH {_SIDES.format(of=f"count(*) AS n, sum({y}) AS s, sum({y} * {y}) AS q")},
      loss AS (SELECT t, sum(q - s * s / n) AS impurity, count(*) AS parts FROM sides GROUP BY t),
      best AS (SELECT t FROM loss WHERE parts = 2 ORDER BY impurity, t LIMIT 1),
      leaf AS (SELECT low, s / n AS mean FROM sides JOIN best USING (t))
      SELECT DISTINCT l_linenumber, {value} FROM lineitem, best JOIN leaf ON (l_linenumber <= t) = low"""


_ONE_TREE = {"maxDepth": 1, "numTrees": 1, "bootstrap": False}


def _stump_classifier(name, target, **settings):
    def run(spark, folder):
        df = table(spark, folder, "lineitem").withColumn("late", (F.col("l_returnflag") == "N").cast("int"))
        model = fit_classifier(name, df.select("l_linenumber", target), ["l_linenumber"], target, **settings)
        return model.transform(df.select("l_linenumber").distinct()).select("l_linenumber", "predicted")

    return run


def _stump_regressor(name, **settings):
    def run(spark, folder):
        df = table(spark, folder, "lineitem").select("l_linenumber", "l_extendedprice")
        model = fit_regressor(name, df, ["l_linenumber"], "l_extendedprice", **settings)
        return rounded(model.transform(df.select("l_linenumber").distinct()).select("l_linenumber", "prediction"), 4)

    return run


query("decision_tree_classifier_stump", _STUMP_CLASS)(_stump_classifier("Decision Tree Classifier", "l_returnflag", maxDepth=1))
query("random_forest_classifier_stump", _STUMP_CLASS)(_stump_classifier("Random Forest Classifier", "l_returnflag", **_ONE_TREE))
_LATE = "CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END"
_ALL = f"(SELECT avg({_LATE}) FROM lineitem)"
_LATE_SCORE = f"ln({_ALL} / (1 - {_ALL})) + 0.1 * (mean - {_ALL}) / ({_ALL} * (1 - {_ALL}))"  # the prior, and a tenth of a Newton step
query("gbt_classifier_stump", _stump_mean(_LATE, f"CASE WHEN {_LATE_SCORE} > 0 THEN '1' ELSE '0' END AS predicted"))(
    _stump_classifier("Gradient Boosting Classifier", "late", maxDepth=1, maxIter=1)
)
_STUMP_PRICE = _stump_mean("l_extendedprice", "round(mean, 4) AS prediction")
query("decision_tree_regressor_stump", _STUMP_PRICE)(_stump_regressor("Decision Tree Regressor", maxDepth=1))
query("random_forest_regressor_stump", _STUMP_PRICE)(_stump_regressor("Random Forest Regressor", **_ONE_TREE))
_PRICE = "(SELECT avg(l_extendedprice) FROM lineitem)"
query("gbt_regressor_stump", _stump_mean("l_extendedprice", f"round({_PRICE} + 0.1 * (mean - {_PRICE}), 4) AS prediction"))(
    _stump_regressor("Gradient Boosting Regressor", maxDepth=1, maxIter=1)
)


def _softmax_rounds(rounds):
    """Boosting of three classes over one feature: what each round adds to the scores of every value and class."""
    parts = [
        "base AS (SELECT l_linenumber AS x, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY ALL)",
        "xs AS (SELECT x, sum(n) AS n FROM base GROUP BY x)",
        "prior AS (SELECT c AS k, ln(sum(n) / (SELECT sum(n) FROM base)) AS f FROM base GROUP BY c)",
        "s0 AS (SELECT x, k, f FROM xs, prior)",
    ]
    for i in range(rounds):
        parts += [
            f"p{i} AS (SELECT x, k, exp(f) / sum(exp(f)) OVER (PARTITION BY x) AS p FROM s{i})",
            f"""r{i} AS (SELECT p{i}.x, k, xs.n AS n, coalesce(base.n, 0) - xs.n * p AS g, xs.n * p * (1 - p) AS h
                FROM p{i} JOIN xs USING (x) LEFT JOIN base ON base.x = p{i}.x AND base.c = k)""",
            f"side{i} AS (SELECT k, t, x <= t AS low, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM r{i}, (SELECT x AS t FROM xs) GROUP BY ALL)",
            f"""gain{i} AS (SELECT k, t, pow(max(g / n) FILTER (WHERE low) - max(g / n) FILTER (WHERE NOT low), 2)
                * max(n) FILTER (WHERE low) * max(n) FILTER (WHERE NOT low) / sum(n) AS gain FROM side{i} GROUP BY k, t HAVING count(*) = 2)""",
            f"best{i} AS (SELECT k, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, t) AS place FROM gain{i}) WHERE place = 1)",
            f"leaf{i} AS (SELECT k, t, low, 2.0 / 3.0 * g / h AS v FROM side{i} JOIN best{i} USING (k, t))",
            f"s{i + 1} AS (SELECT x, s{i}.k, f + 0.1 * v AS f FROM s{i} JOIN leaf{i} ON s{i}.k = leaf{i}.k AND (x <= t) = low)",
        ]
    last = f"SELECT x AS l_linenumber, k AS class, round(exp(f) / sum(exp(f)) OVER (PARTITION BY x), 8) AS probability FROM s{rounds}"
    return f"WITH {', '.join(parts)} {last}"


def _boosted(rounds):
    def run(spark, folder):
        df = table(spark, folder, "lineitem").select("l_linenumber", "l_returnflag")
        model = fit_classifier("Gradient Boosting Classifier", df, ["l_linenumber"], "l_returnflag", maxDepth=1, maxIter=rounds)
        made = model.transform(df.select("l_linenumber").distinct())
        shares = [F.struct(F.lit(c).alias("class"), F.round(p, 8).alias("probability")) for c, p in model.scores().items()]
        return made.select("l_linenumber", F.inline(F.array(*shares)))

    return run


query("gbt_classifier_softmax", _softmax_rounds(2))(_boosted(2))
query("gbt_classifier_softmax_many", _softmax_rounds(12))(_boosted(12))


@query(
    "logistic_regression_one",
    """WITH g AS (SELECT toxic, avg(CAST(quality AS DOUBLE)) AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY toxic),
         w AS (SELECT max(ln(p / (1 - p))) FILTER (WHERE toxic = 0) AS a, max(ln(p / (1 - p))) FILTER (WHERE toxic = 1) AS b FROM g)
       SELECT 'toxic' AS term, round(b - a, 3) AS value FROM w UNION ALL SELECT 'intercept', round(a, 3) FROM w""",
)
def logistic_regression_one(spark, folder):
    """Without penalty and with one 0/1 feature, the log odds of the two groups are the answer."""
    df = table(spark, folder, "labels").where("quality is not null and toxic is not null")
    fitted = fit_classifier("Logistic Regression", df, ["toxic"], "quality", regParam=0.0, tol=1e-12, maxIter=500).model.stages[1]
    rows = [("toxic", float(fitted.coefficients[0])), ("intercept", float(fitted.intercept))]
    return rounded(spark.createDataFrame(rows, "term string, value double"), 3)


# Two clouds far apart, made from the keys of a whole table: the side follows from the key.
def _clouds(spark, folder):
    key = F.col("p_partkey")
    side = key % 2
    return table(spark, folder, "part").select(
        key, (side * 8.0 + (key % 7) * 0.1).alias("a"), (side * -8.0 + (key % 5) * 0.1).alias("b"), (side * 10.0 - 5.0).alias("y"),
        F.when(side == 1, "odd").otherwise("even").alias("side"),
    )


@query("svm_classifier_clouds", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'odd' ELSE 'even' END AS predicted FROM part")
def svm_classifier_clouds(spark, folder):
    df = _clouds(spark, folder)
    return fit_classifier("Support Vector Classifier", df, ["a", "b"], "side").transform(df).select("p_partkey", "predicted")


@query("svr_clouds", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 5.0::DOUBLE ELSE -5.0::DOUBLE END AS prediction FROM part")
def svr_clouds(spark, folder):
    df = _clouds(spark, folder)
    fitted = fit_regressor("Support Vector Regressor (SVR)", df, ["a", "b"], "y").transform(df)
    return fitted.select("p_partkey", F.round("prediction").alias("prediction"))


# Fold scores by arithmetic, so that their summary can be checked without training.
_FOLDS = f"""{PREDICTIONS}, folded AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', o_orderkey, '42')), 1, 8) AS BIGINT) % 5 AS fold FROM predictions),
  scores AS (SELECT t.fold, 'accuracy' AS metric,
      (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM folded f WHERE f.fold = t.fold) AS test,
      (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM folded f WHERE f.fold <> t.fold) AS train
    FROM (SELECT DISTINCT fold FROM folded) t)"""


def _fold_scores(spark, folder):
    folded = split.kfold(predictions(spark, folder), "o_orderkey")
    hit = (F.col("label") == F.col("prediction")).cast("double")
    per_fold = folded.groupBy("fold").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("rows"))
    total = folded.agg(F.sum(hit), F.count(F.lit(1))).first()
    return per_fold.select(
        F.lit("fixed").alias("model"),
        "fold",
        F.lit("accuracy").alias("metric"),
        (F.col("hits") / F.col("rows")).alias("test"),
        ((F.lit(total[0]) - F.col("hits")) / (F.lit(total[1]) - F.col("rows"))).alias("train"),
    )


@query(
    "cross_validate_summary",
    f"""WITH {_FOLDS} SELECT 'fixed' AS model, metric, round(avg(test), 8) AS mean, round(stddev_pop(test), 8) AS std,
        round(avg(train), 8) AS train_mean, round(avg(train) - avg(test), 8) AS overfit FROM scores GROUP BY metric""",
)
def cross_validate_summary(spark, folder):
    return rounded(training.summarise_folds(_fold_scores(spark, folder)), 8)


@query("overfit_gap", f"WITH {_FOLDS} SELECT metric, round(avg(train) - avg(test), 8) AS overfit FROM scores GROUP BY metric")
def overfit_gap(spark, folder):
    summary = _fold_scores(spark, folder).groupBy("metric").agg(F.avg("test").alias("mean"), F.avg("train").alias("train_mean"))
    return rounded(training.overfit_gap(summary).select("metric", "overfit"), 8)


@query("save_model_neighbours", f"WITH cut AS (SELECT p_partkey, {_PART_HASH} < floor(0.2 * 4294967296) AS held FROM part) SELECT p_partkey AS key, true AS same FROM cut WHERE held")
def saved_neighbours(spark, folder):
    """Whether neighbour models that were read back predict what the ones that were written predicted."""
    parts = _parts(spark, folder)
    model = training.fit_model("K-Nearest Neighbors Classifier", parts.train, ["p_size", "p_retailprice"], "p_type", MULTICLASS, "p_partkey")
    again = training.load_trained(spark, training.save_trained(model, "K-Nearest Neighbors Classifier", scratch_path(spark, "models")))
    found = [neighbours.knn_classifier(m.train, parts.test, m.features, m.key, m.key, m.target).select("key", "prediction") for m in (model, again)]
    return found[0].join(found[1].withColumnRenamed("prediction", "again"), "key").select("key", (F.col("prediction") == F.col("again")).alias("same"))


_ERRORS = """round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) AS r2, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 6) AS rmse"""
_LONG = " UNION ALL ".join(f"SELECT {{keys}}, '{m}' AS metric, {m} AS value FROM {{of}}" for m in ("r2", "mae", "mse", "rmse"))


@query(
    "train_models_regression_one",
    f"""WITH cut AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, {_PART_HASH} < floor(0.2 * 4294967296) AS held FROM part),
         fit AS (SELECT 'Linear Regression' AS model, regr_slope(y, x) AS b, avg(y) AS my, avg(x) AS mx FROM cut WHERE NOT held
           UNION ALL SELECT 'Ridge Regression', covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1), avg(y), avg(x) FROM cut WHERE NOT held),
         errors AS (SELECT model, y, y - (my + b * (x - mx)) AS e FROM cut, fit WHERE held),
         wide AS (SELECT model, {_ERRORS} FROM errors GROUP BY model) {_LONG.format(keys="model", of="wide")}""",
)
def train_models_regression_one(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    parts = split.train_test_split(df, "p_retailprice", "p_partkey")
    done = training.train_models(["Linear Regression", "Ridge Regression"], parts.train, parts.test, ["p_size"], "p_retailprice", REGRESSION)
    value = F.when(F.col("metric") == "mse", F.round("value", 4)).otherwise(F.round("value", 6))
    return done.metrics.select("model", "metric", value.alias("value"))


@query(
    "cross_validate_linear",
    f"""WITH f AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, {_PART_HASH} % 5 AS fold FROM part),
         folds AS (SELECT DISTINCT fold AS k FROM f),
         fit AS (SELECT k, regr_slope(y, x) AS b, avg(y) AS my, avg(x) AS mx FROM f, folds WHERE fold <> k GROUP BY k),
         errors AS (SELECT k, fold = k AS test, y, y - (my + b * (x - mx)) AS e FROM f, fit),
         wide AS (SELECT k, test, {_ERRORS.replace("round(", "(").replace(", 6)", ")").replace(", 4)", ")")} FROM errors GROUP BY k, test),
         long AS ({_LONG.format(keys="k, test", of="wide")})
       SELECT 'Linear Regression' AS model, metric, round(avg(value) FILTER (WHERE test), 5) AS mean, round(stddev_pop(value) FILTER (WHERE test), 5) AS std,
         round(avg(value) FILTER (WHERE NOT test), 5) AS train_mean, round(avg(value) FILTER (WHERE NOT test) - avg(value) FILTER (WHERE test), 5) AS overfit
       FROM long GROUP BY metric""",
)
def cross_validate_linear(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    done = training.cross_validate(["Linear Regression"], df, ["p_size"], "p_retailprice", REGRESSION, "p_partkey")
    return rounded(done.summary.where(~F.col("metric").isin("fit_time", "score_time")), 5)
