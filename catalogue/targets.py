"""Problem types and feature importance."""

from pyspark.sql import functions as F

from catalogue.fixtures import MODEL_NUMBERS, MODEL_TABLE, REAL_LABELS, TYPING, model_table, real_labels, typing
from catalogue.registry import query, rounded, table
from tabulift.functions.schema import choose_target
from tabulift.operators import importance, information, target
from tabulift.plans.frequencies import stack

_KINDS = {
    "two_texts": "text", "five_texts": "text", "truth": "truth", "two_integers": "integer", "twelve_integers": "integer",
    "many_integers": "integer", "many_floats": "float", "four_whole_floats": "float", "four_fractions": "float",
    "constant": "integer", "holes": "float", "moment": "other",
}
_RULES = {
    "text": "CASE WHEN d = 2 THEN 'Binary Classification' ELSE 'Multiclass Classification' END",
    "truth": "'Binary Classification'",
    "integer": """CASE WHEN d = 2 THEN 'Binary Classification' WHEN d < 15 OR (d * 1.0 / n < 0.05 AND d < 0.1 * n)
                  THEN 'Multiclass Classification' ELSE 'Regression' END""",
    "float": """CASE WHEN d = 2 THEN 'Binary Classification' WHEN d <= 5 AND w THEN 'Multiclass Classification' ELSE 'Regression' END""",
    "other": "'Error: Unknown Type'",
}


def _rule(c, kind):
    whole = f"bool_and({c} % 1 = 0)" if kind == "float" else "true"
    return f"""SELECT '{c}' AS target, CASE WHEN n = 0 THEN 'Error: No data' WHEN m > 0 THEN 'Error: Target has NaNs'
        WHEN d <= 1 THEN 'Constant Target' ELSE {_RULES[kind]} END AS problem_type
        FROM (SELECT count(*) AS n, count(*) - count({c}) AS m, count(DISTINCT {c}) AS d, {whole} AS w FROM typing)"""


@query("problem_type", f"WITH {TYPING} " + " UNION ALL ".join(_rule(c, k) for c, k in _KINDS.items()))
def problem_type(spark, folder):
    df = typing(spark, folder)
    return stack([target.problem_type(df, c) for c in _KINDS])


@query("target_choice", f"WITH {TYPING} SELECT five_texts, count(*) AS count FROM typing GROUP BY five_texts")
def target_choice(spark, folder):
    df = typing(spark, folder)
    assert choose_target(df, "None") is None
    return df.groupBy(choose_target(df, "five_texts")).count()


def _unpivoted(source, target_column, columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {target_column} AS y FROM {source}" for c in columns)


_CLASS_LONG = f"{MODEL_TABLE}, long AS ({_unpivoted('model_table', 'l_returnflag', MODEL_NUMBERS)})"
_ANOVA = """anova AS (SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score
  FROM (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY feature, y)
  JOIN (SELECT feature, avg(x) AS g FROM long GROUP BY feature) USING (feature) GROUP BY feature)"""


def _numbers(spark, folder):
    return model_table(spark, folder).select(*MODEL_NUMBERS, "l_returnflag")


@query("f_score_classification", f"WITH {_CLASS_LONG}, {_ANOVA} SELECT feature, round(f_score, 6) AS f_score FROM anova")
def f_score_classification(spark, folder):
    return rounded(importance.f_score_classification(_numbers(spark, folder), "l_returnflag"))


REGRESSION_FEATURES = tuple(c for c in MODEL_NUMBERS if c != "l_extendedprice")
_REG_LONG = f"{MODEL_TABLE}, long AS ({_unpivoted('model_table', 'l_extendedprice', REGRESSION_FEATURES)})"
_F_REGRESSION = """f AS (SELECT feature, r * r / (1 - r * r) * (n - 2) AS f_score
  FROM (SELECT feature, corr(x, y) AS r, count(*) AS n FROM long GROUP BY feature))"""


@query("f_score_regression", f"WITH {_REG_LONG}, {_F_REGRESSION} SELECT feature, round(f_score, 4) AS f_score FROM f")
def f_score_regression(spark, folder):
    df = model_table(spark, folder).select(*MODEL_NUMBERS)
    return rounded(importance.f_score_regression(df, "l_extendedprice"), 4)


_CONSTANT = ("l_quantity", "l_discount", "same")
_CONSTANT_R = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, covar_pop({c}, l_extendedprice) / nullif(sqrt(var_pop({c}) * var_pop(l_extendedprice)), 0) AS r FROM t"
    for c in _CONSTANT
)
_CONSTANT_TABLE = f"WITH t AS (SELECT *, 3.0::DOUBLE AS same FROM lineitem), r AS ({_CONSTANT_R})"


def _with_constant(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.withColumn("same", F.lit(3.0)).select(*_CONSTANT, "l_extendedprice")


@query("f_score_regression_constant", f"{_CONSTANT_TABLE} SELECT feature, round(r * r / (1 - r * r) * (n - 2), 4) AS f_score FROM r")
def f_score_regression_constant(spark, folder):
    return rounded(importance.f_score_regression(_with_constant(spark, folder), "l_extendedprice", _CONSTANT), 4)


@query("pearson_abs_constant", f"{_CONSTANT_TABLE} SELECT feature, round(abs(r), 8) AS pearson FROM r")
def pearson_abs_constant(spark, folder):
    return rounded(importance.pearson_abs(_with_constant(spark, folder), "l_extendedprice", _CONSTANT), 8)


_DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def _mi(y_bin):
    return f"""edges AS (SELECT feature, list_distinct(quantile_cont(x, {_DECILES})) AS e FROM long GROUP BY feature),
      binned AS (SELECT long.feature, len(list_filter(e, lambda q: q < x)) AS b, {y_bin} AS y FROM long JOIN edges ON long.feature = edges.feature),
      cells AS (SELECT feature, b, y, count(*) AS n FROM binned GROUP BY feature, b, y),
      rows_of AS (SELECT feature, b, sum(n) AS nb FROM cells GROUP BY feature, b),
      columns_of AS (SELECT feature, y, sum(n) AS ny FROM cells GROUP BY feature, y),
      totals AS (SELECT feature, sum(n) AS t FROM cells GROUP BY feature),
      mi AS (SELECT feature, greatest(sum(n / t * ln(n * t / (nb * ny))), 0.0) AS mutual_information
        FROM cells JOIN rows_of USING (feature, b) JOIN columns_of USING (feature, y) JOIN totals USING (feature) GROUP BY feature)"""


@query("mi_classification", f"WITH {_CLASS_LONG}, {_mi('y')} SELECT feature, round(mutual_information, 8) AS mutual_information FROM mi")
def mi_classification(spark, folder):
    return rounded(importance.mi_classification(_numbers(spark, folder), "l_returnflag"), 8)


_Y_EDGES = f"(SELECT list_distinct(quantile_cont(l_extendedprice, {_DECILES})) FROM model_table)"
_MI_REGRESSION = _mi("len(list_filter(yedges.e, lambda q: q < long.y))").replace(
    "binned AS (", f"yedges AS (SELECT {_Y_EDGES} AS e), binned AS ("
).replace("len(list_filter(e, lambda q: q < x))", "len(list_filter(edges.e, lambda q: q < x))").replace(
    "ON long.feature = edges.feature)", "ON long.feature = edges.feature, yedges)"
)


@query("mi_regression", f"WITH {_REG_LONG}, {_MI_REGRESSION} SELECT feature, round(mutual_information, 8) AS mutual_information FROM mi")
def mi_regression(spark, folder):
    df = model_table(spark, folder).select(*MODEL_NUMBERS)
    return rounded(importance.mi_regression(df, "l_extendedprice"), 8)


_PEARSON_CLASS = """pearson AS (SELECT feature, abs(corr(x, code)) AS pearson FROM long
  JOIN (SELECT y, row_number() OVER (ORDER BY y) - 1 AS code FROM (SELECT DISTINCT y FROM long)) USING (y) GROUP BY feature)"""


@query("pearson_abs", f"WITH {_CLASS_LONG}, {_PEARSON_CLASS} SELECT feature, round(pearson, 8) AS pearson FROM pearson")
def pearson_classes(spark, folder):
    return rounded(importance.pearson_abs(_numbers(spark, folder), "l_returnflag", classes=True), 8)


@query(
    "pearson_abs_regression",
    f"WITH {_REG_LONG} SELECT feature, round(abs(corr(x, y)), 8) AS pearson FROM long GROUP BY feature",
)
def pearson_regression(spark, folder):
    return rounded(importance.pearson_abs(model_table(spark, folder).select(*MODEL_NUMBERS), "l_extendedprice"), 8)


@query(
    "feature_importance",
    f"""WITH {_CLASS_LONG}, {_ANOVA}, {_mi('y')}, {_PEARSON_CLASS}
        SELECT feature, round(f_score, 6) AS f_score, round(mutual_information, 6) AS mutual_information, round(pearson, 6) AS pearson
        FROM anova JOIN mi USING (feature) JOIN pearson USING (feature)""",
)
def feature_importance(spark, folder):
    return rounded(importance.feature_importance(_numbers(spark, folder), "l_returnflag", cache=True))


@query(
    "feature_importance_regression",
    f"""WITH {_REG_LONG}, {_F_REGRESSION}, {_MI_REGRESSION}, p AS (SELECT feature, abs(corr(x, y)) AS pearson FROM long GROUP BY feature)
        SELECT feature, round(f_score, 4) AS f_score, round(mutual_information, 6) AS mutual_information, round(pearson, 6) AS pearson
        FROM f JOIN mi USING (feature) JOIN p USING (feature)""",
)
def feature_importance_regression(spark, folder):
    df = model_table(spark, folder).select(*MODEL_NUMBERS)
    return rounded(rounded(importance.feature_importance(df, "l_extendedprice", cache=True), 4, "f_score"), 6, "mutual_information", "pearson")


_REAL_LONG = f"{REAL_LABELS}, long AS ({_unpivoted('real_labels', 'quality', ['n_chars', 'toxic'])})"


@query(
    "feature_importance_binary",
    f"""WITH {_REAL_LONG}, {_ANOVA}, {_mi('y')}, {_PEARSON_CLASS}
        SELECT feature, round(f_score, 6) AS f_score, round(mutual_information, 6) AS mutual_information, round(pearson, 6) AS pearson
        FROM anova JOIN mi USING (feature) JOIN pearson USING (feature)""",
)
def feature_importance_binary(spark, folder):
    df = real_labels(spark, folder).select("n_chars", "toxic", "quality")
    return rounded(importance.feature_importance(df, "quality"))


@query("mi_classification_neighbours")
def mi_classification_neighbours(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return rounded(information.neighbour_classification(df, "o_orderstatus", "o_orderkey", ["o_custkey", "o_totalprice"]))


@query("mi_regression_neighbours")
def mi_regression_neighbours(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(information.neighbour_regression(df, "p_retailprice", "p_partkey", ["p_size"]))
