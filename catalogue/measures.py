"""Evaluation metrics on predictions derived from whole tables by arithmetic."""

from pyspark.sql import functions as F

from catalogue.fixtures import PREDICTIONS, predictions
from catalogue.registry import query, rounded
from tabulift.operators import metrics

CLASSES = f"""{PREDICTIONS}, classes AS (SELECT label AS class FROM predictions UNION SELECT prediction FROM predictions),
  scores AS (SELECT class,
      (SELECT count(*) FROM predictions WHERE label = class) AS support,
      (SELECT count(*) FROM predictions WHERE prediction = class) AS predicted,
      (SELECT count(*) FROM predictions WHERE label = class AND prediction = class) AS hits FROM classes),
  rates AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS precision,
      CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS recall FROM scores),
  report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates)"""


@query("accuracy", f"WITH {PREDICTIONS} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM predictions")
def accuracy(spark, folder):
    return rounded(metrics.accuracy(predictions(spark, folder)), 8)


for _name in ("precision", "recall", "f1"):

    def _run(spark, folder, _name=_name):
        return rounded(getattr(metrics, f"{_name}_weighted")(predictions(spark, folder)), 8)

    query(
        f"{_name}_weighted",
        f"WITH {CLASSES} SELECT round(CAST(sum({_name} * support) / sum(support) AS DOUBLE), 8) AS {_name}_weighted FROM report",
    )(_run)


@query(
    "confusion_matrix",
    f"""WITH {CLASSES} SELECT a.class AS actual, p.class AS predicted,
        (SELECT count(*) FROM predictions WHERE label = a.class AND prediction = p.class) AS n FROM classes a, classes p""",
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(predictions(spark, folder))


@query(
    "confusion_cells",
    f"""WITH {PREDICTIONS}, cells AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM predictions GROUP BY 1, 2)
        SELECT *, CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS of_actual, CAST(sum(n) OVER (PARTITION BY predicted) AS BIGINT) AS of_predicted FROM cells""",
)
def confusion_cells(spark, folder):
    return metrics.confusion_cells(predictions(spark, folder))


@query(
    "classification_report",
    f"""WITH {CLASSES} SELECT CAST(class AS VARCHAR) AS class, round(CAST(precision AS DOUBLE), 8) AS precision, round(CAST(recall AS DOUBLE), 8) AS recall,
          round(CAST(f1 AS DOUBLE), 8) AS f1, support FROM report
        UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM predictions), 8),
          (SELECT count(*) FROM predictions)
        UNION ALL SELECT 'macro avg', round(CAST(avg(precision) AS DOUBLE), 8), round(CAST(avg(recall) AS DOUBLE), 8), round(CAST(avg(f1) AS DOUBLE), 8),
          CAST(sum(support) AS BIGINT) FROM report
        UNION ALL SELECT 'weighted avg', round(CAST(sum(precision * support) / sum(support) AS DOUBLE), 8),
          round(CAST(sum(recall * support) / sum(support) AS DOUBLE), 8), round(CAST(sum(f1 * support) / sum(support) AS DOUBLE), 8),
          CAST(sum(support) AS BIGINT) FROM report""",
)
def classification_report(spark, folder):
    return rounded(metrics.classification_report(predictions(spark, folder)), 8)


_RANKED = """ranked AS (SELECT score, hit, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
  FROM predictions)"""


@query(
    "roc_auc",
    f"""WITH {PREDICTIONS}, {_RANKED} SELECT round(CAST((sum(CASE WHEN hit = 1 THEN r ELSE 0 END) - sum(hit) * (sum(hit) + 1) / 2.0)
        / (sum(hit) * CAST(count(*) - sum(hit) AS DOUBLE)) AS DOUBLE), 10) AS roc_auc FROM ranked""",
)
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(predictions(spark, folder), "hit", "score"), 10)


@query(
    "roc_curve",
    f"""WITH {PREDICTIONS}, g AS (SELECT score, sum(hit) AS p, sum(1 - hit) AS n FROM predictions GROUP BY score)
        SELECT score AS threshold, round(CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER (), 10) AS fpr,
               round(CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER (), 10) AS tpr
        FROM g WINDOW w AS (ORDER BY score DESC)""",
)
def roc_curve(spark, folder):
    return rounded(metrics.roc_curve(predictions(spark, folder), "hit", "score"), 10, "fpr", "tpr")


_OVR = f"""{PREDICTIONS}, long AS (SELECT 0 AS class, score0 AS s, label = 0 AS hit FROM predictions
    UNION ALL SELECT 1, score1, label = 1 FROM predictions UNION ALL SELECT 2, score2, label = 2 FROM predictions),
  ranked AS (SELECT class, hit, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2.0 AS r FROM long),
  areas AS (SELECT class, count_if(hit) AS p, CAST((sum(CASE WHEN hit THEN r ELSE 0 END) - count_if(hit) * (count_if(hit) + 1) / 2.0) AS DOUBLE)
      / (CAST(count_if(hit) AS DOUBLE) * (count(*) - count_if(hit))) AS auc FROM ranked GROUP BY class)"""


def _scores():
    return {0: F.col("score0"), 1: F.col("score1"), 2: F.col("score2")}


@query("roc_auc_ovr", f"WITH {_OVR} SELECT round(sum(auc * p) / sum(p), 10) AS roc_auc_ovr FROM areas")
def roc_auc_ovr(spark, folder):
    return rounded(metrics.roc_auc_ovr(predictions(spark, folder), "label", _scores()), 10)


@query("roc_auc_by_class", f'WITH {_OVR} SELECT CAST(class AS INTEGER) AS class, CAST(p AS BIGINT) AS "rows", round(auc, 10) AS roc_auc FROM areas')
def roc_auc_by_class(spark, folder):
    return rounded(metrics.roc_auc_by_class(predictions(spark, folder), "label", _scores()), 10)


_REGRESSION = {
    "r2": "1 - sum((amount - estimate) * (amount - estimate)) / (var_pop(amount) * count(*))",
    "mae": "avg(abs(amount - estimate))",
    "mse": "avg((amount - estimate) * (amount - estimate))",
    "rmse": "sqrt(avg((amount - estimate) * (amount - estimate)))",
}
for _name, _sql in _REGRESSION.items():

    def _run(spark, folder, _name=_name):
        digits = 2 if _name == "mse" else 6
        return rounded(getattr(metrics, _name)(predictions(spark, folder), "amount", "estimate"), digits)

    query(_name, f"WITH {PREDICTIONS} SELECT round({_sql}, {2 if _name == 'mse' else 6}) AS {_name} FROM predictions")(_run)


@query(
    "actual_vs_predicted",
    f"""WITH {PREDICTIONS} SELECT amount AS actual, round(estimate, 4) AS predicted, round(amount - estimate, 4) AS residual FROM predictions""",
)
def actual_vs_predicted(spark, folder):
    return rounded(metrics.actual_vs_predicted(predictions(spark, folder), "amount", "estimate"), 4, "predicted", "residual")
