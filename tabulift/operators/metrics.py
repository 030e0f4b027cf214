"""Evaluation metrics over a (label, prediction[, score]) table. All are aggregates; none is binned or sampled."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulift.functions.schema import col
from tabulift.plans.ranks import running_totals

MAX_GRID = 300  # classes of a confusion matrix that is written out with its zeros


def _share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"))


def class_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class that occurs as label or prediction: support, precision, recall and f1, from one grouped count."""
    counts = df.groupBy(col(label).alias("a"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(zero).alias("hits")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    totals = counts.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    scored = totals.select(
        "class",
        "support",
        "hits",
        _share(F.col("hits"), F.col("predicted")).alias("precision"),
        _share(F.col("hits"), F.col("support")).alias("recall"),
    )
    product = F.lit(2.0) * F.col("precision") * F.col("recall")
    return scored.withColumn("f1", _share(product, F.col("precision") + F.col("recall")))


def _weighted(scores: DataFrame, name: str) -> DataFrame:
    return scores.agg(_share(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(f"{name}_weighted"))


def precision_weighted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _weighted(class_scores(df, label, prediction), "precision")


def recall_weighted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _weighted(class_scores(df, label, prediction), "recall")


def f1_weighted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _weighted(class_scores(df, label, prediction), "f1")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and the weighted precision, recall and f1 in one row."""
    scores = class_scores(df, label, prediction)
    rows = F.sum("support")
    return scores.agg(
        _share(F.sum("hits"), rows).alias("accuracy"),
        *[_share(F.sum(F.col(m) * F.col("support")), rows).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
    )


def confusion_cells(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n, of_actual, of_predicted) of the pairs that occur, with the totals of their row and column; any number of classes."""
    n = df.groupBy(col(label).alias("actual"), col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        "*", F.sum("n").over(Window.partitionBy("actual")).alias("of_actual"), F.sum("n").over(Window.partitionBy("predicted")).alias("of_predicted")
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", max_classes: int = MAX_GRID) -> DataFrame:
    """(actual, predicted, n) for every pair of the classes that occur, zeros included.

    The grid has classes x classes rows, so it is for at most ``max_classes``; ``confusion_cells`` holds the same counts without zeros.
    """
    counts = df.groupBy(col(label).alias("actual"), col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.select(F.explode(F.array("actual", "predicted")).alias("class")).distinct()
    classes = [r["class"] for r in seen.limit(max_classes + 1).collect()]
    if len(classes) > max_classes:
        raise ValueError(f"more than {max_classes} classes; use confusion_cells")
    kind = seen.schema["class"].dataType.simpleString()
    frame = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], f"actual {kind}, predicted {kind}")
    grid = F.broadcast(frame)
    return counts.join(grid, ["actual", "predicted"], "right").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support per class, followed by accuracy, macro and weighted averages."""
    scores = class_scores(df, label, prediction)
    names = ("precision", "recall", "f1")
    rows = F.sum("support")
    totals = scores.agg(
        rows.alias("support"),
        _share(F.sum("hits"), rows).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[_share(F.sum(F.col(m) * F.col("support")), rows).alias(f"weighted_{m}") for m in names],
    )

    def line(name, values):
        return F.struct(F.lit(name).alias("class"), *[v.cast("double").alias(m) for m, v in zip(names, values)], F.col("support"))

    nothing = F.lit(None)
    summary = totals.select(
        F.inline(
            F.array(
                line("accuracy", (nothing, nothing, F.col("accuracy"))),
                line("macro avg", [F.col(f"macro_{m}") for m in names]),
                line("weighted avg", [F.col(f"weighted_{m}") for m in names]),
            )
        )
    )
    return scores.select(F.col("class").cast("string"), *names, "support").unionByName(summary)


# --- ranking ---------------------------------------------------------------------------------------------------------


def _by_score(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """Positives and negatives per distinct score, so that later steps see a score once however often it occurs."""
    hit = col(label) == F.lit(positive)
    return df.groupBy(col(score).cast("double").alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )


def _area() -> Column:
    """Rank-sum area: pairs of a positive above a negative, ties half, over all pairs (in floating point)."""
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    return F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Exact area under the ROC curve; null if one of the two classes does not occur."""
    ranked = running_totals(_by_score(df, label, score, positive), "score", {"neg": "neg_below"})
    return ranked.agg(_area().alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, rows with at least that score counted as positive."""
    grouped = _by_score(df, label, score, positive)
    pos, neg = grouped.agg(F.sum("pos"), F.sum("neg")).first()
    ranked = running_totals(grouped, "score", {"pos": "pos_below", "neg": "neg_below"})
    return ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide((F.lit(neg) - F.col("neg_below")).cast("double"), F.lit(neg)).alias("fpr"),
        F.try_divide((F.lit(pos) - F.col("pos_below")).cast("double"), F.lit(pos)).alias("tpr"),
    )


def roc_auc_by_class(df: DataFrame, label: str, scores: Mapping[object, Column]) -> DataFrame:
    """(class, rows, roc_auc) of each class against the rest, from one score expression per class."""
    entries = [
        F.struct(F.lit(c).alias("class"), s.cast("double").alias("score"), (col(label) == F.lit(c)).alias("hit"))
        for c, s in scores.items()
    ]
    grouped = (
        df.select(col(label), F.inline(F.array(*entries)))
        .groupBy("class", "score")
        .agg(F.count_if(F.col("hit")).alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )
    ranked = running_totals(grouped, "score", {"neg": "neg_below"}, by=["class"])
    return ranked.groupBy("class").agg(F.sum("pos").alias("rows"), _area().alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, label: str, scores: Mapping[object, Column]) -> DataFrame:
    """One-vs-rest areas averaged with the class frequencies as weights."""
    per_class = roc_auc_by_class(df, label, scores)
    return per_class.agg(F.try_divide(F.sum(F.col("roc_auc") * F.col("rows")), F.sum("rows")).alias("roc_auc_ovr"))


# --- regression ------------------------------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """r2, mae, mse and rmse in one row from one scan."""
    y, e = col(label).cast("double"), (col(label) - col(prediction)).cast("double")
    sums = df.agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("variance")
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("mse"), F.col("variance"))
    return sums.select(r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def r2(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("r2")


def mae(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("mae")


def mse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("mse")


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("rmse")


def actual_vs_predicted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.select(
        col(label).alias("actual"), col(prediction).alias("predicted"), (col(label) - col(prediction)).alias("residual")
    )
