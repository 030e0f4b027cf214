"""Feature scores against a target. Every score comes from per-class or per-bin aggregates, never from paired rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulift.functions.columns import correlation, long_rows
from tabulift.functions.schema import col, double_value, numeric_columns, require_columns
from tabulift.operators import information
from tabulift.operators.profile import is_missing
from tabulift.operators.target import REGRESSION, infer_problem_type, is_classification
from tabulift.plans.quantiles import exact_quantiles, place_in_cuts, unpivoted
from tabulift.plans.ranks import number_rows
from tabulift.plans.scratch import held

MI_BINS = 10


def _features(df: DataFrame, target: str, features: Sequence[str] | None) -> list[str]:
    require_columns(df, [target])
    return list(features) if features is not None else [c for c in numeric_columns(df) if c != target]


def _class_scores(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """(feature, f_score, pearson) from sums over the classes.

    The rows are grouped by class and feature once; means are taken as distances to the overall mean, which keeps them
    precise. The covariance with a class code needs the class means only, so the codes are not joined to the rows.
    """
    values = [double_value(df, n) for n in names]
    whole = df.agg(F.approx_count_distinct(col(target)).alias("k"), *[F.avg(v).alias(f"a{i}") for i, v in enumerate(values)]).first()
    shifted = [v - F.lit(whole[f"a{i}"]) for i, v in enumerate(values)]
    per_class = (
        unpivoted(df, shifted, col(target).alias("class"))
        .groupBy("class", "item")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("d"), F.var_pop("x").alias("w"))
    )
    classes = df.select(col(target).alias("class")).distinct()
    # The approximate class count only chooses the way of numbering.
    codes = number_rows(classes, [F.asc("class")], whole["k"]).select(F.col("class").alias("_class"), F.col("code").cast("double"))
    coded = per_class.join(codes, F.col("class").eqNullSafe(F.col("_class")))
    n, d, code = F.col("n"), F.col("d"), F.col("code")
    sums = coded.groupBy("item").agg(
        F.sum(n).alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(n * code).alias("code1"),
        F.sum(n * code * code).alias("code2"),
        F.sum(n * d * d).alias("between"),
        F.sum(n * F.col("w")).alias("within"),
        F.sum(n * code * d).alias("covariance"),
    )
    f_score = F.try_divide(
        F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k"))
    )
    spread = (F.col("code2") - F.col("code1") * F.col("code1") / F.col("n")) * (F.col("between") + F.col("within"))
    pearson = F.abs(F.try_divide(F.col("covariance"), F.sqrt(spread)))
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("item") + 1)
    return sums.select(feature.alias("feature"), f_score.alias("f_score"), pearson.alias("pearson"))


def f_score_classification(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """One-way analysis of variance F per numeric feature."""
    names = _features(df, target, features)
    return _class_scores(df, target, names).select("feature", "f_score")


def f_score_regression(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """F of the one-feature linear regression: r^2 / (1 - r^2) * (n - 2); null for a constant feature or target."""
    names = _features(df, target, features)
    return long_rows(_correlations(df, target, names), "feature", {n: {"f_score": _regression_f(i)} for i, n in enumerate(names)})


def _correlations(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    y = double_value(df, target)
    return df.agg(F.count(F.lit(1)).alias("n"), *[correlation(double_value(df, n), y).alias(f"r{i}") for i, n in enumerate(names)])


def _regression_f(i: int) -> Column:
    share = F.pow(f"r{i}", F.lit(2))
    return F.try_divide(share, 1 - share) * (F.col("n") - 2)


def pearson_abs(df: DataFrame, target: str, features: Sequence[str] | None = None, classes: bool = False) -> DataFrame:
    """|correlation| with the target; with ``classes`` the target counts as the position of its sorted class."""
    names = _features(df, target, features)
    if not classes:
        return long_rows(_correlations(df, target, names), "feature", {n: {"pearson": F.abs(f"r{i}")} for i, n in enumerate(names)})
    return _class_scores(df, target, names).select("feature", "pearson")


def linear_scores(df: DataFrame, target: str, features: Sequence[str], classes: bool) -> DataFrame:
    """(feature, f_score, pearson) from one pass over the classes, or one pass over the rows for a numeric target."""
    names = list(features)
    if classes:
        return _class_scores(df, target, names)
    stats = _correlations(df, target, names)
    return long_rows(stats, "feature", {n: {"f_score": _regression_f(i), "pearson": F.abs(f"r{i}")} for i, n in enumerate(names)})


def _binned(df: DataFrame, names: list[str], bins: int, *more: Column) -> DataFrame:
    """Equal-frequency bin of every column as zone0, zone1, ...: how many of its inner quantiles lie below the value."""
    inner = [j / bins for j in range(1, bins)]
    values = {n: double_value(df, n) for n in names}
    found = exact_quantiles(df, values, inner)
    cuts = {}
    for n in names:
        edges = {math.nextafter(e, math.inf) for e in found[n].at.values() if e is not None}
        cuts[n] = sorted({-math.inf, math.inf, *edges})
    return place_in_cuts(df, values, cuts, *more)


def _pairs(placed: DataFrame, names: list[str], y: Column) -> DataFrame:
    structs = [F.struct(F.lit(n).alias("feature"), F.col(f"zone{i}").alias("bin")) for i, n in enumerate(names)]
    return placed.select(y.alias("y"), F.inline(F.array(*structs)))


def _mutual_information(pairs: DataFrame) -> DataFrame:
    """Mutual information in nats per feature from rows (feature, bin, y), by entropies of the contingency counts."""
    joint = pairs.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))

    def entropy_sum(keys, name):
        cells = joint if keys is None else joint.groupBy("feature", *keys).agg(F.sum("n").alias("n"))
        return cells.groupBy("feature").agg(F.sum("n").alias(f"n_{name}"), F.sum(F.col("n") * F.ln("n")).alias(name))

    parts = entropy_sum(None, "xy").join(entropy_sum(["bin"], "x"), "feature").join(entropy_sum(["y"], "y"), "feature")
    n = F.col("n_xy")
    information = F.ln(n) + (F.col("xy") - F.col("x") - F.col("y")) / n
    return parts.select("feature", F.greatest(information, F.lit(0.0)).alias("mutual_information"))


def mi_classification(df: DataFrame, target: str, features: Sequence[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    """Mutual information of each numeric feature, in equal-frequency bins, with the class."""
    names = _features(df, target, features)
    placed = _binned(df, names, bins, col(target).alias("y"))
    return _mutual_information(_pairs(placed, names, F.col("y")))


def mi_regression(df: DataFrame, target: str, features: Sequence[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    """Mutual information of each numeric feature with a numeric target, both in equal-frequency bins."""
    names = _features(df, target, features)
    placed = _binned(df, [*names, target], bins)
    return _mutual_information(_pairs(placed, names, F.col(f"zone{len(names)}")))


def feature_importance(
    df: DataFrame, target: str, kind: str | None = None, cache: bool = False, neighbours_key: str | None = None
) -> DataFrame:
    """All scores of every numeric feature, best first by mutual information, then F, then correlation.

    The table is read several times; ``cache`` keeps the columns in use meanwhile, which pays if ``df`` is costly.
    With a unique ``neighbours_key`` (not a feature then) mutual information is estimated from nearest neighbours instead
    of equal-frequency bins.
    """
    names = [n for n in _features(df, target, None) if n != neighbours_key]
    if not names:
        raise ValueError("no numeric features")
    used = df.select(*[col(c) for c in (*names, target, *([neighbours_key] if neighbours_key else []))])
    with held(used, cache) as rows:
        missing = rows.agg(*[F.bool_or(is_missing(rows, c)).alias(f"m{i}") for i, c in enumerate(rows.columns)]).first()
        if any(missing):
            raise ValueError("features or target hold missing values")
        kind = kind or infer_problem_type(rows, target)
        if not is_classification(kind) and kind != REGRESSION:
            raise ValueError(f"cannot score features for problem type: {kind}")
        classes = is_classification(kind)
        if neighbours_key:
            estimate = information.neighbour_classification if classes else information.neighbour_regression
            shared = estimate(rows, target, neighbours_key, names)
        else:
            shared = (mi_classification if classes else mi_regression)(rows, target, names)
        linear = linear_scores(rows, target, names, classes)
        scores = linear.join(shared, "feature", "left").select("feature", "f_score", "mutual_information", "pearson")
        found = scores.collect()  # one row per feature
    table = df.sparkSession.createDataFrame(found, "feature string, f_score double, mutual_information double, pearson double")
    return table.orderBy(
        F.desc_nulls_last("mutual_information"), F.desc_nulls_last("f_score"), F.desc_nulls_last("pearson"), "feature"
    )
