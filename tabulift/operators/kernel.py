"""Kernel machines by random Fourier features (Rahimi and Recht, 2007): an explicit map whose inner products
approximate the Gaussian kernel, so that linear training scales with the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulift.functions.schema import col, double_value
from tabulift.plans.quantiles import exact_quantiles
from tabulift.plans.scratch import dealt

DIMENSIONS = 128
#: Numbers that the random features of one task's rows hold, about: 64 MB.
TASK_NUMBERS = 1 << 23
# Fixed values of the support vector regressor.
EPSILON = 0.1
PENALTY = 1.0

ROUNDS = 20
TOLERANCE = 1e-4


def scale_gamma(df: DataFrame, features: Sequence[str]) -> float:
    """1 / (features x variance of all feature values)."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(double_value(df, f)).alias(f"a{i}") for i, f in enumerate(features)],
        *[F.var_pop(double_value(df, f)).alias(f"v{i}") for i, f in enumerate(features)],
    ).first()
    means = np.array([row[f"a{i}"] for i in range(len(features))], dtype=float)
    variances = np.array([row[f"v{i}"] for i in range(len(features))], dtype=float)
    overall = variances.mean() + means.var()
    return float(1.0 / (len(features) * overall)) if overall > 0 else 1.0


def dealt_for_kernel(df: DataFrame, rows: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """The table in so many parts that the random features of each stay small: they are many times as wide as the rows, and read in every round."""
    return dealt(df, rows, max(1, TASK_NUMBERS // dimensions))


def projection(inputs: int, gamma: float, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and phases of the Gaussian kernel exp(-gamma |x - y|^2)."""
    random = np.random.default_rng(seed)
    return random.normal(0.0, np.sqrt(2.0 * gamma), (inputs, dimensions)), random.uniform(0.0, 2.0 * np.pi, dimensions)


def fourier(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that maps a feature vector to its random Fourier features."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    dimensions = Param(Params._dummy(), "dimensions", "number of random features", TypeConverters.toInt)
    inputs = Param(Params._dummy(), "inputs", "length of the feature vector", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel_features", gamma=1.0, dimensions=DIMENSIONS, inputs=1, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", gamma=1.0, dimensions=DIMENSIONS, inputs=1, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        directions, phases = projection(get("inputs"), get("gamma"), get("dimensions"), get("seed"))

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(fourier(np.stack(x.to_numpy()), directions, phases)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(col(self.getInputCol())))))


def fit_support_vector_regressor(
    df: DataFrame, features: Sequence[str], target: str, names, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = 42
) -> PipelineModel:
    """Support vector regression on random Fourier features by iteratively reweighted least squares (Perez-Cruz, 2000).

    A residual beyond epsilon gets the weight C / |residual|, one within it none, and each round is a weighted ridge
    regression that Spark sums up over the tasks. The round with the smallest objective is kept. ``names`` tells the columns
    that the pipeline adds.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol=names.features, handleInvalid="error")
    lift = RandomFourierFeatures(
        inputCol=names.features, outputCol=names.lifted, gamma=scale_gamma(df, features), dimensions=dimensions, inputs=len(features), seed=seed
    )
    y = double_value(df, target)
    table = df.select(*[col(f) for f in dict.fromkeys(features)], y.alias(names.label))
    label, prediction = col(names.label), col(names.prediction)
    spread_out = dealt_for_kernel(table, table.count(), dimensions)
    rows = PipelineModel([assembler, lift]).transform(spread_out).select(names.lifted, names.label).persist()
    middle = exact_quantiles(table, {"y": label}, [0.5])["y"].at[0.5]
    made = {"featuresCol": names.lifted, "labelCol": names.label, "predictionCol": names.prediction}

    best, best_objective, model, predicted = None, float("inf"), None, rows.withColumn(names.prediction, F.lit(middle))
    for turn in range(rounds + 1):
        beyond = F.abs(label - prediction)
        weighted = predicted.withColumn("weight", F.when(beyond > EPSILON, F.lit(PENALTY) / beyond).otherwise(0.0))
        shifted = label - F.lit(middle)
        row = weighted.agg(
            F.sum("weight").alias("w"),
            F.sum(F.col("weight") * shifted).alias("wy"),
            F.sum(F.col("weight") * shifted * shifted).alias("wyy"),
            F.sum(F.greatest(beyond - F.lit(EPSILON), F.lit(0.0))).alias("loss"),
        ).first()
        norm = 0.0 if model is None else 0.5 * float(model.coefficients.dot(model.coefficients))
        objective = norm + PENALTY * row["loss"]
        improved = best_objective - objective
        if model is not None and objective < best_objective:
            best, best_objective = model, objective
        if turn == rounds or not row["w"] or (best is not None and abs(improved) <= TOLERANCE * best_objective):
            break
        spread = math.sqrt(max(0.0, row["wyy"] / row["w"] - (row["wy"] / row["w"]) ** 2))
        # Spark divides the squared penalty by the spread of the label, so the strength is multiplied by it.
        ridge = LinearRegression(
            **made, weightCol="weight", regParam=spread / row["w"],
            elasticNetParam=0.0, standardization=False, solver="normal",
        )
        model = ridge.fit(weighted.drop(names.prediction))
        predicted = model.transform(rows)
    rows.unpersist()
    if best is None:  # every label lies within epsilon of the median
        best = LinearRegression(**made, regParam=1.0, solver="normal").fit(rows)
    return PipelineModel([assembler, lift, best])
