"""Problem type of a target column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulift.functions.schema import FLOAT_TYPES, INTEGER_TYPES, NUMERIC_TYPES, choose_target, col
from tabulift.operators.profile import is_missing

# Names of the problem types.
BINARY, MULTICLASS, REGRESSION = "Binary Classification", "Multiclass Classification", "Regression"
CONSTANT = "Constant Target"
NO_DATA, HAS_MISSING, NOT_FOUND, UNKNOWN_TYPE = (
    "Error: No data",
    "Error: Target has NaNs",
    "Error: Target not found",
    "Error: Unknown Type",
)
# Fixed values of the rules for numbers.
FEW_INTEGERS = 15
DISTINCT_SHARE = 0.05
DISTINCT_LIMIT_SHARE = 0.1
FEW_WHOLE_FLOATS = 5


def _one_row(df: DataFrame, target: str | None, kind: str | None) -> DataFrame:
    return df.sparkSession.createDataFrame([(target, kind)], "target string, problem_type string")


def problem_type(df: DataFrame, target: str | None) -> DataFrame:
    """One row (target, problem_type), decided by one pass over the target column."""
    if target is not None and target != "None" and target not in df.columns:
        return _one_row(df, target, NO_DATA if df.isEmpty() else NOT_FOUND)
    target = choose_target(df, target)
    if target is None:
        return _one_row(df, None, NO_DATA if df.isEmpty() else None)
    kind = df.schema[target].dataType
    whole = (col(target) % 1 == 0) if isinstance(kind, NUMERIC_TYPES) else F.lit(False)
    # Counting per value first keeps the distinct count spread over tasks.
    values = df.select(col(target).alias("v"), is_missing(df, target).alias("missing"), whole.alias("whole"))
    per_value = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bool_or("missing").alias("missing"), F.bool_and("whole").alias("whole"))
    s = per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.bool_or("missing"), F.lit(False)).alias("missing"),
        F.count("v").alias("distinct"),
        F.bool_and("whole").alias("whole"),
    )
    distinct, rows = F.col("distinct"), F.col("rows")
    answer = (
        F.when(rows == 0, NO_DATA).when(F.col("missing"), HAS_MISSING).when(distinct <= 1, CONSTANT)
    )
    if isinstance(kind, T.BooleanType):
        answer = answer.otherwise(BINARY)
    elif isinstance(kind, T.StringType):
        answer = answer.when(distinct == 2, BINARY).otherwise(MULTICLASS)
    elif isinstance(kind, INTEGER_TYPES):
        discrete = (distinct < FEW_INTEGERS) | (
            (distinct / rows < DISTINCT_SHARE) & (distinct < rows * F.lit(DISTINCT_LIMIT_SHARE))
        )
        answer = answer.when(distinct == 2, BINARY).when(discrete, MULTICLASS).otherwise(REGRESSION)
    elif isinstance(kind, (*FLOAT_TYPES, T.DecimalType)):
        coded = (distinct <= FEW_WHOLE_FLOATS) & F.col("whole")
        answer = answer.when(distinct == 2, BINARY).when(coded, MULTICLASS).otherwise(REGRESSION)
    else:
        answer = answer.otherwise(UNKNOWN_TYPE)
    return s.select(F.lit(target).alias("target"), answer.alias("problem_type"))


def infer_problem_type(df: DataFrame, target: str | None) -> str | None:
    return problem_type(df, target).first()["problem_type"]


def is_classification(kind: str | None) -> bool:
    return bool(kind) and kind.endswith("Classification")
