"""Feature scaling: a plan of one scaler per column, then one arithmetic projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulift.functions.schema import col, double_value, numeric_columns
from tabulift.operators.profile import (
    NEAR_ZERO_VARIANCE,
    NumericSummary,
    numeric_summaries,
    outlier_counts_for,
)

MINMAX, STANDARD, ROBUST = "minmax", "standard", "robust"
# Limits beyond which a column without outliers is standardised.
WIDE_RANGE = 1000.0
WIDE_STD = 100.0


@dataclass(frozen=True)
class ColumnPlan:
    """What happens to one column: (x - center) / scale, or nothing."""

    column: str
    scaler: str | None
    reason: str
    outliers: int
    center: float = 0.0
    scale: float = 1.0


def _arithmetic(scaler: str, s: NumericSummary) -> tuple[float, float]:
    """Center and divisor; a zero divisor becomes one, which maps the column to zeros."""
    if scaler == MINMAX:
        center, scale = s.low, s.high - s.low
    elif scaler == STANDARD:
        center, scale = s.mean, s.std_population
    else:
        center, scale = s.median, s.q3 - s.q1
    return center, scale or 1.0


@dataclass(frozen=True)
class Scaler:
    plans: tuple[ColumnPlan, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        by_name = {p.column: p for p in self.plans if p.scaler}
        return df.select(
            *[
                ((double_value(df, c) - F.lit(by_name[c].center)) / F.lit(by_name[c].scale)).alias(c)
                if c in by_name
                else col(c)
                for c in df.columns
            ]
        )

    def plan_table(self, df: DataFrame) -> DataFrame:
        rows = [(p.column, p.scaler or "skip", p.reason, p.outliers) for p in self.plans]
        return df.sparkSession.createDataFrame(rows, "column string, scaler string, reason string, outliers bigint")


def _auto(name: str, s: NumericSummary, outliers: int) -> ColumnPlan:
    if not s.has_spread:
        return ColumnPlan(name, None, "constant", outliers)
    if s.variance < NEAR_ZERO_VARIANCE:
        return ColumnPlan(name, None, "near-zero variance", outliers)
    if outliers:
        scaler, reason = ROBUST, "outliers"
    elif s.high - s.low > WIDE_RANGE or s.std > WIDE_STD:
        scaler, reason = STANDARD, "wide"
    else:
        scaler, reason = MINMAX, "default"
    return ColumnPlan(name, scaler, reason, outliers, *_arithmetic(scaler, s))


def _scalable(summaries: dict[str, NumericSummary]) -> dict[str, NumericSummary]:
    """Columns that hold two or more values and something other than 0 and 1."""
    return {n: s for n, s in summaries.items() if s.has_spread and not s.binary}


def fit_auto(df: DataFrame) -> Scaler:
    """Choose per numeric column: robust if it has outliers, standard if it is wide, else min-max.

    Nothing is scaled if no column holds more than 0 and 1.
    """
    summaries = numeric_summaries(df)
    if not _scalable(summaries):
        return Scaler(())
    outliers = outlier_counts_for(df, summaries)
    return Scaler(tuple(_auto(n, s, outliers[n]) for n, s in summaries.items()))


def fit_manual(df: DataFrame, scaler: str, columns: Sequence[str] | None = None) -> Scaler:
    """The chosen scaler for every numeric column that holds more than 0 and 1 and is not constant."""
    if scaler not in (MINMAX, STANDARD, ROBUST):
        raise ValueError(f"unknown scaler: {scaler}")
    plans = []
    for n, s in _scalable(numeric_summaries(df, columns)).items():
        if s.variance > NEAR_ZERO_VARIANCE:
            plans.append(ColumnPlan(n, scaler, "chosen", 0, *_arithmetic(scaler, s)))
        else:
            plans.append(ColumnPlan(n, None, "near-zero variance", 0))
    return Scaler(tuple(plans))


def scale(df: DataFrame, option: str | None, scaler: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scaled table and plan for option None, "auto" or "manual"."""
    if option is None or not numeric_columns(df):
        fitted = Scaler(())
    elif option == "auto":
        fitted = fit_auto(df)
    elif option == "manual":
        fitted = fit_manual(df, scaler or ROBUST)
    else:
        raise ValueError(f"unknown scaling option: {option}")
    return fitted.transform(df), fitted.plan_table(df)
