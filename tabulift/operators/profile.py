"""Data quality and profiling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulift.functions.columns import long_rows
from tabulift.functions.schema import FLOAT_TYPES, col, double_value, free_name, numeric_columns, string_columns
from tabulift.plans.frequencies import distinct_counts, long_value_counts, stack, value_counts
from tabulift.plans.quantiles import Distribution, exact_quantiles, unpivoted

QUARTILES = (0.25, 0.5, 0.75)
FENCE = 1.5  # interquartile ranges beyond the quartiles


def is_missing(df: DataFrame, name: str) -> Column:
    missing = col(name).isNull()
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        missing = missing | F.isnan(col(name))
    return missing


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def missing_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing count and percentage (2 decimals) of every column, from one scan."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    rows = long_rows(
        stats,
        "column",
        {
            c: {
                "missing": F.col(f"m{i}"),
                "percentage": F.round(F.try_divide(F.col(f"m{i}") * F.lit(100.0), F.col("n")), 2),
            }
            for i, c in enumerate(df.columns)
        },
    )
    return rows.filter("missing > 0") if only_missing else rows


def missing_total(df: DataFrame) -> DataFrame:
    per_row = sum((is_missing(df, c).cast("bigint") for c in df.columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("missing"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; missing values are equal to each other."""
    n = free_name(df.columns, "n_")
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(n))
    return groups.agg(F.coalesce(F.sum(F.col(n) - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def unique_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values per column; by sketch instead of by count when asked."""
    if approximate:
        stats = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)])
        return long_rows(stats, "column", {c: {"distinct": F.col(f"d{i}")} for i, c in enumerate(df.columns)})
    return distinct_counts(df).drop("position")


@dataclass(frozen=True)
class NumericSummary:
    """Moments and quartiles of one numeric column, missing values left out; ``binary`` if it holds 0 and 1 only."""

    count: int
    mean: float | None
    std: float | None
    std_population: float | None
    variance: float | None
    low: float | None
    high: float | None
    q1: float | None
    median: float | None
    q3: float | None
    binary: bool = False

    @property
    def has_spread(self) -> bool:
        """At least two distinct values."""
        return self.count > 1 and self.high > self.low

    @property
    def fences(self) -> tuple[float, float] | None:
        """Limits beyond which a value is an outlier; none unless the interquartile range is positive."""
        if not self.has_spread or not self.q3 > self.q1:
            return None
        reach = FENCE * (self.q3 - self.q1)
        return self.q1 - reach, self.q3 + reach


def _only_binary(value: Column) -> Column:
    return F.bool_and(value.isin(0.0, 1.0))


def numeric_summaries(df: DataFrame, names=None) -> dict[str, NumericSummary]:
    """Fit statistics of numeric columns; only one number per statistic reaches the driver."""
    names = list(names if names is not None else numeric_columns(df))
    if not names:
        return {}
    values = {n: double_value(df, n) for n in names}
    quantiles = exact_quantiles(df, values, QUARTILES)
    x = F.col("x")
    moments = unpivoted(df, list(values.values())).groupBy("item").agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.stddev_pop(x).alias("std_population"),
        F.var_samp(x).alias("variance"),
        _only_binary(x).alias("binary"),
    )
    found = {r["item"]: r for r in moments.collect()}  # one row per column
    out = {}
    for i, n in enumerate(names):
        d: Distribution = quantiles[n]
        m = found[i].asDict() if i in found else {}
        out[n] = NumericSummary(
            d.count, m.get("mean"), m.get("std"), m.get("std_population"), m.get("variance"), d.low, d.high,
            *(d.at[p] for p in QUARTILES), bool(m.get("binary")),
        )
    return out


def outlier_counts_for(df: DataFrame, summaries: dict[str, NumericSummary]) -> dict[str, int]:
    """Outliers per column in one counting pass over the columns that have fences."""
    fenced = {n: s.fences for n, s in summaries.items() if s.fences}
    counts = dict.fromkeys(summaries, 0)
    if fenced:
        row = df.agg(
            *[
                F.count_if((double_value(df, n) < F.lit(lo)) | (double_value(df, n) > F.lit(hi))).alias(f"o{i}")
                for i, (n, (lo, hi)) in enumerate(fenced.items())
            ]
        ).first()
        counts.update({n: row[f"o{i}"] for i, n in enumerate(fenced)})
    return counts


def describe_numeric(df: DataFrame) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of every numeric column."""
    rows = [
        (n, s.count, s.mean, s.std, s.low, s.q1, s.median, s.q3, s.high) for n, s in numeric_summaries(df).items()
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double",
    )


def describe_categorical(df: DataFrame) -> DataFrame:
    """count, distinct values, most frequent value (smallest among equals) and its frequency per string column."""
    names = string_columns(df)
    empty = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    if not names:
        return empty.selectExpr("column", "0L as count", "0L as unique", "'' as top", "0L as freq")
    (_, counted), = long_value_counts(df, names)
    stats = counted.groupBy("column").agg(
        F.sum("count").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("count")).alias("neg"), F.col("value"))).alias("best"),
    )
    return empty.join(stats, "column", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("unique", F.lit(0)).alias("unique"),
        F.col("best.value").alias("top"),
        (-F.col("best.neg")).alias("freq"),
    )


def outlier_count_iqr(df: DataFrame, names=None) -> DataFrame:
    """Values outside the quartiles by more than 1.5 interquartile ranges, per numeric column."""
    counts = outlier_counts_for(df, numeric_summaries(df, names))
    return df.sparkSession.createDataFrame(list(counts.items()), "column string, outliers bigint")


def column_spread(df: DataFrame) -> DataFrame:
    """Distinct values, sample variance, range and sample standard deviation of every numeric column."""
    names = numeric_columns(df)
    stats = df.agg(
        *[
            f(double_value(df, n)).alias(f"{k}{i}")
            for i, n in enumerate(names)
            for k, f in (("var", F.var_samp), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))
        ]
    )
    spread = long_rows(
        stats,
        "column",
        {
            n: {"variance": F.col(f"var{i}"), "range": F.col(f"hi{i}") - F.col(f"lo{i}"), "std": F.col(f"sd{i}")}
            for i, n in enumerate(names)
        },
    )
    return distinct_counts(df, names).drop("position").join(spread, "column")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return value_counts(df, target).withColumnRenamed("value", "class")


def min_class_count(df: DataFrame, target: str) -> DataFrame:
    return value_counts(df, target).agg(F.coalesce(F.min("count"), F.lit(0)).alias("min_class_count"))


def smallest_class(df: DataFrame, target: str) -> int:
    return min_class_count(df, target).first()[0]


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """The tables of a data-quality page, each lazy or small."""
    return {
        "shape": shape(df),
        "types": column_types(df),
        "missing": missing_profile(df, only_missing=True),
        "duplicates": duplicate_count(df),
        "unique": unique_counts(df),
        "numeric": describe_numeric(df),
        "categorical": describe_categorical(df),
    }


def non_binary_numeric(df: DataFrame, names=None) -> list[str]:
    """Numeric columns that hold two or more values and something other than 0 and 1."""
    names = list(names if names is not None else numeric_columns(df))
    if not names:
        return []
    row = df.agg(
        *[
            f.alias(f"{k}{i}")
            for i, n in enumerate(names)
            for k, f in (
                ("lo", F.min(double_value(df, n))),
                ("hi", F.max(double_value(df, n))),
                ("binary", _only_binary(double_value(df, n))),
            )
        ]
    ).first()
    return [
        n for i, n in enumerate(names) if row[f"lo{i}"] is not None and row[f"hi{i}"] > row[f"lo{i}"] and not row[f"binary{i}"]
    ]


NEAR_ZERO_VARIANCE = 1e-9  # fixed value


def scalable_columns(df: DataFrame, names=None) -> list[str]:
    """Numeric columns with more than one distinct value (missing counts as one) and a variance above 1e-9."""
    names = list(names if names is not None else numeric_columns(df))
    if not names:
        return []
    row = df.agg(*[F.var_samp(double_value(df, n)).alias(f"v{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[f"v{i}"] is not None and row[f"v{i}"] > NEAR_ZERO_VARIANCE]
