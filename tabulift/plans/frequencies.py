"""Value counts: one row per distinct value, combined before the shuffle so that a hot value costs nothing extra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulift.functions.schema import FLOAT_TYPES, INTEGER_TYPES, col, double_value


def value_counts(df: DataFrame, name: str, with_missing: bool = False) -> DataFrame:
    """(value, count) of one column."""
    value = double_value(df, name) if isinstance(df.schema[name].dataType, FLOAT_TYPES) else col(name)
    rows = df.select(value.alias("value"))
    if not with_missing:
        rows = rows.filter(F.col("value").isNotNull())
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, name: str, k: int) -> DataFrame:
    """The k most frequent values; the smaller value first among equals."""
    return value_counts(df, name).orderBy(F.desc("count"), F.asc("value")).limit(k)


def top_value_list(df: DataFrame, name: str, k: int) -> list:
    """Top values on the driver, at most k of them."""
    return [r["value"] for r in top_values(df, name, k).collect()]


def _families(df: DataFrame, names):
    """Group columns by a common type that holds their values without loss."""
    groups: dict[str, list[str]] = {}
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, INTEGER_TYPES):
            family = "bigint"
        elif isinstance(kind, FLOAT_TYPES):
            family = "double"
        elif isinstance(kind, T.StringType):
            family = "string"
        else:
            family = kind.simpleString()
        groups.setdefault(family, []).append(name)
    return groups


def long_value_counts(df: DataFrame, names) -> list[tuple[str, DataFrame]]:
    """(column, value, count) of many columns, one table per type family.

    The columns are unpivoted and counted in a single aggregation per family instead of one job per column, and the
    values keep their type, so no number is formatted as text.
    """
    out = []
    for family, members in _families(df, names).items():
        structs = [
            F.struct(
                F.lit(n).alias("column"),
                (double_value(df, n) if family == "double" else col(n).cast(family)).alias("value"),
            )
            for n in members
        ]
        rows = df.select(F.inline(F.array(*structs))).filter(F.col("value").isNotNull())
        out.append((family, rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))))
    return out


def stack(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def distinct_counts(df: DataFrame, names=None) -> DataFrame:
    """(column, distinct) counting the values that are not missing, for every column."""
    names = list(names if names is not None else df.columns)
    parts = [
        counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        for _, counted in long_value_counts(df, names)
    ]
    all_names = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "column string, position int")
    return (
        all_names.join(stack(parts), "column", "left")
        .select("column", F.coalesce("distinct", F.lit(0)).cast("bigint").alias("distinct"), "position")
    )
