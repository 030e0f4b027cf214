"""Registry of queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that gives the same rows if there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round the named double columns (default: all) so that summation order cannot show."""
    chosen = set(names) or {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])
