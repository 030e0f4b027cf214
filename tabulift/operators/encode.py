"""Categorical encoding: a fitted dictionary per column and a projection or join that applies it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulift.functions.schema import col, free_name, string_columns
from tabulift.plans.frequencies import value_counts
from tabulift.plans.ranks import DICTIONARY_ROWS, number_rows
from tabulift.plans.scratch import durable

UNKNOWN_CODE = -1  # fixed value: a category that was not seen when fitting
UNSEEN_MISSING_CODE = -2  # fixed value: a missing value when fitting saw none
BROADCAST_BYTES = 8 << 20
MAX_ONE_HOT = 1000


@dataclass(frozen=True)
class Dictionary:
    """Category table (category, code or frequency) of one column with its measured size.

    ``beside`` counts the bytes of the smaller dictionaries of the same encoder: together at most BROADCAST_BYTES are broadcast.
    """

    column: str
    table: DataFrame
    rows: int
    bytes: int
    beside: int = 0

    @property
    def small(self) -> bool:
        return self.bytes + self.beside <= BROADCAST_BYTES

    def join(self, df: DataFrame, value: str, out: str) -> DataFrame:
        """Add the dictionary value of each row; rows without an entry get null.

        The dictionary is sent to every task only if its measured size allows it. Otherwise it is a shuffle join,
        which adaptive execution splits where one category holds many rows.
        """
        of = free_name([*df.columns, out], "category_")
        table = self.table.select(F.col("category").alias(of), F.col(value).alias(out))
        if self.small:
            table = F.broadcast(table)
        return df.join(table, col(self.column).eqNullSafe(F.col(of)), "left").drop(of)


def _categories(df: DataFrame, columns: Sequence[str], order_by: str | None) -> DataFrame:
    """(column, category, first, n) of all columns from one pass; a missing value is a category of its own."""
    at = col(order_by) if order_by else F.lit(0)
    entries = [F.struct(F.lit(c).alias("column"), col(c).alias("category"), at.alias("at")) for c in columns]
    rows = df.select(F.inline(F.array(*entries)))
    return rows.groupBy("column", "category").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))


def _fit_dictionaries(df: DataFrame, columns: Sequence[str], order_by: str | None) -> tuple[Dictionary, ...]:
    """Dictionary (category, code, frequency) of every column; code 1..k in order of appearance.

    Dictionaries whose measured size is small become local tables, so that applying them does not read the source
    again. Larger ones are written to shared storage once.
    """
    if not columns:
        return ()
    found = _categories(df, columns, order_by).persist()
    measured = found.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(F.octet_length("category"), F.lit(0)) + 48).alias("bytes"), F.sum("n").alias("total")
    )
    sizes = {r["column"]: r for r in measured.collect()}  # one row per column
    order = [F.asc("first"), F.asc_nulls_last("category")]
    beside, before = {}, 0
    for c in sorted(sizes, key=lambda c: sizes[c]["bytes"]):
        beside[c], before = before, before + int(sizes[c]["bytes"])
    small = [c for c in columns if c in sizes and sizes[c]["rows"] <= DICTIONARY_ROWS and sizes[c]["bytes"] + beside[c] <= BROADCAST_BYTES]
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    local: dict[str, list] = {c: [] for c in columns}
    for r in found.filter(F.col("column").isin(small)).select("column", "category", place.alias("code"), "n").collect():
        local[r["column"]].append((r["category"], r["code"], r["n"] / sizes[r["column"]]["total"]))
    out = []
    for c in columns:
        rows, size = (sizes[c]["rows"], int(sizes[c]["bytes"])) if c in sizes else (0, 0)
        if c in small or not rows:
            table = df.sparkSession.createDataFrame(local[c], "category string, code bigint, frequency double")
        else:
            own = found.filter(F.col("column") == c)
            share = F.col("n") / F.lit(sizes[c]["total"])
            table = durable(number_rows(own, order, rows).select("category", "code", share.alias("frequency")))
        out.append(Dictionary(c, table, rows, size, beside.get(c, 0)))
    found.unpersist()
    return tuple(out)


def fit_sorted(df: DataFrame, column: str) -> Dictionary:
    """Codes 0..k-1 in sorted order of the distinct values."""
    found = value_counts(df, column).select(F.col("value").alias("category")).persist()
    size = found.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col("category").cast("string")) + 48), F.lit(0)).alias("bytes")
    ).first()
    code = (F.col("code") - 1).alias("code")
    numbered = number_rows(found, [F.asc("category")], size["rows"]).select("category", code)
    if size["rows"] <= DICTIONARY_ROWS and size["bytes"] <= BROADCAST_BYTES:
        table = df.sparkSession.createDataFrame(numbered.collect(), numbered.schema)
    else:
        table = durable(numbered)
    found.unpersist()
    return Dictionary(column, table, size["rows"], int(size["bytes"]))


def _codes(dictionary: Dictionary, df: DataFrame, out: str) -> DataFrame:
    coded = dictionary.join(df, "code", out)
    unseen = F.when(col(dictionary.column).isNull(), F.lit(UNSEEN_MISSING_CODE)).otherwise(F.lit(UNKNOWN_CODE))
    return coded.withColumn(out, F.coalesce(col(out), unseen).cast("bigint"))


@dataclass(frozen=True)
class OrdinalEncoder:
    dictionaries: tuple[Dictionary, ...]

    @classmethod
    def fit(cls, df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> OrdinalEncoder:
        names = list(columns if columns is not None else string_columns(df))
        return cls(_fit_dictionaries(df, names, order_by))

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        code = free_name(order, "code_")
        for d in self.dictionaries:
            df = _codes(d, df, code).select(*[col(code).alias(c) if c == d.column else col(c) for c in order])
        return df.select(*[col(c) for c in order])


@dataclass(frozen=True)
class BinaryEncoder:
    """Ordinal code as base-2 digits, most significant first, in columns ``name_0``, ``name_1``, ..."""

    dictionaries: tuple[Dictionary, ...]

    @classmethod
    def fit(cls, df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> BinaryEncoder:
        return cls(OrdinalEncoder.fit(df, order_by, columns).dictionaries)

    def transform(self, df: DataFrame) -> DataFrame:
        out: list[Column] = []
        by_name = {d.column: d for d in self.dictionaries}
        coded, codes = df, {}
        for i, d in enumerate(self.dictionaries):
            codes[d.column] = code = free_name(coded.columns, f"code_{i}")
            coded = _codes(d, coded, code).withColumn(code, F.greatest(col(code), F.lit(0)))
        for c in df.columns:
            if c not in by_name:
                out.append(col(c))
                continue
            digits = max(1, by_name[c].rows.bit_length())
            out += [
                F.shiftright(col(codes[c]), digits - 1 - j).bitwiseAND(F.lit(1)).cast("int").alias(f"{c}_{j}")
                for j in range(digits)
            ]
        return coded.select(*out)


@dataclass(frozen=True)
class FrequencyEncoder:
    dictionaries: tuple[Dictionary, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] | None = None) -> FrequencyEncoder:
        names = list(columns if columns is not None else string_columns(df))
        return cls(_fit_dictionaries(df, names, None))

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        share = free_name(order, "share_")
        for d in self.dictionaries:
            df = d.join(df, "frequency", share)
            df = df.select(*[F.coalesce(col(share), F.lit(0.0)).alias(c) if c == d.column else col(c) for c in order])
        return df.select(*[col(c) for c in order])


@dataclass(frozen=True)
class OneHotEncoder:
    """One 0/1 column per category, named ``name_category``; a missing value seen when fitting gets ``name_nan``.

    A name that another column has, in any letter case, gets the first free number behind it. As every category is a
    column of the plan, there are at most ``max_categories``; ``one_hot_long`` has no such bound.
    """

    categories: dict[str, tuple]

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None, max_categories: int = MAX_ONE_HOT
    ) -> OneHotEncoder:
        names = list(columns if columns is not None else string_columns(df))
        if not names:
            return cls({})
        place = F.row_number().over(Window.partitionBy("column").orderBy(F.asc("first"), F.asc_nulls_last("category")))
        kept = _categories(df, names, order_by).withColumn("place", place).filter(F.col("place") <= max_categories + 1)
        found: dict[str, list] = {n: [] for n in names}
        for r in kept.orderBy("place").collect():  # at most max_categories + 1 rows per column
            found[r["column"]].append(r["category"])
        for n, values in found.items():
            if len(values) > max_categories:
                raise ValueError(f"column {n} has more than {max_categories} categories; use one_hot_long or another encoding")
        return cls({n: tuple(values) for n, values in found.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        taken = {c.lower() for c in df.columns if c not in self.categories}
        for c in df.columns:
            if c not in self.categories:
                out.append(col(c))
            for value in self.categories.get(c, ()):
                wanted = f"{c}_nan" if value is None else f"{c}_{value}"
                name = next(n for i in count(1) if (n := wanted if i == 1 else f"{wanted}_{i}").lower() not in taken)
                taken.add(name.lower())
                out.append(F.when(col(c).eqNullSafe(F.lit(value)), 1).otherwise(0).alias(name))
        return df.select(*out)


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(key, column, category) of every 1 of a one-hot encoding with any number of categories; a missing value is a null category."""
    names = list(columns if columns is not None else string_columns(df))
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("category")) for c in names]
    return df.select(col(key).alias(key), F.inline(F.array(*cells)))


def encode(df: DataFrame, method: str | None, order_by: str | None = None) -> DataFrame:
    """Encode every string column: "one-hot", "ordinal", "binary", "frequency", or None for no change."""
    if method is None or not string_columns(df):
        return df
    if method == "one-hot":
        return OneHotEncoder.fit(df, order_by=order_by).transform(df)
    if method == "frequency":
        return FrequencyEncoder.fit(df).transform(df)
    if method not in ("ordinal", "binary"):
        raise ValueError(f"unknown encoding method: {method}")
    if order_by is None:
        raise ValueError(f"{method} encoding needs order_by, the column that fixes the order of appearance")
    return (OrdinalEncoder if method == "ordinal" else BinaryEncoder).fit(df, order_by).transform(df)


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the position of the value among the sorted distinct values, from 0."""
    return fit_sorted(df, column).join(df, "code", out)
