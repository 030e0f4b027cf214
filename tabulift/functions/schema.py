"""Type families, column-name normalisation and missing-value normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = (*INTEGER_TYPES, *FLOAT_TYPES, T.DecimalType)


def col(name: str) -> Column:
    """Column reference that is safe for names holding dots, spaces or punctuation."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns, wanted: str) -> str:
    """The wanted name, with underscores behind it until none of the columns has it in any letter case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _columns_of(df: DataFrame, kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric family. Booleans, dates and timestamps are not part of it."""
    return _columns_of(df, NUMERIC_TYPES)


def integer_columns(df: DataFrame) -> list[str]:
    return _columns_of(df, INTEGER_TYPES)


def string_columns(df: DataFrame) -> list[str]:
    """Categorical family."""
    return _columns_of(df, T.StringType)


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in string_columns(df)])


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not in table: {', '.join(missing)}")


def choose_target(df: DataFrame, target: str | None) -> str | None:
    """Validate a target choice; None and the text "None" both mean that there is no target."""
    if target is None or target == "None":
        return None
    require_columns(df, [target])
    return target


def feature_target_split(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    require_columns(df, [target])
    return df.drop(target), df.select(col(target))


def select_features(df: DataFrame, target: str, features=None) -> DataFrame:
    """Keep the chosen features (default: every other column) and the target."""
    chosen = list(features) if features is not None else [c for c in df.columns if c != target]
    require_columns(df, [*chosen, target])
    return df.select(*[col(c) for c in chosen if c != target], col(target))


def double_value(df: DataFrame, name: str) -> Column:
    """Column as double with NaN read as missing."""
    value = col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, FLOAT_TYPES):
        value = F.when(~F.isnan(value), value)
    return value.cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN apart from NULL; the operators know one kind of missing value only."""
    floats = set(_columns_of(df, FLOAT_TYPES))
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def normalized_name(name: str) -> str:
    return re.sub(r"[^\w\s]+", "", name.strip()).replace(" ", "_").lower()


def normalize_names(df: DataFrame) -> DataFrame:
    """Trim, drop punctuation, blanks to underscores, lower case; colliding names get _2, _3, ..."""
    taken: set[str] = set()
    names = []
    for original in df.columns:
        base = normalized_name(original) or "column"
        name, n = base, 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)
