"""Loading a table from a file, with missing-value tokens, type inference and integer narrowing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulift.functions.schema import col, integer_columns, nan_to_null
from tabulift.sources.records import read_records

# Texts that a CSV cell may hold for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Texts that make up a boolean column.
BOOLEAN_TOKENS = ("True", "TRUE", "true", "False", "FALSE", "false")

# Integer types from narrow to wide with their bounds; a column fits strictly inside them.
INTEGER_BOUNDS = (
    ("tinyint", -(1 << 7), (1 << 7) - 1),
    ("smallint", -(1 << 15), (1 << 15) - 1),
    ("int", -(1 << 31), (1 << 31) - 1),
)


class UnsupportedFile(ValueError):
    """The file name does not end in a supported extension."""


def extension(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Read a CSV or Parquet table, chosen by the extension whatever its case."""
    kind = extension(path)
    if kind == "csv":
        return load_csv(spark, path, schema, multi_line)
    if kind == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return nan_to_null(reader.parquet(path))
    raise UnsupportedFile(f"unsupported file type: {kind}")


def byte_size(text: str) -> int:
    """A setting like ``128m``, ``64KB`` or ``134217728b`` in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def _has_large_file(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than what one task reads; only the sizes are looked at."""
    most = byte_size(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return spark.read.format("binaryFile").load(path).where(F.col("length") > most).limit(1).count() > 0


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True, split: bool | None = None
) -> DataFrame:
    """CSV with a header. Without a schema the types are found in one extra scan; give one for large files.

    With ``multi_line`` quoted cells may hold line breaks. Files are then cut into ranges by ``read_records``, which costs one more pass,
    if one is larger than what a task reads, else each is read by one task; ``split`` says otherwise. Without ``multi_line``, which is
    right only if no cell holds a line break, every line end is a place to cut. Missing-value tokens count as null with and without a
    schema; a cell that does not fit its type in the schema is null. A row with fewer cells than the header gets nulls, one
    with more fails when it is read.
    """
    options = {"quote": '"', "escape": '"', "multiLine": multi_line}
    if schema is None:
        names, kinds = spark.read.csv(path, header=True, inferSchema=False, **options).columns, {}
    else:
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names, kinds = given.names, {f.name: f.dataType for f in given}
    surplus = "_surplus"
    while surplus in names:
        surplus += "_"
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, surplus]])
    if multi_line and (_has_large_file(spark, path) if split is None else split):
        cells = ", ".join(f"c{i} string" for i in range(len(texts)))
        parsed = F.from_csv("text", cells, {"quote": '"', "escape": '"'})
        raw = read_records(spark, path).select(parsed.alias("cells")).select("cells.*").toDF(*texts.names)
    else:
        raw = spark.read.csv(path, header=True, schema=texts, **options)
    checked = F.when(col(surplus).isNotNull(), F.raise_error(F.lit("a row has more cells than the header")))
    text = raw.select(*[F.coalesce(checked, F.when(~col(c).isin(*MISSING_TOKENS), col(c))).alias(c) for c in names])
    if kinds:
        return nan_to_null(text.select(*[col(c).try_cast(kinds[c]).alias(c) for c in names]))
    return text.select(*[_typed(c, kind).alias(c) for c, kind in _infer(text).items()])


def _typed(name: str, kind: str):
    return nan_free(col(name).cast(kind)) if kind == "double" else col(name).cast(kind)


def nan_free(value):
    return F.when(~F.isnan(value), value)


def _infer(text: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double, boolean and string that every value of the column can be read as."""
    checks = []
    for i, c in enumerate(text.columns):
        v = col(c)
        plain = v.rlike(r"^\s*[+-]?\d+\s*$")
        fits = {
            "bigint": plain & v.try_cast("bigint").isNotNull(),
            "double": v.try_cast("double").isNotNull() & ~v.rlike(r"[dDfF]\s*$"),
            "boolean": v.isin(*BOOLEAN_TOKENS),
        }
        # A missing cell gives null, which bool_and leaves out.
        checks += [F.bool_and(F.when(v.isNotNull(), fit)).alias(f"{kind}{i}") for kind, fit in fits.items()]
    if not checks:
        return {}
    # A column without any value becomes double.
    row = text.agg(*checks).first()
    kinds = {}
    for i, c in enumerate(text.columns):
        if row[f"double{i}"] is None:
            kinds[c] = "double"
        else:
            kinds[c] = next((k for k in ("bigint", "double", "boolean") if row[f"{k}{i}"]), "string")
    return kinds


def load_status(df: DataFrame | None) -> tuple[str, str]:
    """("empty" | "loaded" | "none", message) without counting the table."""
    if df is None:
        return "none", "no table given"
    if df.isEmpty():
        return "empty", "the table has no rows"
    return "loaded", "table loaded"


def narrowest_integer(low: int | None, high: int | None, current: str) -> str:
    if low is None:
        return current
    return next((kind for kind, lo, hi in INTEGER_BOUNDS if low > lo and high < hi), "bigint")


def narrow_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cast every integer column to the smallest type whose bounds lie strictly outside its values.

    Returns the table and the report (column, from, to). One scan finds all bounds.
    """
    names = integer_columns(df)
    kinds = dict(df.dtypes)
    target = {}
    if names:
        row = df.agg(*[f(col(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
        target = {n: narrowest_integer(row[f"lo{i}"], row[f"hi{i}"], kinds[n]) for i, n in enumerate(names)}
    table = df.select(*[col(c).cast(target[c]).alias(c) if c in target else col(c) for c in df.columns])
    report = df.sparkSession.createDataFrame([(n, kinds[n], t) for n, t in target.items()], "column string, from string, to string")
    return table, report


def preview(df: DataFrame, order_by: str, rows: int = 15) -> DataFrame:
    """First rows in the order of a key column."""
    return df.orderBy(col(order_by)).limit(rows)
