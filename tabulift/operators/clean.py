"""Missing values and duplicate rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulift.functions.schema import col, double_value, free_name, nan_to_null, numeric_columns, string_columns
from tabulift.operators.profile import is_missing
from tabulift.plans.frequencies import long_value_counts
from tabulift.plans.quantiles import exact_quantiles

IMPUTE, DROP, KEEP, DEDUPE = "impute", "drop", "keep", "remove"


def replace_empty(df: DataFrame) -> DataFrame:
    """Exact empty strings become missing values."""
    texts = set(string_columns(df))
    return df.select(*[F.nullif(col(c), F.lit("")).alias(c) if c in texts else col(c) for c in df.columns])


def _columns_with_missing(df: DataFrame, names) -> list[str]:
    names = list(names)
    if not names:
        return []
    row = df.agg(*[F.coalesce(F.bool_or(is_missing(df, c)), F.lit(False)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"m{i}"]]


def medians(df: DataFrame, names) -> dict[str, float | None]:
    """Median per column; None for a column without any value."""
    found = exact_quantiles(df, {n: double_value(df, n) for n in names}, [0.5])
    return {n: d.at[0.5] for n, d in found.items()}


def modes(df: DataFrame, names) -> dict[str, object]:
    """Most frequent value per string column, the smallest among equals."""
    if not names:
        return {}
    (_, counted), = long_value_counts(df, names)
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("count")).alias("neg"), F.col("value"))).alias("best"))
    return {r["column"]: r["best"]["value"] for r in best.collect()}  # one row per column


@dataclass(frozen=True)
class Imputer:
    """Fitted fill values. Columns that never hold a value have none and stay as they are."""

    as_double: tuple[str, ...]
    fill: dict[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            value = double_value(df, c) if c in self.as_double else col(c)
            if self.fill.get(c) is not None:
                value = F.coalesce(value, F.lit(self.fill[c]))
            out.append(value.alias(c))
        return df.select(*out)


def fit_median(df: DataFrame) -> Imputer:
    """Median per numeric column. If any numeric value is missing, all numeric columns come back as double."""
    names = numeric_columns(df)
    missing = _columns_with_missing(df, names)
    return Imputer(tuple(names) if missing else (), medians(df, missing))


def fit_mode(df: DataFrame) -> Imputer:
    return Imputer((), modes(df, _columns_with_missing(df, string_columns(df))))


def impute_median(df: DataFrame) -> DataFrame:
    return fit_median(df).transform(df)


def impute_mode(df: DataFrame) -> DataFrame:
    return fit_mode(df).transform(df)


def drop_na_rows(df: DataFrame) -> DataFrame:
    """Remove rows with any missing value."""
    return df.na.drop("any")


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


@dataclass(frozen=True)
class CleanResult:
    table: DataFrame
    report: DataFrame
    missing_left: int
    duplicates_left: int


@dataclass(frozen=True)
class TableState:
    """Counts over a table and over its distinct rows."""

    rows: int
    missing: int
    empty: int
    duplicates: int
    missing_in_distinct: int


def _table_state(df: DataFrame) -> TableState:
    """Rows, missing cells, empty strings and duplicate rows, from one shuffle of the table."""
    cells = sum((is_missing(df, c).cast("bigint") for c in df.columns), F.lit(0))
    empty = sum((F.coalesce(col(c) == "", F.lit(False)).cast("bigint") for c in string_columns(df)), F.lit(0))
    count = free_name(df.columns, "n_")
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(count))
    n, missing = F.col("n"), F.col("missing")
    row = groups.select(F.col(count).alias("n"), cells.alias("missing"), empty.alias("empty")).agg(
        F.sum(n), F.sum(n * missing), F.sum(n * F.col("empty")), F.sum(n - 1), F.sum(missing)
    )
    return TableState(*(int(v or 0) for v in row.first()))


def _missing_handled(table: DataFrame, missing: str, lines: list) -> DataFrame:
    if missing == IMPUTE:
        numbers, texts = fit_median(table), fit_mode(table)
        lines.append(("missing numbers", "median", len(numbers.fill)))
        lines.append(("missing categories", "mode", len(texts.fill)))
        return texts.transform(numbers.transform(table))
    return drop_na_rows(table)


def clean_table(df: DataFrame, treat_empty: bool = False, missing: str = KEEP, duplicates: str = KEEP) -> DataFrame:
    """The cleaned table of ``clean`` without its report, and therefore without the scans that the report costs."""
    _check(missing, duplicates)
    table = replace_empty(nan_to_null(df)) if treat_empty else nan_to_null(df)
    if missing != KEEP:
        table = _missing_handled(table, missing, [])
    return drop_duplicates(table) if duplicates == DEDUPE else table


def _check(missing: str, duplicates: str) -> None:
    if missing not in (IMPUTE, DROP, KEEP) or duplicates not in (DEDUPE, KEEP):
        raise ValueError("missing: impute, drop or keep; duplicates: remove or keep")


def clean(df: DataFrame, treat_empty: bool = False, missing: str = KEEP, duplicates: str = KEEP) -> CleanResult:
    """Empty strings, then missing values (impute, drop or keep), then duplicate rows (remove or keep).

    The report needs the state of the table before and after; each state is one shuffle of the whole rows.
    """
    _check(missing, duplicates)
    table = nan_to_null(df)
    before = _table_state(table)
    lines: list[tuple[str, str, int]] = []
    missing_now = before.missing
    if treat_empty:
        missing_now += before.empty
        lines.append(("empty strings", "replaced by missing", before.empty))
        if before.empty:
            table = replace_empty(table)
    after = before
    if missing_now and missing != KEEP:
        table = _missing_handled(table, missing, lines)
        after = _table_state(table)
        if missing == DROP:
            lines.append(("missing values", "rows dropped", before.rows - after.rows))
    elif missing_now:
        lines.append(("missing values", "left as is", missing_now))
        if missing_now != before.missing:
            after = _table_state(table)
    rows, missing_left, duplicates_left = after.rows, after.missing, after.duplicates
    if duplicates_left and duplicates == DEDUPE:
        table = drop_duplicates(table)
        lines.append(("duplicate rows", "removed", duplicates_left))
        rows, missing_left, duplicates_left = rows - duplicates_left, after.missing_in_distinct, 0
    elif duplicates_left:
        lines.append(("duplicate rows", "left as is", duplicates_left))
    lines += [
        ("rows", "before", before.rows),
        ("rows", "after", rows),
        ("missing cells", "before", before.missing),
        ("missing cells", "after", missing_left),
        ("duplicates", "before", before.duplicates),
        ("duplicates", "after", duplicates_left),
    ]
    report = df.sparkSession.createDataFrame(lines, "subject string, action string, amount bigint")
    return CleanResult(table, report, missing_left, duplicates_left)
