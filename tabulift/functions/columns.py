"""Column expressions used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulift.functions.schema import col

HASH_SPACE = 1 << 32


def row_hash(keys, seed: int) -> Column:
    """Hex digest of the row key and a seed: a reproducible shuffle order that any engine can repeat.

    The parts are joined by ``|``; a backslash or ``|`` inside a part gets a backslash before it and a null is ``\\N``, so
    that different keys never give the same text.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return F.md5(F.concat_ws("|", *[_part(col(k).cast("string")) for k in keys], F.lit(str(seed))))


def _part(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(escaped, F.lit("\\N"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of two double expressions over the rows that have both, as an aggregate; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def hash_number(keys, seed: int) -> Column:
    """First 32 bits of the row hash as a number in [0, 2**32)."""
    return F.conv(F.substring(row_hash(keys, seed), 1, 8), 16, 10).cast("bigint")


def long_rows(wide: DataFrame, label: str, per_item: dict[str, dict[str, Column]]) -> DataFrame:
    """Turn a one-row statistics table into one row per item.

    ``per_item`` maps an item name to its output columns over ``wide``.
    """
    structs = [
        F.struct(F.lit(name).alias(label), *[c.alias(k) for k, c in values.items()])
        for name, values in per_item.items()
    ]
    return wide.select(F.inline(F.array(*structs)))
