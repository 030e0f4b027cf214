"""What the operators share: shared storage, batch functions over texts, bounded broadcasts, component labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulift.plans.scratch import scratch_path

#: Rows of a side that may be broadcast; every broadcast of this subpackage is behind this check.
BROADCAST_ROWS = 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that nothing before is computed again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_schema(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted name, with underscores until no column of the table has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def by_rows(df: DataFrame, schema: str, columns: tuple[str, ...], row: Callable, buffer: int = 1 << 22) -> DataFrame:
    """``row(*values)`` yields (size, result tuple) pairs for every input row; results go out whenever ``buffer`` bytes are full.

    Rows are handled one at a time, so that the memory of a task is one input batch and one output buffer.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(as_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, full = [], 0
        for batch in batches:
            for values in zip(*(map(_value, batch.column(batch.schema.get_field_index(c))) for c in columns)):
                for size, result in row(*values):
                    rows.append(result)
                    full += size
                if full >= buffer:
                    yield _batch(rows, out)
                    rows, full = [], 0
        if rows:
            yield _batch(rows, out)

    return df.select(*columns).mapInArrow(run, as_schema(schema))


def _value(scalar):
    return scalar.as_py()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Lists that all are numpy arrays become one array of their elements and the places of the cuts."""
    if not (pa.types.is_list(kind) and all(isinstance(x, np.ndarray) for x in values)):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)], dtype="int64")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)).cast(kind.value_type), type=kind)


class Remembered:
    """The values of recently used keys, at most ``2 * most`` of them: keys that are used again outlive the others."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a stored table for broadcast if it holds few rows; else the join shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def with_variant(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Add ``name``: 0, or, for rows of a key that has several different texts, a hash of the row's text.

    Key and variant together tell texts apart, so that places found in one text never go to another one of its key.
    """
    hashed = df.where(quoted(key).isNotNull() & quoted(text).isNotNull()).select(quoted(key).alias("of"), F.xxhash64(quoted(text)).alias("h"))
    ends = hashed.groupBy("of").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = stored(ends.where("low < high").select("of"), "several")
    if several.limit(1).count() == 0:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    at = free_name(df, "of")
    joined = df.join(small(several.withColumnRenamed("of", at)), quoted(key) == quoted(at), "left")
    return joined.withColumn(name, F.when(quoted(at).isNotNull(), F.xxhash64(quoted(text))).otherwise(0).cast("bigint")).select(*map(quoted, df.columns), quoted(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): component is the smallest node that can be reached.

    Large-star and small-star rounds until no edge changes: the result has a star around the smallest node of each
    component. Smallest neighbours are found by a grouped minimum, which combines before the shuffle, so that a node
    with many neighbours needs no task of its own. Rounds grow with the logarithm of a component's width.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(least, "a")
        star = turned.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(h, 32))).first())
