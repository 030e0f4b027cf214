"""Row numbers and running totals over a whole table without pulling the table into one window task.

Rows are cut into ranges of the ordering value. A window runs inside each range, and the totals of the earlier ranges
(a table of at most ranges x groups rows) are added. The ranges are cut at explicit values, so a task that is run again
after an executor is lost puts every row in the same range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabulift.functions.columns import row_hash
from tabulift.functions.schema import col, free_name
from tabulift.plans.quantiles import sketch_splits
from tabulift.plans.scratch import durable

HASH_PREFIX = 3  # hex digits: 4,096 ranges of equal width in hash space
NEAR_ROWS = 100_000  # rows of one class that share a hash prefix, about, at most
BROADCAST_CLASSES = 20_000
DICTIONARY_ROWS = 100_000
RANGE_ROWS = 500_000  # rows of a range, about, and of the task that sorts it
MOST_RANGES = 1 << 14


def _range_count(df: DataFrame, rows: int) -> int:
    """As many ranges as the session shuffles into, and more where they would hold over ``RANGE_ROWS`` rows."""
    least = max(8, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return max(least, min(MOST_RANGES, -(-rows // RANGE_ROWS)))


def with_range(df: DataFrame, order: str, name: str = "_range", rows: int | None = None) -> DataFrame:
    """Add the number of the value range that the (double) column ``order`` falls in."""
    splits = sketch_splits(df, col(order), _range_count(df, rows or 0))
    if not splits:
        return df.withColumn(name, F.lit(0.0))
    cutter = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol=order, outputCol=name)
    return cutter.transform(df)


def _with_offsets(ranged: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Totals of all earlier ranges, per group."""
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_total_{out}") for c, out in sums.items()])
    return totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_total_{out}").over(earlier), F.lit(0)).alias(f"_offset_{out}") for out in sums.values()],
    )


def _join_offsets(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "_range"]
    renamed = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    condition = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        condition = part if condition is None else condition & part
    return rows.join(renamed, condition).drop(*[f"_k_{k}" for k in keys])


def running_totals(df: DataFrame, order: str, sums: dict[str, str], by=(), then=(), rows: int | None = None) -> DataFrame:
    """For each ``source: output`` pair add the sum of ``source`` over the rows ordered before this one.

    ``rows``, if known, lets the ranges and the tasks that sort them grow in number with the table and not in size.

    ``order`` must be a double column; together with the columns of ``then``, which settle equal values, it must be
    unique within each group of ``by``.
    """
    by = list(by)
    # An integer, as floating-point keys are normalised by windows and not by a repartition, which would then not serve the window.
    ranged = with_range(df, order, rows=rows).withColumn("_range", F.col("_range").cast("int"))
    parts, placed = -(-rows // RANGE_ROWS) if rows else 0, ranged
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        placed = ranged.repartition(2 * min(MOST_RANGES, parts), *[col(c) for c in (*by, "_range")])  # twice, as hashes deal unevenly
    before = Window.partitionBy(*by, "_range").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_own_{o}") for c, o in sums.items()])
    joined = _join_offsets(own, _with_offsets(ranged, by, sums), by)
    return joined.select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_own_{o}") + F.col(f"_offset_{o}")).alias(o) for o in sums.values()],
    )


@dataclass(frozen=True)
class HashCounts:
    """Rows per class and hash prefix of a table, kept in shared storage: all that ranks of row hashes need to know of most rows."""

    hashed: DataFrame  # (class, hash) of every row, not kept
    counted: DataFrame  # (class, prefix, here)
    digits: int

    def smallest(self) -> int:
        """Rows of the smallest class; a null class is no class. 0 for an empty table."""
        sizes = self.counted.where("class is not null").groupBy("class").agg(F.sum("here").alias("n"))
        return sizes.agg(F.coalesce(F.min("n"), F.lit(0))).first()[0]


def hash_counts(df: DataFrame, keys, seed: int, by: Column) -> HashCounts:
    """Count the rows per class and hash prefix in one pass, combined before the shuffle.

    The prefix gets one more digit for every factor of 16 that the table has beyond ``NEAR_ROWS`` rows per prefix; then it is counted once more.
    """
    hashed = df.select(by.alias("class"), row_hash(keys, seed).alias("hash"))

    def counted(digits: int) -> DataFrame:
        return durable(hashed.groupBy("class", F.substring("hash", 1, digits).alias("prefix")).agg(F.count(F.lit(1)).alias("here")))

    digits, found = HASH_PREFIX, counted(HASH_PREFIX)
    rows = found.agg(F.coalesce(F.sum("here"), F.lit(0))).first()[0]
    while rows > NEAR_ROWS * 16**digits:
        digits += 1
    return HashCounts(hashed, found if digits == HASH_PREFIX else counted(digits), digits)


def hash_cutoffs(counts: HashCounts, ranks: Column) -> DataFrame:
    """(class, cutoffs): for each class the row hashes at the wanted ranks in hash order.

    ``ranks`` is an array over the column ``n``, the rows of the class. Only the rows that share the prefix of a wanted rank are sorted, so
    such a window stays small.
    """
    of_class = Window.partitionBy("class")
    earlier = of_class.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.counted.select(
        "class", "prefix", "here", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(of_class).alias("n")
    )
    wanted = placed.select("class", "prefix", "here", "before", F.posexplode(ranks).alias("place", "rank"))
    wanted = wanted.filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("here")))
    wanted = wanted.select(
        F.col("class").alias("_class"), F.col("prefix").alias("_prefix"), "place", (F.col("rank") - F.col("before")).alias("at")
    )
    hashed = counts.hashed.withColumn("prefix", F.substring("hash", 1, counts.digits))
    near = hashed.join(wanted, F.col("class").eqNullSafe(F.col("_class")) & (F.col("prefix") == F.col("_prefix")))
    inside = F.row_number().over(Window.partitionBy("class", "place").orderBy("hash"))
    found = near.withColumn("row", inside).filter(F.col("row") == F.col("at"))
    return found.groupBy("class").agg(F.sort_array(F.collect_list("hash")).alias("cutoffs"))  # one hash per wanted rank


def passed_cutoffs(
    df: DataFrame, keys, seed: int, by: str, ranks: Column, name: str, counts: HashCounts | None = None
) -> DataFrame:
    """Add how many cutoffs of its class the hash of the row lies beyond; null for a class without cutoffs.

    The cutoffs (one row per class) are written and counted; up to ``BROADCAST_CLASSES`` classes they are broadcast and the table
    is not moved. For more classes the join shuffles the table by class. ``name`` must be free; any other column may have any name.
    """
    of, cuts = (free_name([*df.columns, name], c) for c in ("class_", "cutoffs"))
    cutoffs = _bounded(hash_cutoffs(counts or hash_counts(df, keys, seed, col(by)), ranks).toDF(of, cuts))
    joined = df.join(cutoffs, col(by).eqNullSafe(F.col(of)), "left")
    beyond = F.when(F.col(cuts).isNotNull(), F.size(F.filter(cuts, lambda c: c < row_hash(keys, seed))))
    return joined.select(*[col(c) for c in df.columns], beyond.cast("int").alias(name))


def _bounded(cutoffs: DataFrame) -> DataFrame:
    kept = durable(cutoffs)
    return F.broadcast(kept) if kept.count() <= BROADCAST_CLASSES else kept


def number_rows(df: DataFrame, order, rows: int, name: str = "code") -> DataFrame:
    """1-based position in the order of a dictionary table that has ``rows`` rows.

    A small dictionary is numbered by one window. A large one is sorted by range, written, and numbered per part.
    """
    if rows <= DICTIONARY_ROWS:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
        return df.select("*", place.cast("bigint").alias(name))
    stored = durable(df.orderBy(*order)).select("*", F.monotonically_increasing_id().alias("_id"))
    stored = stored.withColumn("_range", F.shiftright("_id", 33)).withColumn("_one", F.lit(1))
    offsets = _with_offsets(stored, [], {"_one": "_before"})
    joined = _join_offsets(stored, offsets, [])
    position = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_offset__before")
    return joined.select(*[col(c) for c in df.columns], position.cast("bigint").alias(name))
