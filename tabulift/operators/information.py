"""Mutual information from nearest neighbours: Ross (2014) for a class, Kraskov et al. (2004) for a number.

Values are divided by their standard deviation and get a tiny reproducible jitter that separates equal values. Ranks,
neighbour distances and counts within a radius all come from range-partitioned sorts, so neither a class nor a value
that holds many rows is brought into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulift.functions.schema import col, double_value
from tabulift.operators.neighbours import CHEBYSHEV, nearest
from tabulift.plans.ranks import MOST_RANGES, RANGE_ROWS, running_totals
from tabulift.plans.scratch import durable

# Fixed values of the estimators.
NEIGHBOURS = 3
JITTER = 1e-10
SEED = 42

BLOCK_ROWS = 100_000
TWO_ULPS = 4.5e-16


def digamma(x: Column) -> Column:
    """Digamma of a positive number: six steps of the recurrence, then the asymptotic series."""
    y = x + F.lit(6.0)
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - reduce(lambda a, b: a + b, [1 / (x + F.lit(float(i))) for i in range(6)])


def digamma_number(n: int) -> float:
    y = n + 6.0
    series = math.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - sum(1 / (n + i) for i in range(6))


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _normal(key: Column, name: str) -> Column:
    """Standard normal number that depends on the row key and the column name only."""
    first, second = (_uniform(key, F.lit(name), F.lit(SEED), F.lit(part)) for part in (1, 2))
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2 * math.pi) * second)


def _prepared(df: DataFrame, names: Sequence[str], key: str) -> dict[str, Column]:
    """Scaled and jittered value expression per column; constant columns are only jittered."""
    stats = df.agg(
        *[f(double_value(df, n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("s", F.stddev_pop), ("m", _mean_size))]
    ).first()
    out = {}
    for i, n in enumerate(names):
        spread = stats[f"s{i}"] or 1.0
        amplitude = JITTER * max(1.0, (stats[f"m{i}"] or 0.0) / spread)
        out[n] = double_value(df, n) / F.lit(spread) + F.lit(amplitude) * _normal(col(key), n)
    return out


def _mean_size(value: Column) -> Column:
    return F.avg(F.abs(value))


def _long(df: DataFrame, values: dict[str, Column], key: str, *more: Column) -> DataFrame:
    """(id, feature, x) of every value."""
    items = [F.struct(F.lit(n).alias("feature"), v.alias("x")) for n, v in values.items()]
    return df.select(col(key).alias("id"), *more, F.inline(F.array(*items)))


def _parts(df: DataFrame, rows: int) -> int:
    """Tasks for so many rows: as many as the session shuffles into, and more where they would get over ``RANGE_ROWS`` rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, 2 * -(-rows // RANGE_ROWS)))


def _class_radius(points: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """Distance of every point (id, feature, class, n, x) to its k-th neighbour of the same class and feature.

    Points are numbered within their class; blocks of that order are overlapped by k points on either side.
    """
    ranked = running_totals(points.withColumn("one", F.lit(1)), "x", {"one": "rank"}, by=["feature", "class"], then=["id"], rows=rows)
    size = F.lit(BLOCK_ROWS)
    own = F.floor(F.col("rank") / size)
    first, last = F.floor(F.greatest(F.col("rank") - k, F.lit(0)) / size), F.floor((F.col("rank") + k) / size)
    blocks = ranked.withColumn("own", own).withColumn("block", F.explode(F.sequence(first, last)))
    if rows:
        blocks = blocks.repartition(_parts(points, rows), "feature", "class", "block")
    order = Window.partitionBy("feature", "class", "block").orderBy("rank")
    gap = F.lit(float("inf"))
    left = [F.lit(0.0), *[F.coalesce(F.col("x") - F.lag("x", i).over(order), gap) for i in range(1, k + 1)]]
    right = [F.lit(0.0), *[F.coalesce(F.lead("x", i).over(order) - F.col("x"), gap) for i in range(1, k + 1)]]
    spaced = blocks.select(
        "*", *[c.alias(f"left{i}") for i, c in enumerate(left)], *[c.alias(f"right{i}") for i, c in enumerate(right)]
    ).filter(F.col("block") == F.col("own"))

    def radius(count: int) -> Column:
        # The count-th neighbour lies i places to the left or count - i to the right, for the best i.
        return F.least(*[F.greatest(f"left{i}", f"right{count - i}") for i in range(count + 1)])

    wanted = F.least(F.lit(k), F.col("n") - 1)
    choice = reduce(lambda a, c: a.when(wanted == c, radius(c)), range(2, k + 1), F.when(wanted == 1, radius(1)))
    return spaced.select("id", "feature", "x", choice.alias("radius"))


def _counts_within(points: DataFrame, rows: int | None = None) -> DataFrame:
    """(feature, id, m): points of the feature closer than the radius, from rows (id, feature, x, radius); itself counts.

    Points and interval ends are sorted together; the difference of the running counts at both ends is the answer.
    The ends are drawn in by two units of the last place, so that the neighbour that defines the radius is left out.
    """
    points = durable(points)  # costly, and read once for the ranges and once for the counts
    margin = (F.abs("x") + F.col("radius")) * TWO_ULPS
    low, high = F.col("x") - F.col("radius") + margin, F.col("x") + F.col("radius") - margin
    entries = F.array(
        F.struct(F.col("x").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("one")),
        F.struct(low.alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("one")),
        F.struct(high.alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("one")),
    )
    events = points.select("id", "feature", F.inline(entries))
    counted = running_totals(events, "at", {"one": "before"}, by=["feature"], then=["kind", "id"], rows=3 * rows if rows else None)
    sign = F.when(F.col("kind") == 2, F.col("before")).otherwise(-F.col("before"))
    ends = counted.filter(F.col("kind") != 1)
    if rows:
        ends = ends.repartition(_parts(ends, 2 * rows), "feature", "id")
    return ends.groupBy("feature", "id").agg(F.sum(sign).alias("m"))


def neighbour_classification(df: DataFrame, target: str, key: str, features: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """(feature, mutual_information) of each number with the class, in nats; ``key`` must be unique."""
    names = list(features)
    classes = df.groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    n, wanted = F.col("n").cast("double"), F.least(F.lit(k), F.col("n") - 1).cast("double")
    whole = classes.agg(
        F.sum("n").alias("rows"), F.sum(n * digamma(wanted)).alias("k"), F.sum(n * digamma(n)).alias("classes")
    ).first()
    if not whole["rows"]:
        return df.sparkSession.createDataFrame([(f, 0.0) for f in names], "feature string, mutual_information double")
    points = _long(df, _prepared(df, names, key), key, col(target).alias("class")).join(classes, "class")
    cells = whole["rows"] * len(names)
    found = _counts_within(_class_radius(points, k, cells), cells).groupBy("feature").agg(F.avg(digamma(F.col("m").cast("double"))).alias("psi"))
    known = digamma_number(whole["rows"]) + (whole["k"] - whole["classes"]) / whole["rows"]
    return found.select("feature", F.greatest(F.lit(known) - F.col("psi"), F.lit(0.0)).alias("mutual_information"))


def neighbour_regression(df: DataFrame, target: str, key: str, features: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """(feature, mutual_information) of each number with a numeric target, in nats; ``key`` must be unique."""
    names = list(features)
    values = _prepared(df, [*names, target], key)
    rows = df.count()
    parts = []
    for name in names:
        plane = df.select(col(key).alias("id"), values[name].alias("x"), values[target].alias("y"))
        near = nearest(plane, plane, ["x", "y"], "id", "id", "id", k + 1, CHEBYSHEV)  # the row itself is the nearest
        reach = near.groupBy(F.col("test_key").alias("id")).agg(F.max("distance").alias("radius"))
        both = plane.join(reach, "id").select(
            "id", "radius", F.inline(F.array(F.struct(F.lit("x").alias("feature"), F.col("x")), F.struct(F.lit("y").alias("feature"), F.col("y").alias("x"))))
        )
        psi = _counts_within(both, 2 * rows).agg((F.sum(digamma(F.col("m").cast("double"))) / F.lit(float(rows))).alias("psi"))
        known = digamma_number(rows) + digamma_number(k)
        parts.append(psi.select(F.lit(name).alias("feature"), F.greatest(F.lit(known) - F.col("psi"), F.lit(0.0)).alias("mutual_information")))
    return reduce(DataFrame.unionByName, parts)
