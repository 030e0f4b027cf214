"""Exact quantiles of large columns in a few scans with small buffers.

The built-in exact percentile keeps every distinct value of a column in one aggregation buffer. Here a KLL sketch
(merged in two levels so that no single task receives a sketch per input split) proposes a narrow bracket around each
wanted rank: the first scan. The second one counts the rows outside the brackets and writes the values inside them with their counts, about a
hundredth of the rows for each rank: the survivors, from which all else is found. A value that occurs very often is one row there.
Only if a sketch misses a rank is the table scanned again, with the bracket in the zone that holds the rank.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulift.plans.scratch import durable

SKETCH_K = 2000
SKETCH_MARGIN = 0.004  # about twice the rank error of a KLL sketch with k = 2000
SKETCH_GROUPS = 128
PICK_ROWS = 1 << 20  # distinct values that one task sorts when a rank is picked
SPLITS = 16  # parts that a bracket with more values is cut into, again and again
MAX_ZONES = 1 << 16


@dataclass(frozen=True)
class Distribution:
    """Count, extremes and requested quantiles of one column (missing values left out)."""

    count: int
    low: float | None
    high: float | None
    at: dict[float, float | None] = field(default_factory=dict)


def unpivoted(df: DataFrame, values: Sequence[Column], *more: Column) -> DataFrame:
    """(item, x) for every value that is not missing; the plan of what follows does not grow with the columns."""
    items = [F.struct(F.lit(i).alias("item"), v.alias("x")) for i, v in enumerate(values)]
    return df.select(*more, F.inline(F.array(*items))).filter(F.col("x").isNotNull())


def _sketch(df: DataFrame, values: Sequence[Column], probes: Sequence[Sequence[float]]):
    """Count, min, max and sketch quantiles of each value expression, one small row per expression."""
    every = sorted({float(p) for ps in probes for p in ps})
    partial = (
        unpivoted(df, values, (F.spark_partition_id() % SKETCH_GROUPS).alias("part"))
        .groupBy("item", "part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
            F.kll_sketch_agg_double("x", SKETCH_K).alias("sketch"),
        )
    )
    merged = partial.groupBy("item").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch")
    )
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in every]))
    rows = {r["item"]: r for r in merged.select("item", "n", "lo", "hi", found.alias("q")).collect()}
    out = []
    for i in range(len(values)):
        if i in rows:
            r = rows[i]
            out.append((r["n"], r["lo"], r["hi"], [r["q"][every.index(float(p))] for p in probes[i]]))
        else:
            out.append((0, None, None, None))
    return out


def sketch_splits(df: DataFrame, value: Column, buckets: int) -> list[float]:
    """Strictly increasing interior split points that cut the values into about equal parts.

    They only decide how rows are spread over tasks; no result depends on their precision.
    """
    probes = [i / buckets for i in range(1, buckets)]
    (_, low, _, found), = _sketch(df, [value], [probes])
    if found is None:
        return []
    return sorted({q for q in found if q > low})


def split_points(df: DataFrame, values: Sequence[Column], parts: int) -> list[list[float]]:
    """For each value expression at most ``parts`` - 1 ascending points between its values: between all of them if a sketch saw no more."""
    probes = [i / parts for i in range(parts + 1)]
    out = []
    for _, low, high, found in _sketch(df, values, [probes] * len(values)):
        seen = sorted({low, high, *found}) if found else []
        between = [a + (b - a) / 2 for a, b in zip(seen, seen[1:])]
        out.append(between[: parts - 1] if len(between) < parts else between[1:parts])
    return out


def exact_quantiles(
    df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float]
) -> dict[str, Distribution]:
    """Linear-interpolation quantiles of several double expressions at once, exact at any row count."""
    names = list(values)
    if not names:
        return {}
    probabilities = sorted(set(probabilities))
    probes = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-SKETCH_MARGIN, SKETCH_MARGIN)})
    sketched = _sketch(df, [values[n] for n in names], [probes] * len(names))

    total, low, high = {}, {}, {}
    bracket: dict[tuple[str, int], tuple[float, float]] = {}
    for name, (count, lo, hi, found) in zip(names, sketched):
        total[name], low[name], high[name] = count, lo, hi
        for p in probabilities if count else ():
            position = p * (count - 1)
            ends = (
                found[probes.index(max(0.0, p - SKETCH_MARGIN))],
                found[probes.index(min(1.0, p + SKETCH_MARGIN))],
            )
            for rank in {math.floor(position), math.ceil(position)}:
                bracket.setdefault((name, rank), ends)

    # A rank that a bracket missed gets a new one inside its zone. All ends stay fences, so its zone loses at least the rows on an end each time.
    known: dict[tuple[str, int], float] = {}
    fences: dict[str, set[float]] = {}
    while bracket:
        for (name, _), pair in bracket.items():
            fences.setdefault(name, set()).update(pair)
        _resolve(df, values, bracket, {n: fences[n] for n, _ in bracket}, known)

    out = {}
    for name in names:
        at: dict[float, float | None] = {}
        for p in probabilities:
            if not total[name]:
                at[p] = None
                continue
            position = p * (total[name] - 1)
            below, above = known[name, math.floor(position)], known[name, math.ceil(position)]
            at[p] = below + (above - below) * (position - math.floor(position))
        out[name] = Distribution(total[name], low[name], high[name], at)
    return out


def _cuts(ends: set[float]) -> list[float]:
    """Split points that put every end into a zone of its own."""
    return sorted({-math.inf, math.inf, *ends, *(math.nextafter(e, math.inf) for e in ends)})


def _single_value(cuts: list[float], zone: int) -> bool:
    return cuts[zone + 1] == math.nextafter(cuts[zone], math.inf)


def place_in_cuts(df: DataFrame, values: Mapping[str, Column], cuts: Mapping[str, list[float]], *more: Column) -> DataFrame:
    """Columns x0, x1, ... with the values and zone0, zone1, ... with their place among the cuts of each column."""
    count = range(len(cuts))
    cutter = Bucketizer(
        splitsArray=list(cuts.values()), inputCols=[f"x{i}" for i in count], outputCols=[f"zone{i}" for i in count]
    )
    return cutter.transform(df.select(*more, *[values[n].alias(f"x{i}") for i, n in enumerate(cuts)]))


def _zoned(df: DataFrame, values: Mapping[str, Column], cuts: Mapping[str, list[float]]) -> DataFrame:
    """(item, zone, x) per value, item being the position of the column in ``cuts``."""
    items = [
        F.struct(F.lit(i).alias("item"), F.col(f"zone{i}").cast("int").alias("zone"), F.col(f"x{i}").alias("x"))
        for i in range(len(cuts))
    ]
    return place_in_cuts(df, values, cuts).select(F.inline(F.array(*items))).filter(F.col("zone").isNotNull())


@dataclass(frozen=True)
class _Wanted:
    """The value at place ``at`` (from 0) among the survivors of a zone with ``low <= x < high``."""

    name: str
    rank: int
    item: int
    zone: int
    low: float
    high: float
    at: int

    def rows(self) -> Column:
        here = (F.col("item") == self.item) & (F.col("zone") == self.zone) & (F.col("x") >= F.lit(self.low))
        return here if math.isinf(self.high) else here & (F.col("x") < F.lit(self.high))


def _resolve(df, values, bracket, fences, known) -> None:
    """Write the survivors of the brackets; settle ranks that fall on a fence or inside a bracket, and set new brackets for the others."""
    cuts = {n: _cuts(e) for n, e in fences.items()}
    names = list(cuts)
    inside = {
        names.index(name) * MAX_ZONES + zone
        for (name, _), (low, high) in bracket.items()
        for zone in range(bisect_left(cuts[name], low) + 1, bisect_left(cuts[name], high))
        if not _single_value(cuts[name], zone)
    }
    value = F.when((F.col("item") * MAX_ZONES + F.col("zone")).isin(list(inside)), F.col("x")) if inside else F.lit(None).cast("double")
    kept = durable(_zoned(df, values, cuts).groupBy("item", "zone", value.alias("x")).agg(F.count(F.lit(1)).alias("n")))
    # At most columns x zones rows, whatever the table holds.
    counted = {(r["item"], r["zone"]): r["n"] for r in kept.groupBy("item", "zone").agg(F.sum("n").alias("n")).collect()}

    wanted, missed = [], []
    for name, rank in list(bracket):
        item, before = names.index(name), 0
        for zone in range(len(cuts[name]) - 1):
            here = counted.get((item, zone), 0)
            if rank < before + here:
                break
            before += here
        low, high = cuts[name][zone], cuts[name][zone + 1]
        if _single_value(cuts[name], zone):
            known[name, rank] = low
        elif item * MAX_ZONES + zone in inside:
            wanted.append(_Wanted(name, rank, item, zone, low, high, rank - before))
        else:
            condition = (values[name] >= F.lit(low)) & ((values[name] < F.lit(high)) | F.lit(math.isinf(high)))
            missed.append(((name, rank), condition, before, here))
    while wanted:
        wanted = _pick(kept, wanted, known)
    for key in known:
        bracket.pop(key, None)
    if missed:
        _narrow(df, values, bracket, missed)


def _pick(kept: DataFrame, wanted: list[_Wanted], known) -> list[_Wanted]:
    """Take the values at the wanted places where one task can sort the survivors; return the others with tighter bounds."""
    rows = kept.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.when(w.rows(), F.col("x")).alias("x"), F.col("n")) for i, w in enumerate(wanted)])))
    rows = rows.where("x is not null")
    sizes = {r["i"]: r["k"] for r in rows.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}
    small = [i for i in range(len(wanted)) if sizes.get(i, 0) <= PICK_ROWS]
    if small:
        at = F.create_map(*[c for i in small for c in (F.lit(i), F.lit(wanted[i].at))])[F.col("i")]
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        placed = rows.where(F.col("i").isin(small)).withColumn("upto", upto).withColumn("at", at)
        for r in placed.where("upto > at and upto - n <= at").select("i", "x").collect():
            known[wanted[r["i"]].name, wanted[r["i"]].rank] = r["x"]
    large = [w for i, w in enumerate(wanted) if i not in small]
    return _tightened(kept, large) if large else []


def _tightened(kept: DataFrame, wanted: list[_Wanted]) -> list[_Wanted]:
    """Cut the values of each into SPLITS parts of about equally many values and keep the part that holds the place."""
    probes = [i / SPLITS for i in range(1, SPLITS)]
    found = [sorted(set(q)) for *_, q in _sketch(kept, [F.when(w.rows(), F.col("x")) for w in wanted], [probes] * len(wanted))]
    parts = [
        F.struct(F.lit(i).alias("i"), F.when(w.rows(), F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("x")))).alias("part"), F.col("n"))
        for i, (w, cuts) in enumerate(zip(wanted, found))
    ]
    rows = kept.select(F.inline(F.array(*parts))).where("part is not null")
    counted = {(r["i"], r["part"]): r["n"] for r in rows.groupBy("i", "part").agg(F.sum("n").alias("n")).collect()}
    out = []
    for i, (w, cuts) in enumerate(zip(wanted, found)):
        part, before = 0, 0
        while w.at >= before + counted.get((i, part), 0):
            before += counted.get((i, part), 0)
            part += 1
        low, high = ([w.low, *cuts][part], [*cuts, w.high][part])
        out.append(replace(w, low=low, high=high, at=w.at - before))
    return out


def _narrow(df, values, bracket, narrow) -> None:
    """Sketch only the rows that can still hold the rank and set the bracket closely around it."""
    exprs = [F.when(condition, values[name]) for (name, _), condition, _, _ in narrow]
    probes = []
    for (_, rank), _, before, count in narrow:
        p = (rank - before) / max(1, count - 1)
        probes.append([max(0.0, p - SKETCH_MARGIN), min(1.0, p + SKETCH_MARGIN)])
    for (key, _, _, _), (_, _, _, found) in zip(narrow, _sketch(df, exprs, probes)):
        bracket[key] = (found[0], found[1])
