"""The small tables behind charts: each function reduces a large table to what one chart shows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulift.functions.columns import row_hash
from tabulift.functions.schema import col, double_value, nan_to_null, numeric_columns
from tabulift.operators.clean import fit_median
from tabulift.operators.profile import FENCE, QUARTILES
from tabulift.plans.frequencies import top_value_list, top_values, value_counts
from tabulift.plans.quantiles import exact_quantiles
from tabulift.plans.ranks import hash_counts, hash_cutoffs

# Sizes of the charts.
TOP_VALUES = 20
TOP_CATEGORIES = 15
TOP_HUES = 10
HISTOGRAM_BINS = 30
KDE_POINTS = 200
KDE_CUT = 3.0
VIOLIN_POINTS = 100
VIOLIN_CUT = 2.0
PAIRPLOT_COLUMNS = 5
HUE_LEVELS = 15
MAX_SAMPLE = 50_000

KERNEL_ROWS = 2_000  # values whose kernels are evaluated together
KERNEL_GROUPS = 10_000  # groups whose sums a task holds


# --- samples and top lists -------------------------------------------------------------------------------------------


def sample_rows(df: DataFrame, key, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all rows if there are fewer): those with the smallest key hash; rows whose whole key is equal are one choice.

    The hash at rank n is found from counts per hash prefix; the rows up to it are a filter, so no task sees all n rows.
    """
    if n <= 0:
        return df.limit(0)
    cutoffs = hash_cutoffs(hash_counts(df, key, seed, F.lit(0)), F.array(F.least(F.col("n"), F.lit(n)))).first()
    return df if cutoffs is None else df.filter(row_hash(key, seed) <= F.lit(cutoffs["cutoffs"][0]))


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _unique(names) -> list[Column]:
    return [col(n) for n in dict.fromkeys(names)]


def top_k_values(df: DataFrame, name: str, k: int = TOP_VALUES) -> DataFrame:
    return top_values(df, name, k)


def count_bars(df: DataFrame, name: str) -> DataFrame:
    """Bars of a count chart: the 20 most frequent values."""
    return top_values(df, name, TOP_VALUES)


def top_k_other(df: DataFrame, name: str, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values and one row for the rest, if there is a rest: "Other", or with as many stars behind it as tell it from a value."""
    kept = top_value_list(df, name, k)
    rest = "Other"
    while rest in map(str, kept):
        rest += "*"
    value = F.when(F.col("value").isin(kept), F.col("value").cast("string"))
    counted = value_counts(df, name).withColumn("label", value).groupBy("label").agg(F.sum("count").alias("count"))
    return counted.select(F.coalesce("label", F.lit(rest)).alias("value"), "count")


def pie_shares(df: DataFrame, name: str, k: int = TOP_VALUES) -> DataFrame:
    """Slices of a pie with their percentage."""
    slices = top_k_other(df, name, k)  # at most k + 1 rows
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return slices.select("value", "count", (F.col("count") * F.lit(100.0) / total).alias("percentage"))


def sort_by_x(df: DataFrame, x: str) -> DataFrame:
    return df.orderBy(col(x))


# --- one numeric column ----------------------------------------------------------------------------------------------


def histogram(df: DataFrame, name: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, left, right, count) of equal-width bins over the range of the values; the last bin is closed."""
    value = double_value(df, name)
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, count bigint")
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    position = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1))
    rows = df.select(value.alias("x")).filter(F.col("x").isNotNull())
    counts = rows.groupBy(position.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (hi - lo) / bins
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _grid(points: int, cut: float) -> tuple[Column, Column]:
    """Start and step of the evaluation grid from the columns lo, hi and bw."""
    start = F.col("lo") - F.lit(cut) * F.col("bw")
    step = (F.col("hi") - F.col("lo") + F.lit(2 * cut) * F.col("bw")) / F.lit(points - 1)
    return start.alias("start"), step.alias("step")


def _density(weighted: DataFrame, groups: DataFrame, points: int) -> DataFrame:
    """Kernel sums of weighted values (group, x, w, bw, start, step) on the grids of the groups (group, n, bw, start, step).

    Each task adds the kernels of its values up, batch by batch, into one array per group; rows are not expanded over the grid, and
    the shuffle carries one array per task and group.
    """
    keyed = weighted.withColumn("g", F.xxhash64("group"))
    sums = keyed.select("g", "x", "w", "bw", "start", "step").mapInPandas(_kernel_sums(points), "g bigint, kernels array<double>")
    kernel = sums.select("g", F.posexplode("kernels").alias("point", "kernel")).groupBy("g", "point").agg(F.sum("kernel").alias("kernel"))
    return kernel.join(groups.withColumn("g", F.xxhash64("group")), "g").select(
        "group",
        "point",
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.col("kernel") / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"),
    )


def _kernel_sums(points: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, rows in batch.groupby("g", sort=False):
                grid = rows["start"].iloc[0] + np.arange(points) * rows["step"].iloc[0]
                total = totals.setdefault(g, np.zeros(points))
                x, w, bw = rows["x"].to_numpy(), rows["w"].to_numpy(), rows["bw"].iloc[0]
                for at in range(0, len(x), KERNEL_ROWS):
                    z = (grid - x[at : at + KERNEL_ROWS, None]) / bw
                    total += w[at : at + KERNEL_ROWS] @ np.exp(-0.5 * z * z)
            if len(totals) > KERNEL_GROUPS:
                yield pd.DataFrame({"g": list(totals), "kernels": list(totals.values())})
                totals = {}
        if totals:
            yield pd.DataFrame({"g": list(totals), "kernels": list(totals.values())})

    return run


def grouped_kde(rows: DataFrame, points: int, cut: float) -> DataFrame:
    """Gaussian density per group from rows (group, x), bandwidth by Scott's rule; groups without spread are left out."""
    rows = rows.filter(F.col("x").isNotNull())
    weighted = rows.groupBy("group", "x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    params = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd")
    )
    params = params.filter("sd > 0").withColumn("bw", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    groups = params.select("group", "n", "bw", *_grid(points, cut))
    of = groups.select(F.col("group").alias("_group"), "bw", "start", "step")
    placed = weighted.join(of, F.col("group").eqNullSafe(F.col("_group"))).drop("_group")
    return _density(placed, groups, points)


def kde(df: DataFrame, name: str, points: int = KDE_POINTS, cut: float = KDE_CUT) -> DataFrame:
    """(point, x, density) of a Gaussian kernel density estimate."""
    rows = df.select(F.lit(0).alias("group"), double_value(df, name).alias("x")).filter(F.col("x").isNotNull())
    fit = rows.agg(
        F.count("x").alias("n"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.stddev_samp("x").alias("sd"),
        F.approx_count_distinct("x").alias("distinct"),
    ).first()
    if not fit["sd"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    # Counting equal values first pays only where values repeat.
    if fit["distinct"] * 4 < fit["n"]:
        rows = rows.groupBy("group", "x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    bandwidth = fit["sd"] * fit["n"] ** -0.2
    fitted = {k: F.lit(v) for k, v in {"n": fit["n"], "lo": fit["lo"], "hi": fit["hi"], "bw": bandwidth}.items()}
    known = rows.withColumns(fitted).select("group", "x", "w", "bw", *_grid(points, cut))
    one = df.sparkSession.range(1).select(F.lit(0).alias("group")).withColumns(fitted).select("group", "n", "bw", *_grid(points, cut))
    return _density(known, one, points).drop("group")


def _boxes(df: DataFrame, values: Mapping[object, Column], label: str, label_type: str) -> DataFrame:
    """Box-plot numbers of several value expressions: quartiles, then one pass for whiskers and outliers."""
    found = exact_quantiles(df, {str(i): v for i, v in enumerate(values.values())}, QUARTILES)
    items = []
    aggs = []
    for i, (key, v) in enumerate(values.items()):
        d = found[str(i)]
        if not d.count:
            continue
        q1, median, q3 = (d.at[p] for p in QUARTILES)
        reach = FENCE * (q3 - q1)
        inside = (v >= F.lit(q1 - reach)) & (v <= F.lit(q3 + reach))
        aggs += [
            F.min(F.when(inside, v)).alias(f"lo{i}"),
            F.max(F.when(inside, v)).alias(f"hi{i}"),
            F.count_if(~inside).alias(f"out{i}"),
        ]
        items.append((i, key, d.count, q1, median, q3))
    rows = []
    if aggs:
        row = df.agg(*aggs).first()
        for i, key, count, q1, median, q3 in items:
            low = q1 if row[f"lo{i}"] is None else min(row[f"lo{i}"], q1)
            high = q3 if row[f"hi{i}"] is None else max(row[f"hi{i}"], q3)
            rows.append((key, count, q1, median, q3, low, high, row[f"out{i}"]))
    return df.sparkSession.createDataFrame(
        rows,
        f"{label} {label_type}, count bigint, q1 double, median double, q3 double, whisker_low double, whisker_high double, "
        "outliers bigint",
    )


def box_stats(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme data within 1.5 interquartile ranges) and outlier count per numeric column."""
    names = list(names if names is not None else numeric_columns(df))
    return _boxes(df, {n: double_value(df, n) for n in names}, "column", "string")


# --- a number by a category ------------------------------------------------------------------------------------------


def _top(df: DataFrame, category: str, k: int) -> list:
    return top_value_list(df, category, k)


def box_by_category(df: DataFrame, value: str, category: str, k: int = TOP_CATEGORIES) -> DataFrame:
    """Box-plot numbers of a numeric column for each of the most frequent categories."""
    kept = _top(df, category, k)
    value_of = double_value(df, value)
    kind = df.schema[category].dataType.simpleString()
    return _boxes(
        df.filter(col(category).isin(kept)), {c: F.when(col(category) == F.lit(c), value_of) for c in kept}, "category", kind
    )


def violin_by_category(
    df: DataFrame, value: str, category: str, k: int = TOP_CATEGORIES, points: int = VIOLIN_POINTS, cut: float = VIOLIN_CUT
) -> DataFrame:
    """(category, point, x, density) for each of the most frequent categories."""
    rows = df.filter(col(category).isin(_top(df, category, k)))
    rows = rows.select(col(category).alias("group"), double_value(df, value).alias("x"))
    return grouped_kde(rows, points, cut).withColumnRenamed("group", "category")


def mean_by_category(df: DataFrame, value: str, category: str, k: int = TOP_CATEGORIES) -> DataFrame:
    rows = df.filter(col(category).isin(_top(df, category, k)))
    return rows.groupBy(col(category).alias("category")).agg(F.avg(double_value(df, value)).alias("mean"))


# --- two categories --------------------------------------------------------------------------------------------------


def grouped_counts(df: DataFrame, x: str, hue: str, k_x: int = TOP_CATEGORIES, k_hue: int = TOP_HUES) -> DataFrame:
    """(x, hue, count) for the most frequent values of both."""
    rows = df.filter(col(x).isin(_top(df, x, k_x)) & col(hue).isin(_top(df, hue, k_hue)))
    return rows.groupBy(col(x).alias("x"), col(hue).alias("hue")).agg(F.count(F.lit(1)).alias("count"))


def crosstab_proportions(df: DataFrame, x: str, hue: str, k_x: int = TOP_CATEGORIES, k_hue: int = TOP_HUES) -> DataFrame:
    """Share of each hue within x, in long form with zeros.

    Shares are taken over all hues before the less frequent ones are left out, so they may sum to less than one.
    """
    kept_x, kept_hue = _top(df, x, k_x), _top(df, hue, k_hue)
    per_x = (
        df.filter(col(x).isin(kept_x) & col(hue).isNotNull())
        .groupBy(col(x).alias("x"))
        .agg(F.count(F.lit(1)).alias("total"), *[F.count_if(col(hue) == F.lit(h)).alias(f"h{i}") for i, h in enumerate(kept_hue)])
    )
    cells = [F.struct(F.lit(h).alias("hue"), (F.col(f"h{i}") / F.col("total")).alias("share")) for i, h in enumerate(kept_hue)]
    return per_x.select("x", F.inline(F.array(*cells)))


# --- two numbers -----------------------------------------------------------------------------------------------------


def scatter_points(df: DataFrame, key, x: str, y: str, n: int = MAX_SAMPLE, seed: int = 42) -> DataFrame:
    """(x, y) of at most n sampled rows."""
    return sample_rows(df, key, n, seed).select(double_value(df, x).alias("x"), double_value(df, y).alias("y"))


def line_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean y per x, in the order of x."""
    return df.groupBy(double_value(df, x).alias("x")).agg(F.avg(double_value(df, y)).alias("y")).orderBy("x")


def joint_stats(df: DataFrame, key, x: str, y: str, n: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Points of a joint chart and the histograms on its margins: of all rows, or of n sampled rows if n is given."""
    rows = df.select(*_unique([*_keys(key), x, y]))
    rows = rows if n is None else sample_rows(rows, key, n, seed)
    points = rows.select(double_value(df, x).alias("x"), double_value(df, y).alias("y"))
    return {"points": points, "x": histogram(rows, x), "y": histogram(rows, y)}


# --- many numbers ----------------------------------------------------------------------------------------------------


def hue_column(df: DataFrame, target: str | None) -> str | None:
    """The target if it can colour a chart: text, or a number with fewer than 15 distinct values."""
    if not target or target not in df.columns:
        return None
    if isinstance(df.schema[target].dataType, T.StringType):
        return target
    if target in numeric_columns(df) and value_counts(df, target).limit(HUE_LEVELS).count() < HUE_LEVELS:
        return target
    return None


def pairplot_data(
    df: DataFrame, key, columns: Sequence[str] | None = None, target: str | None = None, n: int | None = None, seed: int = 42
) -> dict[str, DataFrame]:
    """Lower-triangle point pairs and diagonal densities, split by hue where the target allows it: of all rows, or of n sampled rows if n is given."""
    names = list(columns or numeric_columns(df)[:PAIRPLOT_COLUMNS])
    if len(names) < 2:
        raise ValueError("a pair plot needs two numeric columns")
    needed = _unique([*_keys(key), *names, *([target] if target in df.columns else [])])
    rows = df.select(*needed) if n is None else sample_rows(df.select(*needed), key, n, seed)
    hue = hue_column(rows, target)
    level = col(hue).cast("string") if hue else F.lit(None).cast("string")
    pairs = [
        F.struct(
            F.lit(names[j]).alias("x_name"),
            F.lit(names[i]).alias("y_name"),
            double_value(df, names[j]).alias("x"),
            double_value(df, names[i]).alias("y"),
        )
        for i in range(len(names))
        for j in range(i)
    ]
    diagonal = [F.struct(F.lit(c).alias("name"), level.alias("hue"), double_value(df, c).alias("x")) for c in names]
    values = rows.select(F.inline(F.array(*diagonal)))
    density = grouped_kde(values.select(F.struct("name", "hue").alias("group"), "x"), KDE_POINTS, KDE_CUT)
    return {
        "pairs": rows.select(level.alias("hue"), F.inline(F.array(*pairs))),
        "diagonal": density.select("group.name", "group.hue", "point", "x", "density"),
    }


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) of every pair of numeric columns after median imputation; r is null if a column is constant or empty.

    One scan finds which columns have missing values and the means, a second one all products of distances from the means: each task adds
    up one matrix for its rows, and matrices are added before the shuffle. That is two jobs at any width, and those of the medians if any value is missing.
    """
    names = list(names if names is not None else numeric_columns(df))
    if not names:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    table = nan_to_null(df.select(*[col(n) for n in names]))
    flat, moments = comoments(fit_median(table).transform(table), names)
    spread = np.sqrt(np.maximum(np.diag(moments), 0))
    flat |= spread == 0
    r = moments / np.where(flat, 1.0, spread)[:, None] / np.where(flat, 1.0, spread)
    cells = [(a, b, None if flat[i] or flat[j] else float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(cells, "a string, b string, r double")


def comoments(table: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which columns are constant or empty, and the sums over all rows of the products of two columns' distances from their means.

    A missing value stands for the mean. What rounding left of the means is taken off in the end.
    """
    values, k = [double_value(table, n) for n in names], len(names)
    row = table.agg(*[f(v) for v in values for f in (F.avg, F.min, F.max)]).first()
    means, low, high = row[::3], row[1::3], row[2::3]
    flat = np.array([a == b for a, b in zip(low, high)])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, k))
            n += len(x)
            sums += x.sum(axis=0)
            products += x.T @ x
        if n:
            rows = [pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array(sums), pa.array(products.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(rows, names=["i", "n", "s", "p"])

    centred = table.select(*[F.coalesce(v - F.lit(m or 0.0), F.lit(0.0)).alias(f"x{i}") for i, (v, m) in enumerate(zip(values, means))])
    rows = centred.mapInArrow(added, "i int, n bigint, s double, p array<double>")
    cells = rows.select("i", "n", "s", F.posexplode("p").alias("j", "p")).where("j >= i")
    found = cells.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("p").alias("p")).collect()  # one row for each pair of columns
    products, left, n = np.zeros((k, k)), np.zeros(k), 0
    for i, j, n, s, p in found:
        products[i, j] = products[j, i] = p
        left[i] = s
    return flat, products - np.outer(left, left) / max(n, 1)


def correlation_lower(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The part of the matrix below its diagonal."""
    names = list(names if names is not None else numeric_columns(df))
    position = F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i))])
    return correlation_matrix(df, names).filter(position[F.col("a")] > position[F.col("b")])


def correlation_sorted(df: DataFrame, target: str, names: Sequence[str] | None = None) -> DataFrame:
    """The matrix with the columns in descending order of |correlation with the target|.

    ``row`` and ``column`` are the 1-based places of a and b in that order.
    """
    matrix = correlation_matrix(df, names)
    to_target = matrix.filter(F.col("b") == F.lit(target)).select(F.struct((-F.abs("r")).alias("by"), F.col("a").alias("n")).alias("k"))
    order = to_target.agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["n"]).alias("order"))  # one name per column
    names_in_order = order.first()["order"]
    place = F.create_map(*[v for i, n in enumerate(names_in_order, 1) for v in (F.lit(n), F.lit(i))])
    return matrix.select("a", "b", "r", place[F.col("a")].alias("row"), place[F.col("b")].alias("column")).orderBy("row", "column")
