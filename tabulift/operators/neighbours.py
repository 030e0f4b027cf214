"""Exact nearest neighbours by a partitioned join.

The space is cut into boxes that hold about equally many train points. Every test row first looks in its own box, which
bounds the distance of its k-th neighbour; then it visits only the boxes that reach into that distance. This is the
two-round scheme of partition-based kNN joins. Equal train points are reduced to k rows beforehand (more can never be
among the k nearest), so no box is filled by copies of one point. A box with many test rows is handled in parts and one
with many train rows in chunks, every part with every chunk, so no task holds more than BOX_ROWS of either.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulift.functions.schema import col, double_value
from tabulift.plans.scratch import durable

BOX_ROWS = 20_000
FEWEST_ROWS = 128  # test rows of a part, about, when there are more cores than full parts
MAX_BOXES = 1 << 14  # of the tree, which every task holds; beyond it boxes get larger and are read in chunks
SAMPLE_PER_BOX = 64
CHUNK_CELLS = 4_000_000
NEIGHBOURS = 5


@dataclass(frozen=True)
class Boxes:
    """A balanced tree of axis-parallel cuts; the cells at its bottom are the boxes."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def depth(self) -> int:
        return int(math.log2(len(self.low)))

    def find(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] >= self.cut[node])
        return node - (len(self.low) - 1)

    def distance(self, points: np.ndarray, metric: str) -> np.ndarray:
        """Smallest distance (squared if Euclidean) from each point (row) to any place in each box (column)."""
        axes = range(points.shape[1])
        gaps = (np.maximum(np.maximum(self.low[:, j] - points[:, j : j + 1], points[:, j : j + 1] - self.high[:, j]), 0.0) for j in axes)
        return _combine(gaps, metric)


EUCLIDEAN, CHEBYSHEV = "euclidean", "chebyshev"


def _combine(gaps, metric: str) -> np.ndarray:
    """Distance from the gaps along each axis, in the order of the axes: squared sum or largest gap."""
    total = None
    for gap in gaps:
        part = gap * gap if metric == EUCLIDEAN else np.abs(gap)
        total = part if total is None else (total + part if metric == EUCLIDEAN else np.maximum(total, part))
    return total


def cut_boxes(sample: np.ndarray, boxes: int, dimensions: int) -> Boxes:
    """Cut at medians of the sample along the widest axis."""
    depth = int(math.log2(boxes))
    axis, cut = np.zeros(boxes - 1, dtype=np.int64), np.zeros(boxes - 1)
    low = np.full((2 * boxes - 1, dimensions), -np.inf)
    high = np.full((2 * boxes - 1, dimensions), np.inf)
    members = {0: sample}
    for node in range(2**depth - 1):
        points = members.pop(node)
        axis[node] = np.argmax(np.ptp(points, axis=0)) if len(points) else 0
        values = points[:, axis[node]]
        cut[node] = np.median(values) if len(points) else 0.0
        left, right = 2 * node + 1, 2 * node + 2
        for child in (left, right):
            low[child], high[child] = low[node], high[node]
        high[left, axis[node]] = min(high[node, axis[node]], cut[node])
        low[right, axis[node]] = max(low[node, axis[node]], cut[node])
        members[left], members[right] = points[values < cut[node]], points[values >= cut[node]]
    return Boxes(axis, cut, low[boxes - 1 :], high[boxes - 1 :])


def _nearest_in_box(k: int, metric: str):
    """Function for cogrouped boxes: up to k nearest train rows of every test row, by (distance, train key)."""

    def run(_, tests: pd.DataFrame, trains: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"test_key": [], "train_key": [], "distance": [], "y": []})
        if tests.empty or trains.empty:
            return empty
        trains = trains.sort_values("train_key", kind="stable")
        b = np.stack(trains["point"].to_numpy())
        keys, ys = trains["train_key"].to_numpy(), trains["y"].to_numpy()
        test_keys = tests["test_key"].to_numpy()
        a = np.stack(tests["point"].to_numpy())
        step = max(1, CHUNK_CELLS // len(b))
        parts = []
        for start in range(0, len(a), step):
            chunk = a[start : start + step]
            apart = _combine((chunk[:, j : j + 1] - b[None, :, j] for j in range(a.shape[1])), metric)
            if len(b) > k:
                # All rows up to the k-th distance are candidates, so that ties are settled by key.
                limit = np.partition(apart, k - 1, axis=1)[:, k - 1]
            else:
                limit = np.full(len(chunk), np.inf)
            row, at = np.nonzero(apart <= limit[:, None])
            distance = apart[row, at]
            order = np.lexsort((at, distance, row))
            row, at, distance = row[order], at[order], distance[order]
            first = np.searchsorted(row, np.arange(len(chunk)))
            keep = np.arange(len(row)) - first[row] < k
            parts.append(
                pd.DataFrame(
                    {
                        "test_key": test_keys[start : start + step][row[keep]],
                        "train_key": keys[at[keep]],
                        "distance": distance[keep],
                        "y": ys[at[keep]],
                    }
                )
            )
        return pd.concat(parts, ignore_index=True) if parts else empty

    return run


def _points(df: DataFrame, features: Sequence[str], key: str, name: str, *more) -> DataFrame:
    return df.select(col(key).alias(name), F.array(*[double_value(df, f) for f in features]).alias("point"), *more)


def _visit(tests: DataFrame, trains: DataFrame, k: int, metric: str, schema: str, spread: int) -> DataFrame:
    """Join test and train rows box by box, every part of a box's test rows with every chunk of its train rows.

    A box has at least ``spread`` parts, where that leaves FEWEST_ROWS in each, so that few boxes keep all cores busy.
    """
    least = F.least(F.lit(spread), F.ceil(F.col("tests") / F.lit(FEWEST_ROWS)))
    parts = F.greatest(F.ceil(F.col("tests") / F.lit(BOX_ROWS)), least, F.lit(1)).cast("int").alias("parts")
    shares = [parts, F.greatest(F.ceil(F.col("trains") / F.lit(BOX_ROWS)), F.lit(1)).cast("int").alias("chunks")]
    counts = tests.groupBy("box").agg(F.count(F.lit(1)).alias("tests")).join(trains.groupBy("box").agg(F.count(F.lit(1)).alias("trains")), "box")
    layout = F.broadcast(counts.select("box", *shares))  # one row per box, so at most MAX_BOXES rows
    tests = tests.join(layout, "box").withColumn("part", F.pmod(F.xxhash64("test_key"), "parts").cast("int"))
    tests = tests.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("parts", "chunks")
    trains = trains.join(layout, "box").withColumn("chunk", F.pmod(F.xxhash64("train_key"), "chunks").cast("int"))
    trains = trains.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "chunks")
    at = ("box", "part", "chunk")
    return tests.groupBy(*at).cogroup(trains.groupBy(*at)).applyInPandas(_nearest_in_box(k, metric), schema)


def _box_count(rows: int) -> int:
    """A power of two: boxes of at most BOX_ROWS."""
    return min(MAX_BOXES, 1 << math.ceil(math.log2(max(rows / BOX_ROWS, 1))))


def nearest(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    train_key: str,
    test_key: str,
    target: str,
    k: int = NEIGHBOURS,
    metric: str = EUCLIDEAN,
) -> DataFrame:
    """(test_key, place, train_key, distance, y): the k nearest train rows of every test row, smaller key first on ties.

    Both keys must be unique. ``y`` is the target value of the train row.
    """
    features = list(features)
    kinds = {f.name: f.dataType.simpleString() for f in (train.schema[train_key], train.schema[target], test.schema[test_key])}
    schema = f"test_key {kinds[test_key]}, train_key {kinds[train_key]}, distance double, y {kinds[target]}"

    trains = _points(train, features, train_key, "train_key", col(target).alias("y"))
    same = Window.partitionBy("point").orderBy("train_key")
    trains = trains.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k).drop("copy")
    rows = trains.count()
    boxes = _box_count(rows)
    spread = -(-train.sparkSession.sparkContext.defaultParallelism // boxes)
    share = min(1.0, 2.0 * boxes * SAMPLE_PER_BOX / max(1, rows))
    # The sample only places the cuts between boxes; no neighbour is chosen from it.
    places = trains.select("point").sample(share, seed=42).collect() if boxes > 1 else []
    tree = cut_boxes(np.array([r["point"] for r in places]).reshape(len(places), len(features)), boxes, len(features))

    @F.pandas_udf("int")
    def own_box(points: pd.Series) -> pd.Series:
        return pd.Series(tree.find(np.stack(points.to_numpy())).astype("int32"))

    @F.pandas_udf("array<int>")
    def other_boxes(points: pd.Series, own: pd.Series, radius: pd.Series) -> pd.Series:
        at, reach = np.stack(points.to_numpy()), np.where(radius.isna(), np.inf, radius)
        step, found = max(1, CHUNK_CELLS // boxes), []
        for i in range(0, len(at), step):
            near = tree.distance(at[i : i + step], metric) <= reach[i : i + step, None]
            near[np.arange(len(near)), own[i : i + step]] = False
            row, box = np.nonzero(near)
            found += np.split(box.astype("int32"), np.searchsorted(row, np.arange(1, len(near))))
        return pd.Series(found)

    mine = own_box("point") if boxes > 1 else F.lit(0)
    trains = trains.withColumn("box", mine)
    tests = _points(test, features, test_key, "test_key").withColumn("box", mine)
    if boxes > 1:  # both rounds read these
        trains, tests = durable(trains), durable(tests)
    first = _visit(tests, trains, k, metric, schema, spread)
    if boxes > 1:
        first = durable(first)
        reach = first.groupBy("test_key").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        reach = reach.select(F.col("test_key").alias("_key"), F.when(F.col("n") >= k, F.col("far")).alias("radius"))
        further = tests.join(reach, F.col("test_key") == F.col("_key"), "left").select(
            "test_key", "point", F.explode(other_boxes("point", "box", F.col("radius").cast("double"))).alias("box")
        )
        first = first.unionByName(_visit(further, trains, k, metric, schema, spread))
    place = F.row_number().over(Window.partitionBy("test_key").orderBy("distance", "train_key"))
    best = first.withColumn("place", place).filter(F.col("place") <= k)
    distance = F.sqrt("distance") if metric == EUCLIDEAN else F.col("distance")
    return best.select("test_key", "place", "train_key", distance.alias("distance"), "y")


def knn_regressor(train, test, features, train_key, test_key, target, k: int = NEIGHBOURS) -> DataFrame:
    """(key, prediction): mean target of the k nearest train rows."""
    found = nearest(train, test, features, train_key, test_key, target, k)
    return found.groupBy(F.col("test_key").alias("key")).agg(F.avg("y").alias("prediction"))


def knn_classifier(train, test, features, train_key, test_key, target, k: int = NEIGHBOURS) -> DataFrame:
    """(key, prediction, votes): most frequent class among the k nearest train rows, the smallest class on ties.

    ``votes`` maps each class found to its share, the estimate of its probability.
    """
    found = nearest(train, test, features, train_key, test_key, target, k)
    votes = found.groupBy("test_key", "y").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("test_key").alias("key")).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("y")))["y"].alias("prediction"),
        F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("string"), F.col("n") / F.lit(float(k))))).alias("votes"),
    )
