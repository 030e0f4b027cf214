"""Gradient boosting with histogram trees: one tree per class and round, Newton leaves, a start from the prior.

Values are cut into bins once. A round fits one tree for each class (one in all for two classes and for regression) to the gradients of the loss,
level by level; of the rows a level needs the sums of gradients, hessians and rows per class, node, feature and bin, which one aggregate gives for
all classes. Splits are chosen on the driver from these sums, whose number does not grow with the rows. Scores are written every few
rounds; in between each task adds the newer trees up itself.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulift.functions.schema import col
from tabulift.plans.quantiles import split_points
from tabulift.plans.scratch import dealt, durable

BINS = 256
#: Rounds after which the scores of all rows are written.
WRITTEN = 10
#: Rows that one task reads in a round, about.
TASK_ROWS = 1 << 20
#: Gains that differ by less than this share are equal; the first feature and the smallest threshold win.
TIE = 1e-10
FLAT = 1e-150


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2 i + 1 (at most the threshold) and 2 i + 2. A node without a split sends all to the left."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = (1 << depth) - 1
        return cls(np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.full(inner, np.inf), np.zeros(inner + 1))

    def leaves(self, rows: np.ndarray, cuts: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row reaches, on its level, from columns of bins or values and the matching cuts."""
        node = np.zeros(len(rows), np.int64)
        each = np.arange(len(rows))
        for _ in range(levels if levels is not None else (len(self.feature) + 1).bit_length() - 1):
            node = 2 * node + 1 + (rows[each, self.feature[node]] > cuts[node])
        return node

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins, self.bin) - len(self.feature)]

    def of_values(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x, self.threshold) - len(self.feature)]


def gradients(scores: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients and hessians of the loss, one column per tree of a round: squares (0 classes), logistic (2) or softmax."""
    if not classes:
        return y[:, None] - scores, np.ones_like(scores)
    if classes == 2:
        p = 1.0 / (1.0 + np.exp(-scores))
        return y[:, None] - p, p * (1.0 - p)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return (y[:, None] == np.arange(classes)) - p, p * (1.0 - p)


def best_split(g: np.ndarray, n: np.ndarray) -> tuple[int, int] | None:
    """(feature, bin) of the split with the largest gain, for sums by feature and bin: n_l n_r / (n_l + n_r) times the squared difference of means."""
    gl, nl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    gr, nr = g.sum(axis=1, keepdims=True) - gl, n.sum(axis=1, keepdims=True) - nl
    both = (nl > 0) & (nr > 0)
    if not both.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(both, nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2, -1.0)
    top = gain.max()
    if top <= 1e-14 * max(1.0, float(n[0].sum())):
        return None
    return divmod(int(np.flatnonzero(gain.ravel() >= top * (1 - TIE))[0]), gain.shape[1])


class _Growing:
    """The trees of one round while they grow, and the leaf values that their nodes would have."""

    def __init__(self, trees: int, depth: int, scale: float):
        self.trees, self.depth, self.scale = [Tree.empty(depth) for _ in range(trees)], depth, scale

    def split(self, level: int, sums: np.ndarray, cuts: Sequence[Sequence[float]]) -> None:
        """Split the nodes of a level by their sums (tree, node, feature, bin, (g, h, n)). A leaf's value goes to the leftmost place below it."""
        first = (1 << level) - 1
        for tree, of_tree in zip(self.trees, sums):
            for node, of_node in enumerate(of_tree):
                place = first + node
                found = best_split(of_node[..., 0], of_node[..., 2])
                if level == 0:
                    self._set(tree, place, of_node[0].sum(axis=0))
                if found is None or found[1] >= len(cuts[found[0]]):
                    continue
                feature, at = found
                tree.feature[place], tree.bin[place], tree.threshold[place] = feature, at, cuts[feature][at]
                left = of_node[feature, : at + 1].sum(axis=0)
                self._set(tree, 2 * place + 1, left)
                self._set(tree, 2 * place + 2, of_node[feature].sum(axis=0) - left)

    def _set(self, tree: Tree, place: int, sums: np.ndarray) -> None:
        leaf = place
        while leaf < len(tree.feature):
            leaf = 2 * leaf + 1
        g, h, _ = sums
        tree.value[leaf - len(tree.feature)] = self.scale * g / h if abs(h) > FLAT else 0.0


def _scores(columns: list, pending: list[list[Tree]], bins: np.ndarray, rate: float) -> np.ndarray:
    out = np.column_stack(columns)
    for trees in pending:
        for k, tree in enumerate(trees):
            out[:, k] += rate * tree.of_bins(bins)
    return out


class BoostedTrees(Estimator):
    """Fits ``BoostedTreesModel`` on a vector of features and a label: an index below ``classes``, or a number if there are no classes."""

    def __init__(
        self, featuresCol: str, labelCol: str, predictionCol: str, inputs: int, classes: int = 0, rawPredictionCol: str = "",
        probabilityCol: str = "", maxIter: int = 100, maxDepth: int = 3, stepSize: float = 0.1, maxBins: int = BINS,
    ):
        super().__init__()
        self.columns = {"featuresCol": featuresCol, "predictionCol": predictionCol, "rawPredictionCol": rawPredictionCol, "probabilityCol": probabilityCol}
        self.label, self.inputs, self.classes = labelCol, inputs, max(classes, 2) if classes else 0
        self.rounds, self.depth, self.rate, self.bins = maxIter, maxDepth, stepSize, min(maxBins, BINS)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        values = dataset.select(vector_to_array(col(self.columns["featuresCol"])).alias("x"), col(self.label).cast("double").alias("y"))
        inputs = [F.get("x", F.lit(i)) for i in range(self.inputs)]
        cuts = split_points(values, inputs, self.bins)
        start, scale = self._start(values)
        spread_out = dealt(values, values.count(), TASK_ROWS)  # a small file is one split, which every round would read in one task
        binned = durable(self._binned(spread_out, cuts, start))
        rounds, pending = [], []
        for _ in range(self.rounds):
            growing = _Growing(len(start), self.depth, scale)
            for level in range(self.depth):
                growing.split(level, self._sums(binned, pending, growing.trees, level), cuts)
            rounds.append(growing.trees)
            pending.append(growing.trees)
            if len(pending) == WRITTEN:
                binned, pending = durable(self._rescored(binned, pending)), []
        trees = [[{"f": t.feature.tolist(), "t": [None if math.isinf(x) else x for x in t.threshold], "v": t.value.tolist()} for t in r] for r in rounds]
        return BoostedTreesModel(
            **self.columns, classes=self.classes, trees=json.dumps({"start": start, "rate": self.rate, "depth": self.depth, "rounds": trees})
        )

    def _start(self, values: DataFrame) -> tuple[list[float], float]:
        """The scores before the first round, and what leaves are scaled by."""
        if not self.classes:
            return [values.agg(F.avg("y")).first()[0] or 0.0], 1.0
        counts = {int(r["y"]): r["n"] for r in values.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
        shares = [counts.get(k, 0) / max(1, sum(counts.values())) for k in range(self.classes)]
        logs = [math.log(max(s, 1e-12)) for s in shares]
        if self.classes == 2:
            return [logs[1] - logs[0]], 1.0
        return logs, (self.classes - 1) / self.classes

    def _binned(self, values: DataFrame, cuts: Sequence[Sequence[float]], start: list[float]) -> DataFrame:
        """Columns b0, b1, ... (the number of cuts below each value), y and the scores s0, s1, ..."""
        edges = [np.array(c, float) for c in cuts]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                bins = [np.searchsorted(e, x[:, i], "left").astype(np.int16) for i, e in enumerate(edges)]
                scores = [np.full(len(x), s) for s in start]
                yield pa.RecordBatch.from_arrays([*map(pa.array, bins), batch.column(1), *map(pa.array, scores)], names=names)

        names = [f"b{i}" for i in range(self.inputs)] + ["y"] + [f"s{k}" for k in range(len(start))]
        kinds = ["smallint"] * self.inputs + ["double"] * (1 + len(start))
        return values.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))

    def _of_batch(self, batch: pa.RecordBatch, pending: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        bins = np.column_stack(columns[: self.inputs])
        return bins, columns[self.inputs], _scores(columns[self.inputs + 1 :], pending, bins, self.rate)

    def _sums(self, binned: DataFrame, pending: list, trees: list[Tree], level: int) -> np.ndarray:
        """Sums of gradients, hessians and rows (tree, node of the level, feature, bin, 3)."""
        nodes, first, inputs, classes, bins_ = 1 << level, (1 << level) - 1, self.inputs, self.classes, BINS
        of_batch, size = self._of_batch, inputs * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(trees) * nodes * size))
            for batch in batches:
                bins, y, scores = of_batch(batch, pending)
                g, h = gradients(scores, y, classes)
                for k, tree in enumerate(trees):
                    node = tree.leaves(bins, tree.bin, level) - first
                    for f in range(inputs):
                        cell = ((k * nodes + node) * inputs + f) * bins_ + bins[:, f]
                        low = k * nodes * size
                        cell -= low
                        part = total[:, low : low + nodes * size]
                        for i, w in enumerate((g[:, k], h[:, k], None)):
                            part[i] += np.bincount(cell, weights=w, minlength=nodes * size)
            filled = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(filled), *(pa.array(t[filled]) for t in total)], names=["cell", "g", "h", "n"])

        cells = binned.mapInArrow(run, "cell bigint, g double, h double, n double")
        rows = cells.groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()  # at most trees x nodes x features x bins
        out = np.zeros((len(trees) * nodes * size, 3))
        if rows:
            found = np.array([tuple(r) for r in rows])
            out[found[:, 0].astype(np.int64)] = found[:, 1:]
        return out.reshape(len(trees), nodes, inputs, BINS, 3)

    def _rescored(self, binned: DataFrame, pending: list) -> DataFrame:
        of_batch, inputs, names = self._of_batch, self.inputs, binned.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = of_batch(batch, pending)[2]
                yield pa.RecordBatch.from_arrays([*batch.columns[: inputs + 1], *(pa.array(s) for s in scores.T)], names=names)

        return binned.mapInArrow(run, binned.schema)


class BoostedTreesModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the prediction and, for classes, vectors of raw scores and probabilities, to a table with a vector of features."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)
    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "scores by class", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probabilities by class", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "start, rate, depth and the trees of every round", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="", predictionCol="", rawPredictionCol="", probabilityCol="", classes=0, trees="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        about = json.loads(get("trees"))
        start, rate = np.array(about["start"]), about["rate"]
        rounds, two = [[_read(t) for t in trees] for trees in about["rounds"]], get("classes") == 2

        @F.pandas_udf("array<double>")
        def scored(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            out = np.tile(start, (len(x), 1))
            for trees in rounds:
                for k, tree in enumerate(trees):
                    out[:, k] += rate * tree.of_values(x)
            return pd.Series(list(np.column_stack([-out, out]) if two else out))

        raw = scored(vector_to_array(col(get("featuresCol"))))
        if not get("classes"):
            return dataset.withColumn(get("predictionCol"), F.get(raw, F.lit(0)))
        name = get("rawPredictionCol")
        made = dataset.withColumn(name, raw)
        top = F.array_max(col(name))
        factor = 0.5 if two else 1.0  # the two scores are the log odds and what is against them
        shares = F.transform(col(name), lambda f: F.exp(factor * (f - top)))
        total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
        probable = made.withColumn(get("probabilityCol"), array_to_vector(F.transform(shares, lambda s: s / total)))
        chosen = (F.array_position(col(name), top) - 1).cast("double")
        return probable.withColumn(get("predictionCol"), chosen).withColumn(name, array_to_vector(col(name)))


def _read(tree: dict) -> Tree:
    threshold = np.array([np.inf if t is None else t for t in tree["t"]])
    return Tree(np.array(tree["f"], np.int64), np.zeros(len(threshold), np.int64), threshold, np.array(tree["v"]))
