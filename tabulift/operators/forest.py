"""Regression forests of unbounded depth: large nodes are split on sums by bin, small ones are finished whole, one task a node.

Values are cut into bins once. While a node holds more than ``LOCAL_ROWS`` rows, a level is one aggregate of sums by node, feature and bin.
The rows of smaller nodes are brought together, and all levels below are grown there. What is grown there stays a table, one row a node, so
the driver holds the upper splits only, and predictions join the rows with that table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulift.functions.schema import col, free_name
from tabulift.operators.boosting import TIE, best_split
from tabulift.plans.quantiles import split_points
from tabulift.plans.scratch import dealt, durable, scratch_path

BINS = 256
#: Rows, counted by weight, of a node that one task finishes.
LOCAL_ROWS = 1 << 18
#: Rows of one block, whose columns go through Python as a whole.
BLOCK_ROWS = 1 << 14
#: Rows that one task reads, about.
TASK_ROWS = 1 << 18
#: Sums that one pass over the rows gathers; more nodes take more passes.
PASS_CELLS = 1 << 21
#: Tasks that finish nodes, at most.
MOST_TASKS = 4096
#: A gain below this share of a node's weight times its squared range is none.
FLAT_GAIN = 1e-13

_BLOCKS = "block bigint, bins binary, y binary"
_PARTS = "tree int, root int, bins binary, w binary, y binary"
_GROWN = "tree int, root int, feature binary, bin binary, left_child binary, value binary"


class Upper:
    """The splits of one tree that the driver knows. A node is open, a leaf (feature -1, no root) or the root of a part that a task grows."""

    def __init__(self, feature=(-1,), bin=(0,), left=(0,), value=(0.0,), root=(0,)):
        self.feature, self.bin, self.left, self.value, self.root = (list(x) for x in (feature, bin, left, value, root))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(map(np.array, (self.feature, self.bin, self.left, self.value, self.root)))

    def split(self, node: int, feature: int, bin: int, values: tuple[float, float]) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.root[node] = feature, bin, left, 0
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(v)
            self.root.append(0)
        return left, left + 1


def descend(bins: np.ndarray, feature: np.ndarray, bin: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The lowest node that each row (column of ``bins``) reaches."""
    node = np.zeros(bins.shape[1], np.int64)
    moving = np.arange(len(node)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(moving):
        at = node[moving]
        node[moving] = at = left[at] + (bins[feature[at], moving] > bin[at])
        moving = moving[feature[at] >= 0]
    return node


def weights(seed: int, tree: int, block: int, rows: int, bootstrap: bool) -> np.ndarray:
    """How often each row of a block stands in the sample of a tree: Poisson numbers that depend on the block's number only."""
    if not bootstrap:
        return np.ones(rows, np.uint8)
    return np.minimum(np.random.default_rng([seed, tree, block]).poisson(1.0, rows), 255).astype(np.uint8)


def grow(bins: np.ndarray, w: np.ndarray, y: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(feature, bin, left child, value) of the nodes of a tree over rows (columns of ``bins``), level by level, at most ``depth`` splits deep.

    All nodes of a level are split together: rows sorted by node and bin give the sums left of every place between two bins.
    """
    w = w.astype(np.float64)
    middle = float(y.mean())
    wy = w * (y - middle)
    feature, bin_, left, value = [], [], [], []
    node, rows, first, nodes = np.zeros(len(y), np.int64), np.arange(len(y)), 0, 1
    while nodes:
        order = np.argsort(node, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0])
        ordered = rows[order]
        low, high = np.minimum.reduceat(y[ordered], starts), np.maximum.reduceat(y[ordered], starts)
        sw, swy = np.add.reduceat(w[ordered], starts), np.add.reduceat(wy[ordered], starts)
        mean = np.where(low == high, low, middle + swy / sw)
        best, chosen, at = np.zeros(nodes), np.full(nodes, -1, np.int8), np.zeros(nodes, np.uint8)
        if depth > 0:
            least = FLAT_GAIN * sw * (high - low) ** 2
            for f in range(len(bins)):
                _offer(f, node * BINS + bins[f, rows], w[rows], wy[rows], sw, swy, least, best, chosen, at)
        split = chosen >= 0
        place = np.cumsum(split) - 1
        feature.append(chosen)
        bin_.append(at)
        left.append(np.where(split, first + nodes + 2 * place, 0).astype(np.int32))
        value.append(mean)
        goes = split[node]
        rows, node = rows[goes], node[goes]
        node = 2 * place[node] + (bins[chosen[node], rows] > at[node])
        first, nodes, depth = first + nodes, 2 * int(split.sum()), depth - 1
    return tuple(map(np.concatenate, (feature, bin_, left, value)))


def _offer(f, cell, w, wy, sw, swy, least, best, chosen, at) -> None:
    """Take the best split of every node on one feature where it beats the features before; of equal ones the smallest bin."""
    order = np.argsort(cell)
    cell = cell[order]
    ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
    begins = np.r_[0, ends[:-1] + 1]
    cw, cwy, cell = np.add.reduceat(w[order], begins), np.add.reduceat(wy[order], begins), cell[ends]
    of = cell // BINS
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    tw, twy = np.cumsum(cw), np.cumsum(cwy)
    lw, lwy = tw - (tw - cw)[first][of], twy - (twy - cwy)[first][of]
    inner = np.flatnonzero(np.r_[of[1:] == of[:-1], False])
    if not len(inner):
        return
    of, bin_, lw, lwy = of[inner], cell[inner] % BINS, lw[inner], lwy[inner]
    rw, rwy = sw[of] - lw, swy[of] - lwy
    gain = lw * rw / sw[of] * (lwy / lw - rwy / rw) ** 2
    tops = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    top = np.maximum.reduceat(gain, tops)
    named = of[tops]
    good = np.flatnonzero(gain >= np.repeat(top * (1 - TIE), np.diff(np.r_[tops, len(of)])))
    good = good[np.r_[True, of[good][1:] != of[good][:-1]]]
    better = (top > best[named] * (1 + TIE)) & (top > least[named])
    best[named[better]], chosen[named[better]], at[named[better]] = top[better], f, bin_[good][better]


def _arrays(blob, kind: str, rows: int = -1) -> np.ndarray:
    found = np.frombuffer(blob, kind)
    return found if rows < 0 else found.reshape(rows, -1)


def _binned(cuts: Sequence[Sequence[float]]):
    edges = [np.array(c, float) for c in cuts]

    def run(x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left").astype(np.uint8) for i, e in enumerate(edges)])

    return run


class RegressionForest(Estimator):
    """Fits ``RegressionForestModel`` on a vector of features and a number; every split looks at all features."""

    def __init__(
        self, featuresCol: str, labelCol: str, predictionCol: str, inputs: int, numTrees: int = 100, maxDepth: int = 30,
        bootstrap: bool = True, maxBins: int = BINS, seed: int = 42,
    ):
        super().__init__()
        self.columns, self.label, self.inputs = {"featuresCol": featuresCol, "predictionCol": predictionCol}, labelCol, inputs
        self.trees, self.depth, self.bootstrap, self.bins, self.seed = numTrees, maxDepth, bootstrap, min(maxBins, BINS), seed

    def _fit(self, dataset: DataFrame) -> RegressionForestModel:
        label = col(self.label).cast("double")
        missing = F.raise_error(F.lit("Labels MUST NOT be Null or NaN"))
        y = F.when(label.isNull() | F.isnan(label), missing.cast("double")).otherwise(label)
        values = dataset.select(vector_to_array(col(self.columns["featuresCol"])).alias("x"), y.alias("y"))
        cuts = split_points(values, [F.get("x", F.lit(i)) for i in range(self.inputs)], self.bins)
        blocks = durable(self._blocks(values, cuts))
        uppers = [Upper() for _ in range(self.trees)]
        roots = self._upper_levels(blocks, uppers)
        path = scratch_path(dataset.sparkSession, "forest")
        self._grown(blocks, uppers, roots).write.parquet(path)
        about = {"cuts": cuts, "trees": [[x.tolist() for x in u.arrays()] for u in uppers]}
        return RegressionForestModel(**self.columns, forest=json.dumps(about), grown=path)

    def _blocks(self, values: DataFrame, cuts: Sequence[Sequence[float]]) -> DataFrame:
        """Blocks of rows with their numbers; a block's columns of bins and its labels are one value each."""
        binned = _binned(cuts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            held, size = [], 0

            def block() -> pa.RecordBatch:
                bins, y = (np.concatenate(x, axis=-1) for x in zip(*held))
                return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bins.tobytes()]), pa.array([y.tobytes()])], names=["block", "bins", "y"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                held.append((binned(x), batch.column(1).to_numpy(zero_copy_only=False)))
                size += batch.num_rows
                if size >= BLOCK_ROWS:
                    yield block()
                    number, held, size = number + 1, [], 0
            if held:
                yield block()

        return dealt(values, values.count(), TASK_ROWS).mapInArrow(run, _BLOCKS)

    def _upper_levels(self, blocks: DataFrame, uppers: list[Upper]) -> int:
        """Split all nodes that are too large for one task. Returns the number of roots, which get numbers from 1 in their trees."""
        seed, bootstrap = self.seed, self.bootstrap
        count = len(uppers)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((count, 2))
            for batch in batches:
                for block, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    y = _arrays(y, "f8")
                    for t in range(count):
                        w = weights(seed, t, block, len(y), bootstrap)
                        total[t] += w.sum(), (w * y).sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(count)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["tree", "w", "wy"])

        sizes = blocks.select("block", "y").mapInArrow(weigh, "tree bigint, w double, wy double").groupBy("tree").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
        open_, roots = [], 0
        whole, rows = 0.0, 0.0
        for r in sizes.collect():  # one row a tree
            uppers[r["tree"]].value[0] = r["wy"] / r["w"] if r["w"] else 0.0
            whole, rows = whole + r["wy"], rows + r["w"]
            if r["w"]:
                open_.append((r["tree"], 0, r["w"]))
        middle = whole / rows if rows else 0.0
        for level in range(self.depth + 1):
            large = []
            for t, node, w in open_:
                if w > LOCAL_ROWS and level < self.depth:
                    large.append((t, node))
                elif level < self.depth:
                    uppers[t].root[node] = 1 + max(uppers[t].root)
                    roots += 1
            open_, at_once = [], max(1, PASS_CELLS // (self.inputs * BINS))
            for i in range(0, len(large), at_once):
                some = large[i : i + at_once]
                for (t, node), sums in zip(some, self._sums(blocks, uppers, some, middle)):
                    open_ += self._split(uppers[t], t, node, sums, middle)
        return roots

    def _split(self, upper: Upper, tree: int, node: int, sums: np.ndarray, middle: float) -> list[tuple[int, int, float]]:
        """Split a node by its sums (feature, bin, (w, wy)), if that gains; the new nodes with their weights."""
        found = best_split(sums[..., 1], sums[..., 0])
        if found is None:
            return []
        f, at = found
        left = sums[f, : at + 1].sum(axis=0)
        right = sums[f].sum(axis=0) - left
        made = upper.split(node, f, at, (middle + left[1] / left[0], middle + right[1] / right[0]))
        return [(tree, made[0], left[0]), (tree, made[1], right[0])]

    def _sums(self, blocks: DataFrame, uppers: list[Upper], nodes: list[tuple[int, int]], middle: float) -> np.ndarray:
        """Weights and weighted labels less ``middle`` by (node, feature, bin)."""
        seed, bootstrap, inputs = self.seed, self.bootstrap, self.inputs
        of_tree: dict[int, dict[int, int]] = {}
        for i, (t, node) in enumerate(nodes):
            of_tree.setdefault(t, {})[node] = i
        trees = {}
        for t, places in of_tree.items():
            feature, bin_, left, *_ = uppers[t].arrays()
            place = np.full(len(feature), -1, np.int64)
            place[list(places)] = list(places.values())
            trees[t] = feature, bin_, left, place
        cells = len(nodes) * inputs * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, cells))
            for batch in batches:
                for block, bins, y in zip(*(c.to_pylist() for c in batch.columns)):
                    bins, y = _arrays(bins, "u1", inputs), _arrays(y, "f8") - middle
                    for t, (feature, bin_, left, place) in trees.items():
                        w = weights(seed, t, block, len(y), bootstrap)
                        used = np.flatnonzero(w)
                        node = place[descend(bins[:, used], feature, bin_, left)]
                        used, node = used[node >= 0], node[node >= 0]
                        if not len(used):
                            continue
                        low = int(node.min())
                        size = (int(node.max()) - low + 1) * inputs * BINS
                        wf = w[used].astype(float)
                        wy = wf * y[used]
                        for f in range(inputs):
                            cell = ((node - low) * inputs + f) * BINS + bins[f, used]
                            for row, v in zip(total, (wf, wy)):
                                row[low * inputs * BINS : low * inputs * BINS + size] += np.bincount(cell, weights=v, minlength=size)
            filled = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(filled), *(pa.array(t[filled]) for t in total)], names=["cell", "w", "wy"])

        # At most PASS_CELLS rows.
        found = blocks.mapInArrow(run, "cell bigint, w double, wy double").groupBy("cell").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).toArrow()
        out = np.zeros((cells, 2))
        out[found["cell"].to_numpy()] = np.column_stack([found["w"].to_numpy(), found["wy"].to_numpy()])
        return out.reshape(len(nodes), inputs, BINS, 2)

    def _grown(self, blocks: DataFrame, uppers: list[Upper], roots: int) -> DataFrame:
        """The nodes below every root, as one row; its rows are brought to one task, at most ``LOCAL_ROWS`` by weight."""
        seed, bootstrap, inputs, depth = self.seed, self.bootstrap, self.inputs, self.depth
        trees = [u.arrays() for u in uppers]
        left_over = [depth - _depths(u.feature, u.left) for u in uppers]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, bins, y in zip(*(c.to_pylist() for c in batch.columns)):
                    bins, y, made = _arrays(bins, "u1", inputs), _arrays(y, "f8"), []
                    for t, (feature, bin_, left, _, root) in enumerate(trees):
                        w = weights(seed, t, block, len(y), bootstrap)
                        used = np.flatnonzero(w)
                        at = root[descend(bins[:, used], feature, bin_, left)]
                        order = np.argsort(at, kind="stable")
                        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                            if len(part) and (r := int(at[part[0]])):
                                rows = used[part]
                                made.append((t, r, bins[:, rows].tobytes(), w[rows].tobytes(), y[rows].tobytes()))
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

        kinds, names = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["tree", "root", "bins", "w", "y"]

        def finish(table: pa.Table) -> pa.Table:
            t, r = table["tree"][0].as_py(), table["root"][0].as_py()
            bins = np.concatenate([_arrays(b, "u1", inputs) for b in table["bins"].to_pylist()], axis=1)
            w, y = (np.concatenate([_arrays(b, k) for b in table[c].to_pylist()]) for c, k in (("w", "u1"), ("y", "f8")))
            node = int(np.flatnonzero(trees[t][4] == r)[0])
            tree = grow(bins, w, y, int(left_over[t][node]))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in tree]
            return pa.Table.from_arrays([pa.array([t], pa.int32()), pa.array([r], pa.int32()), *blobs], names=["tree", "root", "feature", "bin", "left_child", "value"])

        parts = blocks.mapInArrow(deal, _PARTS).repartition(max(1, min(MOST_TASKS, 2 * roots)), "tree", "root")
        return parts.groupBy("tree", "root").applyInArrow(finish, _GROWN)


def _depths(feature: Sequence[int], left: Sequence[int]) -> np.ndarray:
    """How many splits lie above each node; children stand behind their parents."""
    out = np.zeros(len(feature), np.int64)
    for i, f in enumerate(feature):
        if f >= 0:
            out[left[i]] = out[left[i] + 1] = out[i] + 1
    return out


class _Writer(MLWriter):
    def __init__(self, model: RegressionForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        spark.read.schema(_GROWN).parquet(self.model.getOrDefault("grown")).write.parquet(f"{path}/grown")


class _Reader(MLReader):
    def load(self, path: str) -> RegressionForestModel:
        about = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        model = RegressionForestModel()
        model._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(model, about)
        return model._set(grown=f"{path}/grown")


class RegressionForestModel(Transformer, MLReadable, MLWritable):
    """Adds the mean of the trees' values. Rows with equal bins are one question; the questions of a part of a tree meet that part in one task."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)
    forest = Param(Params._dummy(), "forest", "cuts of the features and the upper nodes of every tree", TypeConverters.toString)
    grown = Param(Params._dummy(), "grown", "folder of the lower nodes", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="", predictionCol="", forest="{}", grown=""):
        super().__init__()
        self._set(**self._input_kwargs)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        about = json.loads(get("forest"))
        inputs, binned = len(about["cuts"]), _binned(about["cuts"])
        trees = [tuple(map(np.array, t)) for t in about["trees"]]
        spark = dataset.sparkSession

        @F.pandas_udf("binary")
        def coded(rows: pd.Series) -> pd.Series:
            return pd.Series([c.tobytes() for c in binned(np.stack(rows.to_numpy())).T] if len(rows) else [], dtype=object)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = _arrays(b"".join(batch.column(0).to_pylist()), "u1").reshape(-1, inputs).T
                made = []
                for t, (feature, bin_, left, value, root) in enumerate(trees):
                    node = descend(bins, feature, bin_, left)
                    order = np.argsort(node, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                        at = node[rows[0]]
                        made.append((t, int(root[at]), np.ascontiguousarray(bins[:, rows].T).tobytes(), float(value[at])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["tree", "root", "bins", "value"])

        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64()]

        def answers(bins: np.ndarray, value: np.ndarray) -> pa.Table:
            blob = pa.Array.from_buffers(pa.binary(inputs), len(value), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            return pa.Table.from_arrays([blob, pa.array(value)], names=["bins", "value"])

        def below(asked: pa.Table, grown: pa.Table) -> pa.Table:
            bins = _arrays(b"".join(asked["bins"].to_pylist()), "u1").reshape(-1, inputs)
            if not len(bins) or not grown.num_rows:
                return answers(bins[:0], np.empty(0))
            feature, bin_, left, value = (_arrays(grown[c][0].as_py(), k) for c, k in (("feature", "i1"), ("bin", "u1"), ("left_child", "i4"), ("value", "f8")))
            return answers(bins, value[descend(bins.T, feature, bin_, left)])

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bins, value in zip(*(c.to_pylist() for c in batch.columns)):
                    bins = _arrays(bins, "u1").reshape(-1, inputs)
                    yield from answers(bins, np.full(len(bins), value)).to_batches()

        code = free_name(dataset.columns, "bins")
        made = dataset.withColumn(code, coded(vector_to_array(col(get("featuresCol")))))
        asked = made.select(col(code).alias("bins")).distinct().mapInArrow(ask, "tree int, root int, bins binary, value double")
        schema, at, answered = "bins binary, value double", ["tree", "root"], []
        if any((t[4] > 0).any() for t in trees):
            tasks = max(1, min(MOST_TASKS, 2 * sum(int((t[4] > 0).sum()) for t in trees)))
            grown = spark.read.schema(_GROWN).parquet(get("grown"))
            lower, parts = (d.repartition(tasks, *at) for d in (asked.where("root > 0").select(*at, "bins"), grown))
            answered.append(lower.groupBy(*at).cogroup(parts.groupBy(*at)).applyInArrow(below, schema))
        if any(((t[0] < 0) & (t[4] == 0)).any() for t in trees):
            answered.append(asked.where("root = 0").select("bins", "value").mapInArrow(alone, schema))
        values = answered[0] if len(answered) == 1 else answered[0].unionByName(answered[1])
        mean = values.groupBy("bins").agg((F.sum("value") / F.lit(float(len(trees)))).alias("value"))
        of, name = (free_name([*dataset.columns, code, get("predictionCol")], c) for c in ("bins_of", "mean_of"))
        joined = made.join(mean.toDF(of, name), col(code) == col(of), "left")
        return joined.select(*[col(c) for c in dataset.columns], col(name).alias(get("predictionCol")))
