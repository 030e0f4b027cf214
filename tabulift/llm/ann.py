"""Approximate nearest neighbours: multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabulift.llm.common import as_schema, quoted

#: Vectors that the codes are learned from, at most; everything else covers all rows.
FIT_ROWS = 4_000
#: Bits of a code and of each of its indexed substrings.
CODE_BITS = 256
SUB_BITS = 16
#: Share of true sampled neighbours whose codes lie within the learned radius.
COVERED = 0.985
ROTATION_ROUNDS = 20
#: Vectors in one shard of the index, about.
SHARD_ROWS = 20_000
#: Queries whose results go out together.
QUERY_BLOCK = 256
FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Codes:
    """Centre and rotations that turn a vector into a code, and the radius that covers near neighbours."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        bits = (vectors - self.centre) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def learn(vectors: np.ndarray, neighbours: int, seed: int = 7) -> Codes:
    """Principal axes of the sample, each block of bits rotated so that rotated vectors lie near their signs (iterative quantisation)."""
    random = np.random.default_rng(seed)
    centre = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
    shifted = vectors - centre
    _, axes = np.linalg.eigh(shifted.T @ shifted)
    projected = shifted @ axes
    dimension = vectors.shape[1]
    blocks = []
    for _ in range(-(-CODE_BITS // dimension)):
        turn, _ = np.linalg.qr(random.standard_normal((dimension, dimension)))
        for _ in range(ROTATION_ROUNDS if len(vectors) else 0):
            u, _, w = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (u @ w).T
        blocks.append(axes @ turn)
    codes = Codes(centre, np.hstack(blocks)[:, :CODE_BITS], CODE_BITS)
    packed = codes.of(vectors)
    apart = []
    for i in range(0, len(vectors), max(1, len(vectors) // 400)):
        far = ((vectors - vectors[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(neighbours, len(vectors) - 1)]
        apart.extend(_popcount(packed[near] ^ packed[i]))
    if apart:
        codes.radius = int(np.quantile(apart, COVERED, method="higher"))
    return codes


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def _ball(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits, fewest first."""
    masks = np.arange(1 << SUB_BITS, dtype=np.uint32)
    counts = np.bitwise_count(masks)
    return masks[np.argsort(counts, kind="stable")][: int((counts <= radius).sum())].astype(np.uint16)


class Shard:
    """One shard of the index: a table for each substring that lists its vectors by the substring's value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.packed = codes.of(vectors)
        self.substrings = self.packed.shape[1]
        self.lists, self.starts = [], []
        for j in range(self.substrings):
            order = np.argsort(self.packed[:, j], kind="stable")
            self.lists.append(order)
            self.starts.append(np.searchsorted(self.packed[order, j], np.arange((1 << SUB_BITS) + 1)))
        self.balls: dict[int, np.ndarray] = {}

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits.

        With radius = s * substrings + a, such a code is within s bits in one of the first a + 1 substrings or within s - 1
        in one of the others (pigeonhole); the lists of all values in those balls are probed and the whole codes checked.
        """
        s, a = divmod(radius, self.substrings)
        hit = np.zeros(len(self.ids), bool)
        for j in range(self.substrings):
            reach = s if j <= a else s - 1
            if reach < 0:
                continue
            if reach not in self.balls:
                self.balls[reach] = _ball(reach)
            values = (self.balls[reach] ^ code[j]).astype(np.int64)
            first, last = self.starts[j][values], self.starts[j][values + 1]
            counts = last - first
            full = counts > 0
            first, counts = first[full], counts[full]
            total = int(counts.sum())
            if total:
                place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
                hit[self.lists[j][place]] = True
        rows = np.flatnonzero(hit)
        return rows[_popcount(self.packed[rows] ^ code) <= radius]

    def search(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The k nearest of the rows within the radius, by distance of the original vectors; the radius widens until k are found."""
        radius = self.codes.radius
        while True:
            rows = self.within(code, radius)
            others = rows[self.ids[rows] != query_id]
            if len(others) >= k or radius >= CODE_BITS:
                break
            radius = min(CODE_BITS, radius + self.substrings)
        far = np.sqrt(((self.vectors[others] - vector) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[others], far))[:k]
        return [(query_id, int(i), float(d)) for i, d in zip(self.ids[others][best], far[best])]


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("vector")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(quoted(key).cast("bigint").alias("id"), quoted(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance in double precision.

    Ties go to the smaller id, and a query is not its own neighbour (rows of its id are left out). Codes and
    radius are learned on at most ``FIT_ROWS`` rows, the smallest by a hash of the id; every row is indexed. Rows are dealt
    to shards by hash, and every block of queries visits every shard, so a common vector or label
    makes no shard larger. A shard holds about ``SHARD_ROWS`` vectors and reads the queries as a stream.

    Vectors that are null, zero, of another length than most, or hold a null or a number that is not finite take no part. Fewer
    than k other rows: all are returned. Repeated ids are rows of their own. No usable row: an empty result.
    """
    spark = df.sparkSession
    rows = _usable(df, key, vector)
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dimension, total = lengths["d"], lengths["count"]
    rows = rows.where(F.size("vector") == dimension)
    mixed = F.xxhash64(F.lit("sample"), "id")
    share = min(1.0, 2 * FIT_ROWS / total)
    sample = rows.where(F.pmod(mixed, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(mixed, "id").limit(FIT_ROWS).select("vector").collect()
    codes = learn(np.array([r[0] for r in sample]).reshape(-1, dimension), k)
    shards = max(1, -(-total // SHARD_ROWS))
    asked = _usable(queries, key, vector).where(F.size("vector") == dimension)
    both = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asked"), "id", "vector").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"), "id", "vector")
    )
    found = (
        both.repartition(shards, "shard").sortWithinPartitions("shard", "asked").mapInArrow(_searched(codes, k, dimension), as_schema(FOUND))
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(codes: Codes, k: int, dimension: int):
    out = to_arrow_schema(as_schema(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, shard = None, [], None
        for batch in batches:
            places = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]) | (asked[1:] != asked[:-1])) + 1), len(ids)]
            for a, b in itertools.pairwise(cuts):
                if places[a] != current:
                    current, parts, shard = places[a], [], None
                if not asked[a]:
                    parts.append((ids[a:b], vectors[a:b]))
                    continue
                if shard is None:
                    if not parts:
                        continue
                    shard = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), codes)
                    parts = []
                for i in range(a, b, QUERY_BLOCK):
                    block = slice(i, min(b, i + QUERY_BLOCK))
                    hits = []
                    for q, v, c in zip(ids[block].tolist(), vectors[block], codes.of(vectors[block])):
                        hits.extend(shard.search(q, v, c, k))
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits), out)], schema=out)

    return run
