"""Byte-level BPE: texts to ids and back, by merge ranks of a vocabulary file."""

from __future__ import annotations

import base64
import functools
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulift.llm.common import Remembered, by_rows, free_name, quoted

#: Words that a Python worker remembers with their ids.
REMEMBERED = 200_000
#: Longer words are not remembered, which bounds the memory.
SHORT = 64
#: Longer words are merged with a heap, in n log n steps.
LONG_WORD = 48


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a vocabulary file with a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@functools.cache
def read_pieces(path: str) -> pa.Array:
    """The piece of each rank at its place, null where no piece has that rank."""
    ranks = read_ranks(path)
    pieces = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.large_binary())


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged, leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < _NEVER:
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], _NEVER)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], _NEVER)
    return [ranks[p] for p in parts]


_NEVER = 1 << 62


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            left[stop] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes whole texts; words that were met before are not merged again."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.words = Remembered(REMEMBERED)

    def _word(self, word: str) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            ids = fold_word(word.encode("utf-8", "replace"), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= SHORT:
                self.words.put(word, packed)
        return packed

    def __call__(self, text: str) -> np.ndarray:
        words = self.pattern.findall(text)
        coded = list(map(self.words.young.get, words))
        at = -1
        for _ in range(coded.count(None)):
            at = coded.index(None, at + 1)
            coded[at] = self._word(words[at])
        return np.frombuffer(b"".join(coded), "<u4")


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the ids of every whole text, each match of ``pattern`` encoded separately.

    A null text is empty and gives no ids; repeated rows are encoded each; a null key stays null; other columns take no part.
    ``path`` must exist on every machine, as a file of an installed package does. Distinct words are folded
    once per worker while the cache holds them; texts are never shuffled.
    """

    def row(k, t):
        ids = encoder(path, pattern)(t or "")
        yield 4 * len(ids) + 64, (k, ids)

    kind = df.schema[key].dataType.simpleString()
    return by_rows(df.select(quoted(key).alias("key"), quoted(text).alias("text")), f"key {kind}, ids array<int>", ("key", "text"), row).select(
        F.col("key").alias(key), "ids"
    )


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for, as one concatenation of their pieces; null ids give null, an unknown id fails.

    ``out`` gets underscores if a column has that name.
    """
    name = free_name(df, out)

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        pieces = read_pieces(path)
        return pa.array([_joined(pieces.take(x.values)) if x.is_valid else None for x in lists], pa.binary())

    return df.withColumn(name, joined(quoted(ids)))


def _joined(pieces: pa.LargeBinaryArray) -> bytes:
    """The bytes of all pieces, which lie behind each other in the array's buffer."""
    if pieces.null_count:
        raise KeyError("an id without a piece")
    return pieces.buffers()[2].to_pybytes() if len(pieces) else b""
