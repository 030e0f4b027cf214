"""SimHash near-duplicates: 64-bit fingerprints linked through an inverted index over their byte positions."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tabulift.llm.common import components, quoted, stored

SEED = 42
BITS = 64
POSITIONS = 8
#: Posting lists of at most so many fingerprints are compared pair by pair, longer ones through masks: where both cost about the same.
SHORT_LIST = 512
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``width`` words, repeats included; no word gives zero."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()[min(width, len(words)) - 1 :]
    ones, total = np.zeros(BITS, np.int64), len(stops)
    for at in range(0, total, BLOCK):
        spans = zip(starts[at : at + BLOCK], stops[at : at + BLOCK])
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, width: int = 3) -> Column:
    """The SimHash of every whole text, as a signed long with the same bits."""

    @F.arrow_udf(LongType())
    def taken(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64))

    return taken(text)


def _combinations(shared: int) -> list[tuple[int, ...]]:
    """Position sets of one size less than ``shared`` such that any ``shared`` positions hold all of one set, chosen greedily."""
    left = set(itertools.combinations(range(POSITIONS), shared))
    sets = list(itertools.combinations(range(POSITIONS), max(1, shared - 1)))
    chosen = []
    while left:
        best = max(sets, key=lambda s: sum(set(s) <= set(x) for x in left))
        left = {x for x in left if not set(best) <= set(x)}
        chosen.append(best)
    return chosen


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(255)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _posting(value: Column, positions: tuple[int, ...], number: int) -> Column:
    """The posting list of the bytes at some positions: the list's number and those bytes."""
    kept = sum(255 << 8 * p for p in positions)
    return F.struct(F.lit(number).cast("tinyint").alias("which"), value.bitwiseAND(F.lit(_signed(kept))).alias("bytes"))


def links(values: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column ``value``) that connect all pairs of at most ``distance`` differing bits.

    Such a pair differs in at most ``distance`` of its eight bytes, so it shares at least 8 - distance bytes at their
    positions: the guaranteed minimum. The index lists fingerprints by the bytes at position sets chosen so that every pair
    with the minimum is in one list. Pairs of a list are tallied (shared positional bytes), kept from the minimum on,
    and verified by their differing bits.

    A list longer than ``SHORT_LIST`` is not paired. Its fingerprints emit instead all values within floor(distance / 2)
    bits (near) and within the remaining bits (far); whoever is far from a value is linked to the smallest fingerprint
    near it. Each such edge is within the distance, each pair within it meets at some value, and the rows are a fixed number
    for each fingerprint. These edges connect what the pairs would connect, without all pairs.
    """
    minimum = POSITIONS - distance
    sets = _combinations(minimum)
    v = F.col("value")
    indexed = values.select(v, F.explode(F.array(*[_posting(v, s, i) for i, s in enumerate(sets)])).alias("key"))
    longer = indexed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = stored(indexed.join(longer, "key").select("key.which", "key.bytes", "value", "n"), "postings")
    short = lists.where(F.col("n") <= SHORT_LIST).select("which", "bytes", "value")
    a, b = F.col("a"), F.col("b")
    pairs = short.withColumnRenamed("value", "a").join(short.withColumnRenamed("value", "b"), ["which", "bytes"]).where("a < b")
    tally = sum((_byte(a, p) == _byte(b, p)).cast("int") for p in range(POSITIONS))
    differing = F.bit_count(a.bitwiseXOR(b))
    paired = pairs.where((tally >= minimum) & (differing <= distance)).select("a", "b")
    return paired.unionByName(_masked(lists.where(F.col("n") > SHORT_LIST).select("value").distinct(), distance)).distinct()


def _masked(values: DataFrame, distance: int) -> DataFrame:
    near_bits = distance // 2
    met = values.select("value", F.col("value").alias("at"), F.lit(0).alias("low"), F.lit(0).alias("changed"))
    for _ in range(distance - near_bits):  # change one more bit above the last one, or (place BITS) no more
        bit = F.col("bit")
        met = met.select("value", "at", "changed", F.explode(F.sequence("low", F.lit(BITS))).alias("bit")).select(
            "value",
            F.when(bit < BITS, F.col("at").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).otherwise(F.col("at")).alias("at"),
            F.least(bit + 1, F.lit(BITS)).alias("low"),
            (F.col("changed") + (bit < BITS).cast("int")).alias("changed"),
        )
    heads = met.where(F.col("changed") <= near_bits).groupBy("at").agg(F.min("value").alias("head"))
    return met.join(heads, "at").where("value <> head").select(F.least("value", "head").alias("a"), F.greatest("value", "head").alias("b"))


def near_duplicates(df: DataFrame, width: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): the SimHash (16 hexadecimal digits) and the smallest key that links lead to.

    Documents link if their fingerprints differ in at most ``distance`` bits; equal fingerprints are indexed once, so
    copies make no pairs. Texts are read once and never shuffled. A null text has no words and the fingerprint zero, which
    links like any other. Repeated keys are one document; a null key takes no part and has a null component. An empty table gives none.
    """
    marked = stored(df.select(quoted(key).alias("key"), fingerprints(quoted(text), width).alias("value")), "fingerprints")
    values = stored(marked.where("key is not null").groupBy("value").agg(F.min("key").alias("first")), "values")
    found = stored(links(values.select("value"), distance), "links")
    first = values.select("value", "first")
    ends = found.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # keys in several fingerprints (repeated keys) connect these, too
    shared = marked.where("key is not null").select("value", "key").join(first, "value").select(F.col("key").alias("a"), F.col("first").alias("b"))
    repeated = marked.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("a"))
    labels = components(ends.unionByName(shared.join(repeated, "a", "left_semi")))
    groups = values.join(labels.withColumnRenamed("node", "first"), "first", "left").select(
        "value", F.coalesce("component", "first").alias("component_id")
    )
    digits = F.lower(F.lpad(F.hex("value"), 16, "0"))
    return (
        marked.join(groups, "value", "left")
        .select(F.col("key").alias(key), digits.alias("fingerprint"), F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))
    )


def one_of_each(df: DataFrame, width: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document is the first of its component; rows with a null key stay."""
    found = near_duplicates(df, width, distance, key, text)
    dropped = found.where(F.col(key) > F.col("component_id")).select(quoted(key)).distinct()
    return df.join(dropped, key, "left_anti")
