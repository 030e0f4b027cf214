"""Byte-level dedup: bytes covered by a string that also starts anywhere else, found with suffix arrays over shards."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tabulift.llm.common import free_name, quoted, stored, with_variant

#: Bytes of the strings whose hashes choose anchors.
GRAM = 32
#: Bytes of one shard, about. A shard's suffix array takes some tens of bytes for each.
SHARD_BYTES = 2 << 20
#: Bytes of texts that are hashed at once, about.
TEXT_BYTES = 1 << 16
#: Contexts of one anchor in one part, about; more are searched part against part.
PART = 20_000
BASE = 0x9E3779B97F4A7C13

ANCHORS = pa.schema([("f", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("variant", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
SPANS = pa.schema([("f", pa.int64()), ("context", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


# ---- anchors: every window of a text belongs to one place that its own bytes choose ----


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, from prefix sums modulo 2**64."""
    n = len(data)
    size = 1 << (n + 1).bit_length()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _powers(pow(BASE, -1, 1 << 64), size)[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _last_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the smallest, the last one of equals."""
    n = len(values)
    places = np.arange(n, dtype=np.uint64)
    packed = (values & np.uint64(0xFFFFFF0000000000)) | (np.uint64((1 << 40) - 1) - places)  # smallest value, then largest place
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (np.uint64((1 << 40) - 1) - (best & np.uint64((1 << 40) - 1))).astype(np.int64)


def contexts(raws: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(f, context, of, first, n): for each anchor its hash, the hash of its context, its text and where its windows start there.

    Every window of ``window`` bytes belongs to the anchor with the smallest hash among the strings of GRAM bytes inside it
    (the last of equals). That depends on the window's bytes alone, so equal windows have equal anchors at equal offsets. The
    windows of an anchor start at ``first`` and the n - 1 places behind it; its context is the bytes they cover. The texts, of
    ``window`` bytes at least, are hashed one after the other; windows that reach over the end of one are left out.
    """
    joined = raws[0] if len(raws) == 1 else b"".join(raws)
    sizes = np.array([len(raw) for raw in raws])
    starts = np.cumsum(sizes) - sizes
    stops = starts + sizes - window + 1
    h = _gram_hashes(np.frombuffer(joined, np.uint8))
    places = _last_smallest(h, window - GRAM + 1)
    edge = np.ones(len(places) + 1, bool)
    edge[1:-1] = places[1:] != places[:-1]
    edge[starts] = edge[stops] = True
    edges = np.flatnonzero(edge)
    first, n = edges[:-1], np.diff(edges)
    of = np.searchsorted(starts, first, "right") - 1
    inside = first < stops[of]
    first, n, of = first[inside], n[inside], of[inside]
    at = places[first]
    size = n - 1 + window
    view = memoryview(joined)
    digests = [xxhash.xxh3_64_intdigest(view[a : a + s], o) for a, s, o in zip(first.tolist(), size.tolist(), (at - first).tolist())]
    return h[at].view(np.int64), np.array(digests, np.uint64).view(np.int64), of, first - starts[of], n


# ---- suffix arrays ----


#: Symbols (9 bits each) that one number holds.
AT_ONCE = 7


def _joined(data: np.ndarray, places: np.ndarray, step: int, stop: int) -> np.ndarray:
    """Symbols ``step`` to step + AT_ONCE of the suffixes at these places as one number, none from ``stop`` on."""
    out = np.zeros(len(places), np.uint64)
    for j in range(step, step + AT_ONCE):
        out <<= np.uint64(9)
        if j < stop:
            at = places + j
            out |= np.where(at < len(data), data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
    return out


def _packed(data: np.ndarray) -> np.ndarray:
    """AT_ONCE symbols from each place as one number, 0 behind the end."""
    one = np.zeros(len(data) + AT_ONCE - 1, np.int64)
    one[: len(data)] = data
    two = one[:-1] << 9 | one[1:]
    four = two[:-2] << 18 | two[2:]
    return four[:-3] << 27 | four[3:]  # both hold the fourth symbol, at the same bits


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of symbols (0 to 511) in order. Behind the end every symbol is 0."""
    return refined(data, len(data))[0]


def refined(data: np.ndarray, most: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes ordered by their first ``most`` symbols, by Larsson-Sadakane refinement; those of one rank have these in common.

    Suffixes start sorted by their first seven symbols. Each round doubles the sorted length, the last one up to ``most``: a suffix is
    placed within its group by the rank of the suffix that many symbols on. Only groups of several suffixes are sorted again; a
    suffix alone in its group keeps its place. The rank is the place of the last of a group, which only falls when the group is split.
    With ``wanted`` only the marked suffixes are ordered and have such ranks: the others are left out of the last round.
    """
    n, length = len(data), min(AT_ONCE, max(most, 1))
    key = _packed(data) >> 9 * (AT_ONCE - length)
    order = np.argsort(key)
    rank = np.full(n + 1, -1, np.int32 if n < 1 << 31 else np.int64)  # the last one stands for all places behind the end
    suffixes, places, differs = order, np.arange(n), np.diff(key[order]) != 0
    while True:
        ends = np.flatnonzero(np.r_[differs, True])
        sizes = np.diff(np.r_[-1, ends])
        group = np.repeat(places[ends], sizes)
        rank[suffixes] = group
        if length >= most:
            break
        step = min(length, most - length)
        several = np.repeat(sizes > 1, sizes)
        if wanted is not None and length + step >= most:
            several &= wanted[suffixes]
        suffixes, places, group = suffixes[several], places[several], group[several]
        if not len(suffixes):
            break
        key = group * (n + 1) + rank.take(suffixes + step, mode="clip") + 1
        inner = np.argsort(key)
        suffixes, key = suffixes[inner], key[inner]
        order[places] = suffixes
        differs = np.diff(key) != 0
        length += step
    return order if wanted is None else order[wanted[order]], rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of each suffix (by its start) with the one before it in the order, up to ``most``: Kasai's rule.

    Where the suffix before is the one before at the last place, moved on by one as well, the common prefix is one shorter than there.
    Only the other places are compared, several symbols at once and side by side; the rest follow from the last of these before them.
    With the ``rank`` of an order by the first ``most`` symbols only, suffixes of one rank have these in common and are not compared.
    Suffixes that are not in the order have 0.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tied = np.zeros(n, bool) if rank is None else (before >= 0) & (rank == rank[before])
    follows = np.zeros(n, bool)
    moved = np.flatnonzero((before[:-1] >= 0) & (before[1:] == before[:-1] + 1))
    follows[moved + 1] = data[moved] == data[before[moved]]
    result = np.where(tied, most, 0)
    compared = np.flatnonzero((before >= 0) & ~follows & ~tied)
    result[compared] = _agreeing(data, compared, before[compared])
    last = np.maximum.accumulate(np.where(follows & ~tied, 0, np.arange(n)))
    return np.minimum(result[last] + last - np.arange(n), most)


def _agreeing(data: np.ndarray, places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of symbols that the suffixes from these places have in common with those from the others."""
    packed, bounds = _packed(data), 1 << 9 * np.arange(AT_ONCE)
    room = len(data) - np.maximum(places, others)
    have = np.zeros(len(places), np.int64)
    open_ = np.arange(len(places))
    while len(open_):
        on = have[open_]
        # the highest symbol that differs tells how many do not
        same = AT_ONCE - np.searchsorted(bounds, packed[places[open_] + on] ^ packed[others[open_] + on], "right")
        on += same
        have[open_] = on
        open_ = open_[(same == AT_ONCE) & (on < room[open_])]
    return np.minimum(have, room)


class Shard:
    """Contexts one after the other, with separators, and the order of the windows that they own."""

    def __init__(self, texts: list[bytes], counts: list[int], window: int):
        self.window = window
        sizes = np.array([len(t) + 1 for t in texts])
        self.starts = np.cumsum(sizes) - sizes
        self.counts = np.array(counts)
        data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int16) + 1
        data[self.starts + sizes - 1] = 0
        self.data = data
        own = np.zeros(len(data) + 1, np.int64)  # windows that belong to their context's anchor; others are owned elsewhere
        np.add.at(own, self.starts, 1)
        np.add.at(own, self.starts + self.counts, -1)
        self.order, rank = refined(data, window, np.cumsum(own[:-1]) > 0)
        prefixes = common_prefixes(data, self.order, window, rank)
        # equal for a whole window: in the order, windows with only long common prefixes between them
        group = np.cumsum(prefixes[self.order] < window)
        self.repeated = np.zeros(len(data), bool)
        self.repeated[self.order] = (np.bincount(group) > 1)[group]

    def merge(self, other: Shard) -> None:
        """Mark the windows that both shards own, by binary search of this shard's windows in the other's order."""
        wanted = self.order
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(other.order))
        for _ in range(int(len(other.order)).bit_length()):
            middle = (low + high) // 2
            open_ = low < high
            sign = np.zeros(len(wanted), np.int64)
            sign[open_] = self._compare(wanted[open_], other, other.order[middle[open_]])
            low = np.where(open_ & (sign > 0), middle + 1, low)
            high = np.where(open_ & (sign <= 0), middle, high)
        there = np.flatnonzero(low < len(other.order))
        there = there[self._compare(wanted[there], other, other.order[low[there]]) == 0]
        self.repeated[wanted[there]] = True
        first = low[there]  # the first of equal windows; the others of its group are repeated in their own shard
        other.repeated[other.order[first]] = True

    def _compare(self, places: np.ndarray, other: Shard, there: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as each window is before, equal to or behind the other's."""
        sign = np.zeros(len(places), np.int64)
        open_ = np.arange(len(places))
        for step in range(0, self.window, AT_ONCE):
            a = _joined(self.data, places[open_], step, self.window)
            b = _joined(other.data, there[open_], step, self.window)
            sign[open_] = np.where(a < b, -1, np.where(a > b, 1, 0))
            open_ = open_[a == b]
            if not len(open_):
                break
        return sign

    def spans(self, number: int) -> list[tuple[int, int]]:
        """Runs [a, b) of the offsets at which a context's own windows are repeated."""
        marks = self.repeated[self.starts[number] : self.starts[number] + self.counts[number]]
        edges = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeated_in(contexts_of: list[tuple[list[bytes], list[int]]], window: int) -> list[list[tuple[int, int]]]:
    """Spans of all contexts of some shards that belong to one group: in each shard, then across each two of them."""
    shards = [Shard(texts, counts, window) for texts, counts in contexts_of]
    for i, shard in enumerate(shards):
        for before in shards[:i]:
            shard.merge(before)
    return [shard.spans(number) for shard in shards for number in range(len(shard.counts))]


# ---- as Spark jobs ----


def _documents(df: DataFrame, key: str, text: str, variant: str) -> DataFrame:
    return df.select(quoted(key).cast(LongType()).alias("doc"), quoted(text).cast(BinaryType()).alias("raw"), quoted(variant).alias("variant"))


def _anchored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, held, full = [], 0, [], 0
        for batch in batches:
            for doc, raw, variant in zip(*(batch.column(i) for i in range(3))):
                doc, raw = doc.as_py(), raw.as_py()
                if doc is None or raw is None or len(raw) < window:
                    continue
                held.append((doc, raw, variant.as_py()))
                full += len(raw)
                if full >= TEXT_BYTES:
                    parts.append(hashed(held))
                    size += len(parts[-1][0])
                    held, full = [], 0
                if size >= 1 << 17:
                    yield _columns(parts, ANCHORS)
                    parts, size = [], 0
        if held:
            parts.append(hashed(held))
        if parts:
            yield _columns(parts, ANCHORS)

    def hashed(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        docs, raws, variants = zip(*rows)
        f, context, of, first, n = contexts(raws, window)
        return f, context, np.array(docs, np.int64)[of], np.array(variants, np.int64)[of], first, n

    return run


def _columns(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*parts), schema)], schema=schema)


def _sharded(window: int):
    """Reads contexts in order of their anchor, fills shards and searches them; a group that goes on in the next shard is merged across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # rows (f, i, j, context, raw, n)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[-1][:3] and (size >= SHARD_BYTES or row[0] == held[-1][0]):
                    yield from search(held)
                    held, size = [], 0
                if held and row[:4] == held[-1][:4]:
                    continue  # the same context from an equal row of its key
                held.append(row)
                size += len(row[4])
        if held:
            yield from search(held)

    def search(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        shards, size = [([], [])], 0
        for *_, raw, n in rows:
            if size >= SHARD_BYTES:
                shards.append(([], []))
                size = 0
            shards[-1][0].append(raw)
            shards[-1][1].append(n)
            size += len(raw)
        found = [(f, c, a, b) for (f, _, _, c, _, _), spans in zip(rows, repeated_in(shards, window)) for a, b in spans]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*found), SPANS)], schema=SPANS)

    return run


def repeated_strings(df: DataFrame, variant: str, window: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, variant, spans): of every text, runs (first, last + 1) of places at which a string of ``window`` bytes starts that also starts elsewhere.

    ``variant`` names the column of ``with_variant``.
    1. Each window belongs to an anchor chosen by its own bytes, about one place in 85; rows hold only hashes and places.
    2. Contexts that two places share are known to be repeated as a whole; copies are summed up before the shuffle. Anchors
       that one place has cannot hold a repeated window and are dropped.
    3. What is left are anchors with several different contexts. One copy of each is fetched, dealt to shards by anchor, and each
       shard's suffix array and common prefixes give the windows that two contexts share. Equal windows have equal anchors, so
       they meet in one group; a group larger than a shard is searched shard by shard and merged by binary search.
    4. The contexts of an anchor that has more than PART of them are cut into parts, and each two parts are searched on their own, so
       that no task holds more than two.
    """
    docs = _documents(df, key, text, variant)
    anchors = stored(docs.mapInArrow(_anchored(window), from_arrow_schema(ANCHORS)), "anchors")
    # written before they are joined, so that a common anchor can be split
    several = stored(anchors.groupBy("f").agg(F.count("*").alias("all")).where(F.col("all") > 1).select("f"), "several")
    shared = stored(anchors.join(several, "f", "left_semi"), "shared")
    grouped = shared.groupBy("f", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "variant", "first", "n")).alias("at"))
    grouped = stored(grouped.select("f", "context", "copies", "at.*"), "contexts")
    kinds = stored(grouped.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    known = grouped.join(kinds, "f")
    wanted = known.groupBy("doc", "variant").agg(F.collect_list(F.struct("f", "context", "first", "n", "kinds")).alias("wanted"))
    wanted = wanted.withColumnRenamed("doc", "at").withColumnRenamed("variant", "of")
    fetched = docs.join(wanted, (F.col("doc") == F.col("at")) & (F.col("variant") == F.col("of")))
    piece = F.substring(F.col("raw"), F.col("w.first") + 1, F.col("w.n") + (window - 1)).alias("raw")
    pieces = fetched.select("raw", F.explode("wanted").alias("w")).select("w.f", "w.context", piece, "w.n", "w.kinds")
    met = _in_parts(pieces).select("f", "i", "j", "context", "raw", "n")
    order = ["f", "i", "j"]
    spans = met.repartition(*order).sortWithinPartitions(*order, "context").mapInArrow(_sharded(window), from_arrow_schema(SPANS))
    whole = grouped.where("copies > 1").select("f", "context", F.lit(0).alias("a"), F.col("n").alias("b"))
    found = stored(spans.unionByName(whole), "spans")
    placed = shared.join(found, ["f", "context"]).select("doc", "variant", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    return placed.groupBy("doc", "variant").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _in_parts(pieces: DataFrame) -> DataFrame:
    """The contexts with the block (i, j) of parts in which they meet; anchors with up to PART contexts have one part."""
    parts = F.ceil(F.col("kinds") / PART).cast("int")
    mine = F.pmod(F.col("context"), parts).cast("int")
    met = pieces.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.withColumn("i", F.least("mine", "with")).withColumn("j", F.greatest("mine", "with"))


def dedup_bytes(df: DataFrame, window: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and kept: the bytes of the text that no repeated string of ``window`` bytes covers.

    Texts are UTF-8 bytes; a string counts as repeated if it also starts anywhere else, in the same document or another, also where
    the two overlap; strings do not cross documents and are judged on the input. ``kept`` is binary, as cuts may fall
    inside a character. A null text is empty. Rows with a null key take no part and keep all. Rows of one key are different
    documents to each other and repeat each other, whether their texts are equal or not. Other columns stay; new ones get underscores
    if a column has their name. An empty table gives no row. A key that is no integer raises ValueError.
    """
    if df.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise ValueError(f"{key} must be an integer column")
    variant = free_name(df, "variant")
    marked = with_variant(df, key, text, variant)
    at, of, runs = (free_name(marked, name) for name in ("at", "of", "spans"))
    spans = repeated_strings(marked, variant, window, key, text).toDF(at, of, runs)
    same = (quoted(key).cast(LongType()) == quoted(at)) & (quoted(variant) == quoted(of))
    joined = marked.join(spans, same, "left").select(*map(quoted, df.columns), quoted(runs))
    added = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept", BinaryType())]
    schema = StructType(df.schema.fields + [StructField(free_name(df, name), kind) for name, kind in added])
    return joined.mapInArrow(_without(window, df.columns.index(text), len(df.columns), to_arrow_schema(schema)), schema)


def without_bytes(raws: list[bytes], of: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[list[int], list[int], list[bytes]]:
    """(removed, runs, kept) of each text, for runs [start, end) of places in the text ``of`` at which repeated strings start."""
    sizes = np.array([len(raw) for raw in raws], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)  # one place between two texts, so that runs do not meet
    order = np.argsort(base[of] + starts)
    of = of[order]
    low, high = base[of] + starts[order], np.maximum.accumulate(base[of] + ends[order] - 1 + window)
    first = np.flatnonzero(np.r_[np.ones(min(1, len(low)), bool), low[1:] > high[:-1]])
    last = np.r_[first[1:], len(low)][: len(first)] - 1
    of, low, high = of[first], low[first], high[last]
    removed, runs, kept = np.zeros(len(raws), np.int64), np.bincount(of, minlength=len(raws)), list(raws)
    np.add.at(removed, of, high - low)
    cuts = list(zip((low - base[of]).tolist(), (high - base[of]).tolist()))
    stops = np.cumsum(runs)
    for k in np.flatnonzero(runs).tolist():
        raw, parts, at = raws[k], [], 0
        for a, b in cuts[stops[k] - runs[k] : stops[k]]:
            parts.append(raw[at:a])
            at = b
        kept[k] = b"".join([*parts, raw[at:]])
    return removed.tolist(), runs.tolist(), kept


def _without(window: int, at: int, columns: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at), batch.column(columns)
            raws = [raw or b"" for raw in (texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts).to_pylist()]
            of = np.repeat(np.arange(len(raws)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            starts, ends = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())  # null lists have no place among these
            removed, runs, kept = without_bytes(raws, of, starts, ends, window)
            arrays = [batch.column(i) for i in range(columns)] + [pa.array(map(len, raws)), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run
