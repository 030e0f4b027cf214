"""Substring dedup: words covered by a window that also starts in an earlier document, found from difference-cover anchors."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tabulift.llm.common import free_name, quoted, small, stored, with_variant

# A perfect difference set. Every distance modulo PERIOD is a difference of two of its members.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Bases of the two window hashes, both 3 modulo 8.
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
#: Windows that a task compares among themselves before the rest is shuffled.
BUFFER = 1 << 20
MET = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("variant", pa.int64()), ("places", pa.binary())])
PLACES = pa.schema([("doc", pa.int64()), ("variant", pa.int64()), ("places", pa.binary())])


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space."""
    return (text or "").encode("utf-8").split()


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(n, 1).bit_length())[:n]


class Rolling:
    """Hashes of windows over the word hashes of one document, modulo 2**64, from prefix sums."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.values = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, self.n)

    def windows(self, starts: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.values * powers(base, self.n), out=sums[1:])
        back = powers(pow(base, -1, 1 << 64), self.n)
        return (sums[starts + width] - sums[starts]) * back[starts]


def anchors(rolling: Rolling, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a document's anchors and their hashes: the cover positions modulo the period.

    For any two equal windows some place in both, at the same distance from their starts and less than a period
    behind them, is a cover position in both. An anchor is so long that it still lies inside the window then.
    """
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    places = np.arange(max(0, rolling.n - width + 1))
    places = places[cover[places % PERIOD]]
    return places, rolling.windows(places, width), np.zeros(len(places), np.uint64)


def extended(rolling: Rolling, found: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of all whole windows around the anchors found."""
    marks = np.zeros(rolling.n + PERIOD + 1, np.int64)
    np.add.at(marks, np.maximum(found - PERIOD + 1, 0), 1)
    np.add.at(marks, found + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks)[: max(0, rolling.n - window + 1)] > 0)
    return starts, rolling.windows(starts, window), rolling.windows(starts, window, BASES[1])


def unpacked(lists: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(lists or ()), "<i4").astype(np.int64)


class Meeting:
    """Collects (hash, document, variant, place) and sends on what other tasks must see.

    Windows that meet here are settled here: their places go out as known (h is null). For each hash one row
    for its smallest document goes out, whatever the number of copies, so a common window is summed up before the shuffle.
    """

    def __init__(self, later: bool):
        self.later = later
        self.parts, self.size = [], 0

    def add(self, doc: int, variant: int, places: np.ndarray, h: np.ndarray, h2: np.ndarray) -> None:
        if len(places):
            self.parts.append((np.full(len(places), doc), np.full(len(places), variant), places, h, h2))
            self.size += len(places)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        doc, variant, place, h, h2 = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((place, variant, doc, h2, h))
        doc, variant, place, h, h2 = doc[order], variant[order], place[order], h[order], h2[order]
        group = _starts(h, h2)
        run = group | _starts(doc, variant)  # places of one hash and text
        heads = np.flatnonzero(group)
        of = np.cumsum(group) - 1
        shared = doc[np.r_[heads[1:], len(doc)] - 1] != doc[heads]
        known = (doc != doc[heads][of]) if self.later else shared[of]
        yield from _known(doc[known], variant[known], place[known])
        first = doc == doc[heads][of]  # the rows of the smallest document of each hash
        starts = np.flatnonzero(run & first)
        stops = np.append(np.flatnonzero(run), len(doc))
        stops = stops[np.searchsorted(stops, starts, "right")]
        raw = place.astype("<i4").tobytes()
        empty = shared[of[starts]] & (not self.later)
        lists = [b"" if e else raw[4 * a : 4 * b] for a, b, e in zip(starts.tolist(), stops.tolist(), empty.tolist())]
        hashes = [pa.array(x[starts].view(np.int64)) for x in (h, h2)]
        yield pa.RecordBatch.from_arrays([*hashes, pa.array(doc[starts]), pa.array(variant[starts]), pa.array(lists, pa.binary())], schema=MET)


def _starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the pair (a, b) differs from the one before."""
    return np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]


def _known(doc: np.ndarray, variant: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    order = np.lexsort((variant, doc))
    doc, variant, raw = doc[order], variant[order], place[order].astype("<i4").tobytes()
    cuts = np.append(np.flatnonzero(_starts(doc, variant)), len(doc))
    lists = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    none = pa.nulls(len(lists), pa.int64())
    heads = cuts[:-1]
    yield pa.RecordBatch.from_arrays([none, none, pa.array(doc[heads]), pa.array(variant[heads]), pa.array(lists, pa.binary())], schema=MET)


def _settle(later: bool):
    """Reads rows in order of their hash and document: which documents have the hash, and so whose places count.

    Of a hash that goes on in the next batch only its smallest document is kept, so a common window takes no memory.
    """

    def send(docs: np.ndarray, variants: np.ndarray, lists: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(variants), pa.array(lists, pa.binary())], schema=PLACES)

    def settled(h, h2, doc, variant, lists) -> Iterator[pa.RecordBatch]:
        group = _starts(h, h2)
        heads, of = np.flatnonzero(group), np.cumsum(group) - 1
        filled = np.fromiter((len(x) > 0 for x in lists), bool, len(lists))
        if later:
            counts = doc > np.minimum.reduceat(doc, heads)[of]
        else:
            counts = (
                (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)) | ~np.logical_and.reduceat(filled, heads)
            )[of]
        chosen = np.flatnonzero(counts & filled)
        yield from send(doc[chosen], variant[chosen], [lists[i] for i in chosen.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            lists = batch.column(4).to_pylist()
            docs, variants = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            if null.any():
                known = np.flatnonzero(null)
                yield from send(docs[known], variants[known], [lists[i] for i in known.tolist()])
            open_ = np.flatnonzero(~null)
            if not len(open_):
                continue
            h, h2 = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False)[open_] for i in (0, 1))
            now = (h, h2, docs[open_], variants[open_], [lists[i] for i in open_.tolist()])
            if rest is not None:
                now = (*(np.concatenate([a, b]) for a, b in zip(rest[:4], now[:4])), rest[4] + now[4])
            last = int(np.flatnonzero(_starts(now[0], now[1]))[-1])
            if last:
                yield from settled(*(x[:last] for x in now))
            rest = tuple(x[last:] for x in now)
            if later or rest[2][0] != rest[2][-1] or not all(rest[4]):
                yield from settled(*rest)
                rest = (*(x[:1] for x in rest[:4]), [b""])  # its document is the smallest; without places, it says that the hash counts
        if rest is not None:
            yield from settled(*rest)

    return run


def _round(rows: DataFrame, at: tuple[int, int, int, int | None], look: Callable, later: bool) -> DataFrame:
    """(doc, variant, places): all places, as lists of packed integers, at which ``look(words, found)`` gives a hash that counts.

    ``at`` tells the columns of key, text, variant and places found so far. Without ``later`` a hash counts that at least two documents
    have, with it one that a smaller document has.
    """
    key, text, variant, places = at

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(later)
        for batch in batches:
            found = batch.column(places) if places is not None else None
            variants = batch.column(variant).to_pylist()
            for i, (doc, t) in enumerate(zip(batch.column(key), batch.column(text))):
                if found is not None and not found[i].is_valid:
                    continue
                doc, t = doc.as_py(), t.as_py()
                if doc is None or not t:
                    continue
                meeting.add(doc, variants[i], *look(Rolling(words_of(t)), unpacked(found[i].as_py() if found is not None else None)))
                if meeting.size >= BUFFER:
                    yield from meeting.flush()
        yield from meeting.flush()

    sent = rows.mapInArrow(meet, from_arrow_schema(MET))
    route = F.coalesce(F.col("h"), F.xxhash64("doc"))  # known rows go anywhere, evenly
    settled = (
        sent.repartition(route)
        .sortWithinPartitions("h", "h2", "doc")
        .mapInArrow(_settle(later), from_arrow_schema(PLACES))
    )
    return settled.groupBy("doc", "variant").agg(F.collect_list("places").alias("places"))


def _copies(df: DataFrame, key: str, text: str, variant: str) -> DataFrame:
    """(doc, variant) of documents whose whole text a smaller one has; found by hash, the texts are not shuffled.

    First documents of copied texts are written before the join, which can then split a text that many documents have.
    """
    t = quoted(text)
    hashed = df.where(quoted(key).isNotNull() & t.isNotNull()).select(
        quoted(key).cast(LongType()).alias("doc"),
        quoted(variant).alias("variant"),
        F.xxhash64(t).alias("h"),
        F.xxhash64(F.lit(1), t).alias("h2"),
        F.length(t).alias("n"),
    )
    counted = hashed.groupBy("h", "h2", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    firsts = stored(counted.drop("last"), "copied")
    return hashed.join(small(firsts), ["h", "h2", "n"]).where("doc > first").select("doc", "variant").distinct()


def _with(df: DataFrame, found: DataFrame, key: str, variant: str) -> DataFrame:
    """The rows and, behind their columns, the places found for their text."""
    at, of, places, copy = (free_name(df, n) for n in ("at", "of", "places", "copy"))
    renamed = found.select("doc", "variant", "places", "copy").toDF(at, of, places, copy)
    return df.join(renamed, (quoted(key).cast(LongType()) == quoted(at)) & (quoted(variant) == quoted(of)), "left").drop(at, of)


def repeated_windows(df: DataFrame, variant: str, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, variant, places, copy): of every text, the starts of windows of ``window`` words that also start in a smaller document.

    ``variant`` names the column of ``with_variant``. Two rounds. The first hashes short windows at cover positions only (6 of 31) and finds those that two documents have; any two
    equal windows share one. The second extends them: it hashes all whole windows around them, with two 64-bit
    hashes, and finds those that a smaller document has. Documents are compared by hash, never pair by pair. A document whose
    whole text a smaller one has needs no second round: ``copy`` says that all its windows count, and its places are empty.
    """
    at = tuple(df.columns.index(c) for c in (key, text, variant))
    found = _round(df, (*at, None), lambda rolling, _: anchors(rolling, window), later=False)
    copies = stored(_copies(df, key, text, variant), "copies")
    open_ = found.join(copies, ["doc", "variant"], "left_anti").withColumn("copy", F.lit(False))
    starts = _round(_with(df, open_, key, variant), (*at, len(df.columns)), lambda rolling, places: extended(rolling, places, window), later=True)
    whole = copies.select("doc", "variant", F.array().cast("array<binary>").alias("places"), F.lit(True).alias("copy"))
    return starts.withColumn("copy", F.lit(False)).unionByName(whole)


def dedup_substrings(df: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with, in ``text``, the words left that no window repeated from a smaller document covers, and n_words, n_removed.

    A word is a run of other characters than ASCII white space, unchanged; windows are judged on the input, not on what is left,
    and do not cross documents. Removed words go with the white space behind them; other text stays as it is. Null texts stay
    null, with no words. Rows with a null key take no part and stay. Rows of one key may have different texts: their windows do not
    count against each other, and each loses the windows that a smaller key has. Other columns stay; the counts get underscores if a column has
    their name. An empty table gives no row. A key that is no integer, or a window below 32 words, raises ValueError.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has at least {PERIOD + 1} words")
    if df.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise ValueError(f"{key} must be an integer column")
    variant = free_name(df, "variant")
    marked = with_variant(df, key, text, variant)
    joined = _with(marked, repeated_windows(marked, variant, window, key, text), key, variant).drop(variant)
    names = (free_name(df, "n_words"), free_name(df, "n_removed"))
    schema = StructType(df.schema.fields + [StructField(n, LongType()) for n in names])
    return joined.mapInArrow(_without(window, df.columns.index(text), len(df.columns), to_arrow_schema(schema)), schema)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without_words(text: str, starts: np.ndarray, window: int) -> tuple[str, int, int]:
    """The text without the words that windows at these starts cover; its words, and the words removed."""
    raw = text.encode("utf-8")
    if not len(starts):
        return text, len(raw.split()), 0
    spans = [m.span() for m in _WORD.finditer(raw)]
    marks = np.zeros(len(spans) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    covered = np.cumsum(marks[:-1]) > 0
    lead = raw[: spans[0][0]]
    kept = lead + b"".join(raw[a:b] for (a, b), gone in zip(spans, covered.tolist()) if not gone)
    return kept.decode("utf-8"), len(spans), int(covered.sum())


def _without(window: int, at: int, columns: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, removed = [], [], []
            for text, lists, copy in zip(*(batch.column(i) for i in (at, columns, columns + 1))):
                text = text.as_py()
                if text is None:
                    left, n, gone = None, 0, 0
                else:
                    starts = np.unique(unpacked(lists.as_py()))
                    if copy.as_py():
                        starts = np.arange(max(0, len(words_of(text)) - window + 1))
                    left, n, gone = without_words(text, starts, window)
                texts.append(left)
                words.append(n)
                removed.append(gone)
            arrays = [batch.column(i) for i in range(columns)]
            arrays[at] = pa.array(texts, schema.field(at).type)
            arrays += [pa.array(words, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run
