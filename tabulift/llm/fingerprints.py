"""Document fingerprints from prefix polynomial hashes of code points."""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabulift.llm.common import as_schema, by_rows, free_name, quoted

# A prime below 2**31 and two bases, chosen once.
PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
#: Prefix and suffix lengths whose hashes a fingerprint holds: about so many per doubling.
PER_DOUBLING = 4
#: Bits of the finest and the coarsest spans: their mean length is 2**bits code points.
FINEST, COARSEST = 3, 11
#: Code points of a span of six bits, at most.
MOST = 16 << 6


_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo the prime. One table a base is kept, as long as the longest text asked for, and doubled when it ends."""
    out = _TABLES.get(base, np.ones(1, np.int64))
    while len(out) < n:
        out = np.concatenate([out, out * (int(out[-1]) * base % PRIME) % PRIME])
        _TABLES[base] = out
    return out[:n]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Prefixes:
    """Prefix hashes of a sequence: entry i is the sum of (c_j + 1) base**j over j < i, modulo the prime, for both bases.

    The hash of any span is a difference of two entries; spans at different places are compared after both
    are moved to the same power, so any equality of spans takes constant time.
    """

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for base in BASES:
            terms = (points + 1) * powers(base, self.n) % PRIME
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(terms, out=sums[1:])  # below 2**31 * 2**31 for any text that fits in memory
            self.sums.append(sums % PRIME)

    def followed(self, cut: int, other: Prefixes, length: int) -> Prefixes:
        """The prefixes of self[:cut] + other[:length], from the two arrays that are there: the other's entries move by one power."""
        joined = object.__new__(Prefixes)
        joined.n, joined.sums = cut + length, []
        for base, own, theirs in zip(BASES, self.sums, other.sums):
            moved = (own[cut] + theirs[1 : length + 1] * powers(base, cut + 1)[cut]) % PRIME
            joined.sums.append(np.concatenate([own[: cut + 1], moved]))
        return joined

    def span(self, start, length, which: int):
        """base**start times the span's own hash."""
        return (self.sums[which][start + length] - self.sums[which][start]) % PRIME

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether the spans self[start:start+length] and other[at:at+length] are equal."""
        if start + length > self.n or at + length > other.n:
            return False
        return all(
            int(self.span(start, length, w)) * pow(b, max(at - start, 0), PRIME) % PRIME
            == int(other.span(at, length, w)) * pow(b, max(start - at, 0), PRIME) % PRIME
            for w, b in enumerate(BASES)
        )

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension of the two places, by binary search over span equality."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, at, middle) else (low, middle - 1)
        return low

    def ending(self, other: Prefixes) -> int:
        """Length of the longest common ending, by the same search."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(self.n - middle, other, other.n - middle, middle) else (low, middle - 1)
        return low

    def own(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes of spans moved to power zero, so that equal spans have equal values: two 31-bit numbers in one."""
        out = np.zeros(len(starts), np.uint64)
        for w, back in enumerate(_BACK):
            moved = self.span(starts, lengths, w) * powers(back, self.n + 1)[starts] % PRIME
            out = (out << np.uint64(31)) | moved.astype(np.uint64)
        return out


#: What undoes one power of each base.
_BACK = tuple(pow(base, PRIME - 2, PRIME) for base in BASES)


@functools.cache
def _grid(octaves: int) -> np.ndarray:
    return np.unique(np.floor(2.0 ** (np.arange(octaves * PER_DOUBLING + 1) / PER_DOUBLING)).astype(np.int64))


def grid(n: int) -> np.ndarray:
    """The lengths at most n whose prefix and suffix hashes a fingerprint of n code points holds."""
    lengths = _grid(48)
    return lengths[: np.searchsorted(lengths, n, "right")]


def span_ends(points: np.ndarray, bits: int = 6) -> np.ndarray:
    """Where spans end: behind every eight code points whose hash starts with ``bits`` zeros, every 16 * 2**bits without such a place, and the end."""
    return _ends(_marks(points), len(points), bits)


def _marks(points: np.ndarray) -> np.ndarray:
    """The hash of the eight code points from each place."""
    h = points.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = h[:-step] * np.uint64(factor) + h[step:] if len(h) > step else h[:0]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _ends(marks: np.ndarray, n: int, bits: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(marks >> np.uint64(64 - bits) == 0) + 8
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    most = 16 << bits
    sizes = np.diff(ends, prepend=0)
    if sizes.max() <= most:
        return ends
    inner = [np.arange(a + most, a + size, most) for a, size in zip((ends - sizes).tolist(), sizes.tolist()) if size > most]
    return np.unique(np.concatenate([ends, *inner]))


def levels(n: int) -> tuple[int, int]:
    """The two levels (bits of ``span_ends``) at which a text of n code points has spans: between 64 and 128 of them, and half as many.

    Texts whose lengths differ by less than a factor of two share a level.
    """
    bits = min(max(n.bit_length() - 7, FINEST), COARSEST)
    return bits, bits + 1


def fingerprint(text: str | None) -> str:
    """``n:hash:prefixes:suffixes:level:spans:sizes:spans:sizes`` in hexadecimal.

    The hash is that of all code points; then come 32-bit hashes of the prefixes and suffixes of grid lengths, and, for both
    ``levels`` of the length, those of all spans (``span_ends``) in order and their sizes. Spans are chosen by what stands in them, so an edit changes
    those it touches and no others. Their size follows the text, so that a fingerprint has some thousand digits at any length up to
    128 * 2**COARSEST code points, and grows slowly beyond. A null text is empty.
    """
    points = code_points(text)
    return _fingerprint(points, Prefixes(points))


def _fingerprint(points: np.ndarray, sums: Prefixes) -> str:
    n, lengths = len(points), grid(len(points))
    marks, first = _marks(points), levels(n)
    ends = [_ends(marks, n, bits) for bits in first]
    sizes = [np.diff(e, prepend=0) for e in ends]
    zeros = np.zeros(len(lengths) + 1, np.int64)
    starts = np.concatenate([zeros, n - lengths, *(e - s for e, s in zip(ends, sizes))])
    hashes = sums.own(starts, np.concatenate([[n], lengths, lengths, *sizes]).astype(np.int64))
    whole, k = int(hashes[0]), 1 + len(lengths)
    parts = [_short(x) for x in np.split(hashes[1:], np.cumsum([k - 1, k - 1, len(sizes[0])]))]
    spans = [f"{h}:{s.astype('>u2').tobytes().hex()}" for h, s in zip(parts[2:], sizes)]
    return f"{n:x}:{whole:016x}:{parts[0]}:{parts[1]}:{first[0]:x}:{':'.join(spans)}"


def _short(hashes: np.ndarray) -> str:
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return mixed.astype(">u4").tobytes().hex()


def _common(a: str, b: str, lengths: np.ndarray) -> int:
    """The longest grid length at which both hash lists agree, by binary search: a common prefix of a length has all shorter ones."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[8 * middle - 8 : 8 * middle] == b[8 * middle - 8 : 8 * middle] else (low, middle - 1)
    return int(lengths[low - 1]) if low else 0


def _spans(hashes: str, sizes: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, starts, ends) of a fingerprint's spans; a name is a span's hash and length in one number."""
    lengths = np.frombuffer(bytes.fromhex(sizes), ">u2").astype(np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(bytes.fromhex(hashes), ">u4").astype(np.int64) << 16 | lengths, ends - lengths, ends


def _in_both(a: np.ndarray, b: np.ndarray) -> int:
    """Code points of the spans that both hold, each as often as in the one that has it less often."""
    return sum((name & 0xFFFF) * n for name, n in (Counter(a.tolist()) & Counter(b.tolist())).items())


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of the longer text that both have in common, found from the fingerprints alone.

    In common are the prefix and suffix, rounded down to the grid, and the whole spans between them; or all whole spans, if these
    are more. Spans are compared at the finest level that both have; texts without one differ by more than a factor of two in
    length. An edit hides the spans that it touches, about a fiftieth of the text and ten code points; a moved span counts. Equal texts have 1.
    """
    (n, whole, heads, tails, level, *spans), (m, other, heads_, tails_, level_, *spans_) = a.split(":"), b.split(":")
    if (n, whole) == (m, other):
        return 1.0
    n, m, level, level_ = (int(x, 16) for x in (n, m, level, level_))
    if not n or not m:
        return 0.0
    lengths = grid(min(n, m))
    head, tail = _common(heads, heads_, lengths), _common(tails, tails_, lengths)
    between = everywhere = 0
    if abs(level - level_) <= 1:
        finest = max(level, level_)
        (own, start, end), (own_, start_, end_) = _spans(*spans[2 * (finest - level) :][:2]), _spans(*spans_[2 * (finest - level_) :][:2])
        between = _in_both(own[(start >= head) & (end <= n - tail)], own_[(start_ >= head) & (end_ <= m - tail)])
        everywhere = _in_both(own, own_)
    return min(max(head + tail + between, everywhere), min(n, m)) / max(n, m)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text; a null text is empty. ``out`` gets underscores if a column has that name."""

    @F.arrow_udf("string")
    def taken(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.string())

    return df.withColumn(free_name(df, out), taken(quoted(text)))


EDITED = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "same_head bigint, same_tail bigint"
)


def _dealing(cuts: list, sent: dict):
    """The range of each key, and those that a key is also sent to."""

    @F.arrow_udf("array<int>")
    def dealt(keys: pa.Array) -> pa.Array:
        return pa.array([[len(cuts) - bisect.bisect_left(cuts, k), *sent.get(k, ())] for k in keys.to_pylist()], pa.list_(pa.int32()))

    return dealt


def edit_likeness(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_head, same_tail) of every row.

    The edited text has the last third of its code points replaced by the first as many (or all) of the next row's, in
    descending key order, the first row following the last. ``near_*`` are the likeness of the row's
    fingerprint to the edited text's and the next row's; ``same_*`` the longest common beginning and ending of the text and the edited
    one, by binary search over prefix hashes. Those of the edited text come from the two arrays at hand. Rows are dealt to tasks by ranges of the key, in order, and read
    as a stream; the first row of each range is also sent to the range before it, so the texts are shuffled once.

    Null texts are empty. Rows of one key follow each other by text. Rows with a null key have no place in the order:
    the text next to them is empty. A single row is its own next; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(quoted(key).alias("key"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, 10_000)).first()[0] or ()))
    # Range 0 holds the highest keys. What reaches the driver is one key per range; tasks search the sorted cuts.
    known = rows.where("key is not null")
    places = known.select("key", _dealing(cuts, {})("key").getItem(0).alias("place"))
    firsts = {r["place"]: r["key"] for r in places.groupBy("place").agg(F.max("key").alias("key")).collect()}
    order, sent = sorted(firsts), {}
    for before, after in zip(order, order[1:] + order[:1]):
        sent.setdefault(firsts[after], []).append(before)
    dealt = known.select("key", "text", F.posexplode(_dealing(cuts, sent)("key")).alias("n", "place"))
    dealt = dealt.select("place", (F.col("n") > 0).alias("guest"), "key", "text")
    streamed = (
        dealt.repartition("place")
        .sortWithinPartitions("place", "guest", F.col("key").desc(), "text")
        .mapInArrow(_edited_stream(df, key), as_schema(f"key {df.schema[key].dataType.simpleString()}, {EDITED}"))
    )

    def alone(k, t):
        yield 4000, (k, *_edited(Marked(t), Marked("")))

    lost = by_rows(rows.where("key is null"), f"key {df.schema[key].dataType.simpleString()}, {EDITED}", ("key", "text"), alone)
    return streamed.unionByName(lost).withColumnRenamed("key", key)


class Marked:
    """A text with its code points, prefix hashes and fingerprint."""

    def __init__(self, text: str):
        self.text, self.points = text, code_points(text)
        self.sums = Prefixes(self.points)
        self.mark = _fingerprint(self.points, self.sums)


def _edited(row: Marked, following: Marked) -> tuple:
    n = len(row.text)
    cut, length = n - n // 3, min(n // 3, len(following.text))
    edited = row.text[:cut] + following.text[:length]
    sums = row.sums.followed(cut, following.sums, length)
    mark = _fingerprint(np.concatenate([row.points[:cut], following.points[:length]]), sums)
    digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
    ends = row.sums.extension(0, sums, 0), row.sums.ending(sums)
    return n, digest, row.mark, mark, likeness(row.mark, mark), likeness(row.mark, following.mark), *ends


def _edited_stream(df: DataFrame, key: str):
    out = to_arrow_schema(as_schema(f"key {df.schema[key].dataType.simpleString()}, {EDITED}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (range, key, text)
        for batch in batches:
            rows = []
            for place, guest, k, t in zip(*(map(_python, batch.column(i)) for i in range(4))):
                now = Marked(t)
                if before and before[0] == place:
                    rows.append((before[1], *_edited(before[2], now)))
                before = None if guest else (place, k, now)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return run


def _python(scalar):
    return scalar.as_py()
