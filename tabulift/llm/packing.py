"""Packing: token pieces of documents into sequences of a fixed length, by shortest-pack-first over the length histogram."""

from __future__ import annotations

import functools
import os
import re
import string
import struct
import unicodedata
import zlib
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulift.llm.common import Remembered, by_rows, quoted, stored

#: Words, and other strings between spaces, that a Python worker remembers with their ids.
REMEMBERED = 300_000
#: Longer ones are not remembered, which bounds the memory.
SHORT = 64
#: New words that are encoded in one call.
TOGETHER = 1_000
#: Rows of one length that are ranked together, about.
RANKED = 1_000
PIECE = "key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


#: Signs of which any run is one match of the splitting pattern; ' may begin another one, < a special token.
_SIGNS = "".join(c for c in string.punctuation if c not in "'<")
#: Letters of one code point that neither normalising nor lower case turns into anything but such a letter.
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Runs of these letters, runs of signs, and whatever stands between spaces from where something else follows them.
_ATOMS = re.compile(rf"[{_LATIN}]++(?![^ \n{re.escape(_SIGNS)}])|[{re.escape(_SIGNS)}]++(?![^ \n{_LATIN}])|[^ \n]+")
_WORD = re.compile(f"[{_LATIN}]+")


class Tokenizer:
    """Ids of whole texts; words, signs and other strings between spaces are encoded once while they are remembered.

    Strings of special tokens that stand in a text become their ids, as the library does without further settings.
    Right for byte-level vocabularies that lower the case, drop white space and split letters from other signs, as no match
    then crosses a space, the place between a word and the signs behind it, or that between the signs and a next word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Library.from_file(path)
        self.merged = self.library.model.tokenize
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = {ord(c): bytes_of(c)[0][0] for c in map(chr, range(0x80, 0x100)) if _WORD.fullmatch(c)}
        self.words = Remembered(REMEMBERED)

    def _word(self, word: str) -> bytes:
        """Lower-case Latin words go to the library's model as they are: nothing is left to normalise or split."""
        ids = [t.id for t in self.merged(word if word.isascii() else word.translate(self.signs))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, strings: list[str]) -> dict[str, bytes]:
        """One call for all strings, which hold no space: the place of each id tells its string."""
        coded = self.library.encode(" ".join(strings), add_special_tokens=False)
        ids = np.array(coded.ids, "<u4")
        starts = np.cumsum([0] + [len(w) + 1 for w in strings])
        cuts = np.searchsorted([o[0] for o in coded.offsets], starts).tolist()
        return {w: ids[a:b].tobytes() for w, a, b in zip(strings, cuts, cuts[1:])}

    def _learn(self, atoms: dict[str, None]) -> dict[str, bytes]:
        """The ids of atoms that were not used lately: Latin words by their lower case, others as a word and the signs behind it."""
        known, parts, others = {}, {}, {}
        recall = self.words.get
        for atom in atoms:
            value = recall(atom)
            if value is None and _WORD.fullmatch(atom):
                low = atom.lower()
                if low == atom or (value := recall(low)) is None:
                    value = self._word(low)
                    self._keep(low, value)
                if low != atom:
                    self._keep(atom, value)
            if value is not None:
                known[atom] = value
                continue
            word = atom.rstrip(_SIGNS)
            # letters that turn into marks when they are normalised go with the signs behind them
            whole = word in ("", atom) or not word.isalpha() or not unicodedata.normalize("NFC", word).lower().isalpha()
            parts[atom] = (atom,) if whole else (word, atom[len(word) :])
            for x in parts[atom]:
                if x not in known and (value := recall(x)) is not None:
                    known[x] = value
                elif x not in known:
                    others[x] = None
        new = list(others)
        for i in range(0, len(new), TOGETHER):
            for x, value in self._encode(new[i : i + TOGETHER]).items():
                known[x] = value
                self._keep(x, value)
        for atom, strings in parts.items():
            if atom not in known:
                known[atom] = b"".join([known[x] for x in strings])
                self._keep(atom, known[atom])
        return known

    def _keep(self, string: str, ids: bytes) -> None:
        if len(string) <= SHORT:
            self.words.put(string, ids)

    def __call__(self, text: str) -> bytes:
        atoms = _ATOMS.findall(text)
        coded = list(map(self.words.young.get, atoms))
        if None in coded:
            gaps, at = [], -1
            for _ in range(coded.count(None)):
                gaps.append(at := coded.index(None, at + 1))
            found = self._learn(dict.fromkeys([atoms[i] for i in gaps]))
            for i in gaps:
                coded[i] = found[atoms[i]]
        return b"".join(coded)


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut_pieces(df: DataFrame, path: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): every document as pieces of ``size`` tokens and a rest, ids counted once.

    A document is the ids of its whole text followed by ``end_id``; a null text is empty and so one token. Repeated rows
    are documents of their own; a null key stays null. The checksum is over the piece's ids as little-endian unsigned
    32-bit integers.
    """
    end = np.array([end_id], "<u4").tobytes()

    def row(k, t):
        ids = tokenizer(path)(t or "") + end
        for at in range(0, len(ids), 4 * size):
            part = ids[at : at + 4 * size]
            yield 40, (k, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)

    kind = df.schema[key].dataType.simpleString()
    return by_rows(df.select(quoted(key).alias("key"), quoted(text).alias("text")), PIECE.format(kind=kind), ("key", "text"), row)


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of packs of that pattern.

    Lengths are placed longest first; each goes to the packs that are shortest so far among those it fits
    into, as many at a time as the pattern has packs. The histogram has at most ``size`` lengths, whatever the corpus.
    """
    open_packs: dict[int, list[list]] = {}  # by the tokens so far: [pattern, packs]
    totals: list[int] = []
    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], []
        while left:
            at = bisect_right(totals, size - length)
            if not at or not length:
                made.append(((length,), left))
                break
            shortest = totals[0]
            pattern, packs = open_packs[shortest][-1]
            used = min(left, packs)
            left -= used
            made.append((pattern + (length,), used))
            if used == packs:
                open_packs[shortest].pop()
                if not open_packs[shortest]:
                    del open_packs[shortest]
                    totals.pop(0)
            else:
                open_packs[shortest][-1][1] -= used
            # packs that just got this length may get it again, if they are still the shortest
            _add(open_packs, totals, *made.pop())
        for pattern, packs in made:
            _add(open_packs, totals, pattern, packs)
    return [(p, n) for total in totals for p, n in open_packs[total]]


def _add(open_packs: dict, totals: list[int], pattern: tuple[int, ...], packs: int) -> None:
    total = sum(pattern)
    if total not in open_packs:
        open_packs[total] = []
        insort(totals, total)
    open_packs[total].append([pattern, packs])


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, uses per sequence, offset of the first use) by pattern and length.

    Equal lengths in a pattern follow each other, so rank r - first is use (r - first) mod uses of a sequence.
    """
    places, ranked, sequence = [], {}, 0
    for pattern, packs in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            uses = pattern.count(length)
            first = ranked.get(length, 0)
            ranked[length] = first + uses * packs
            places.append((length, first, first + uses * packs, sequence, uses, offset))
            offset += uses * length
        sequence += packs
    return places


def pack(pieces: DataFrame, size: int, order: tuple[str, ...] = ("key", "start"), length: str = "length") -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces: gapless places in sequences of at most ``size`` tokens.

    ``length`` is from 1 to ``size``. Only the histogram (at most ``size`` numbers) and the patterns made from it reach the
    driver. Ranks within a length are counted in shares of about ``RANKED`` rows, so that a common length needs no task of
    its own; a share's first rank comes from counts per length and share. Rows that tie in ``order`` may change places.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    shares = [(n, 1 + count // RANKED) for n, count in histogram.items()]
    dealt = pieces.join(F.broadcast(spark.createDataFrame(shares, f"{length} bigint, shares bigint")), length)
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64(*order), "shares"))
    sizes = dealt.groupBy(length, "share").count()
    before = Window.partitionBy(length).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(length, "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(length, "share").orderBy(*order)
    ranked = (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(firsts, [length, "share"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    places = spark.createDataFrame(
        _places(plan_packs(histogram, size)), f"{length} bigint, first bigint, last bigint, sequence bigint, uses bigint, at bigint"
    )
    use = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(places), [length])
        .where("rank >= first and rank < last")
        .withColumn("sequence_id", F.col("sequence") + F.floor(use / F.col("uses")).cast("bigint"))
        .withColumn("offset", F.col("at") + F.pmod(use, F.col("uses")) * F.col(length))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def tokenize_and_pack(df: DataFrame, path: str, end_id: int = 2, size: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document; an empty table gives none."""
    pieces = stored(cut_pieces(df, path, end_id, size, key, text), "pieces")
    return pack(pieces, size).withColumnRenamed("key", key)
