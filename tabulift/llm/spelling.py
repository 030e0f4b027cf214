"""Spelling variants: words within one edit of each other, found by dynamic programming along sorted word lists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabulift.llm.common import as_schema, quoted, small, stored

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 1 << 18
#: Words of one list, at most; longer lists are searched block against block.
CHUNK = 1 << 15
#: Words, and code points, whose lists are searched at once.
BATCH_WORDS, BATCH_CODES = 1 << 15, 1 << 22
#: Words that ask at once.
SLICE = 1 << 13
COUNTED = "word string, n bigint"
NEAR = "side int, word string, other string, other_n bigint"


# ---- counting ----


def _slipped(run: str, start: int, slip_every: int | None) -> str:
    """The run as its document spells it: where ``slip_every`` divides the checksum of document and run, one code point is left out."""
    if slip_every is None:
        return run
    h = crc32(run.encode("utf-8"), start)
    if h % slip_every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words_of(text: str) -> Counter:
    """Maximal runs of Latin letters, A-Z in lower case, and how often each occurs."""
    return Counter(_RUN.findall(text.encode("utf-8").lower().decode("utf-8")))  # bytes: A-Z only


def vocabulary(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3, slip_every: int | None = None
) -> DataFrame:
    """(word, n): the words of at least ``least_chars`` code points that occur at least ``least_count`` times in the whole table.

    Words are ``words_of`` the whole texts; a null text has none. Each task sums up its words before the shuffle. With ``slip_every``
    spelling errors are planted: a word that a document spells is cut by one code point wherever that number divides the checksum (crc32 of
    ``<key>:<word>``); rows with a null key spell all words right.
    """
    schema = as_schema(COUNTED)
    out = to_arrow_schema(schema)

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for rows in batches:
            for doc, t in zip(rows.column(0).to_pylist(), rows.column(1)):
                if (t := t.as_py()) is None:
                    continue
                start = crc32(f"{doc}:".encode())
                for run_, n in words_of(t).items():
                    word = _slipped(run_, start, None if doc is None else slip_every)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    counted = df.select(quoted(key).cast("string"), quoted(text)).mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- searching sorted lists ----


class Lists:
    """Sorted word lists, one after the other, as the nodes that their common prefixes make.

    A node at depth d is the range of words of one list that share their first d code points. ``starts[d]`` are the first
    words of the nodes at depth d; ``below[d]`` the range of each one's nodes at depth d + 1. The common prefix of each word with the one
    before it, ``shared``, tells where ranges end.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.codes, self.sizes, self.group = codes, sizes, group
        n, width = codes.shape
        same = (codes[1:] == codes[:-1]) & (codes[1:] >= 0)
        shared = np.full(n, -1)
        shared[1:] = np.where(same.all(axis=1), width, np.argmin(same, axis=1)) if width else 0
        shared[1:][group[1:] != group[:-1]] = -1
        ends = np.arange(1, n + 1)
        self.starts, self.below, before = [], [], None
        for depth in range(width + 1):
            heads = np.flatnonzero((shared < depth) & (sizes >= depth))
            breaks = np.append(np.flatnonzero(shared < depth), n)
            ends = breaks[np.searchsorted(breaks, heads, "right")]
            if before is not None:
                first, last = before
                self.below.append((np.searchsorted(heads, first), np.searchsorted(heads, last)))
            self.starts.append(heads)
            before = (heads, ends)

    def search(self, asked: np.ndarray, lengths: np.ndarray, root: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, listed word) of all pairs at an edit distance of exactly one.

        Questions are rows of code points (-2 behind the end) with their lengths, the group they ask and the number of leading code points
        that they share with all its words. A state is a question at a node, with three cells of the edit matrix: the distances of the node's
        prefix from the question's prefixes that are one shorter, as long, and one longer. The row is computed once for all words of the
        node's range; where all three exceed one, the whole range is skipped.
        """
        padded = np.pad(asked, ((0, 0), (1, 2)), constant_values=-2)  # code point i stands at i + 1
        found_q, found_s = [], []
        q = node = a = b = c = np.zeros(0, np.int64)
        for depth in range(int(start.min()), len(self.below)):
            new = np.flatnonzero(start == depth)
            if len(new):
                heads = self.starts[depth]
                at = np.searchsorted(self.group[heads], root[new])
                there = at < len(heads)
                there[there] = self.group[heads[at[there]]] == root[new][there]
                new, at = new[there], at[there]
                ones = np.ones(len(new), np.int8)
                q, node = np.concatenate([q, new]), np.concatenate([node, at])
                a, b, c = (np.concatenate([x, y]).astype(np.int8) for x, y in ((a, ones if depth else 2 * ones), (b, 0 * ones), (c, ones)))
            if not len(q):
                if (start <= depth).all():
                    break
                continue
            low, high = self.below[depth]
            counts = high[node] - low[node]
            of = np.repeat(np.arange(len(q)), counts)
            child = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + low[node][of]
            q, a, b, c = q[of], a[of], b[of], c[of]
            word = self.starts[depth + 1][child]
            symbol, size = self.codes[word, depth], lengths[q]
            new_a = np.minimum(a + (padded[q, depth] != symbol), b + 1) if depth else b + 1
            new_a[size < depth] = 2
            new_b = np.minimum(np.minimum(b + (padded[q, depth + 1] != symbol), c + 1), new_a + 1)
            new_b[size < depth + 1] = 2
            new_c = np.minimum(c + (padded[q, depth + 2] != symbol), new_b + 1)
            new_c[size < depth + 2] = 2
            off = size - (depth + 1)
            distance = np.select([off == -1, off == 0, off == 1], [new_a, new_b, new_c], 2)
            hit = (self.sizes[word] == depth + 1) & (distance == 1)
            found_q.append(q[hit])
            found_s.append(word[hit])
            alive = np.minimum(np.minimum(new_a, new_b), new_c) <= 1
            q, node, a, b, c = q[alive], child[alive], new_a[alive], new_b[alive], new_c[alive]
        return np.concatenate([np.zeros(0, np.int64), *found_q]), np.concatenate([np.zeros(0, np.int64), *found_s])


def _codes(words: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words as rows, filled up at the end, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    out = np.full((len(words), int(sizes.max(initial=0))), fill, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def near_in(group: np.ndarray, words: list[str], listed: np.ndarray, asking: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking, listed) of places of words of one group that are one edit apart; words are in order within ascending groups."""
    codes, sizes = _codes(words, -1)
    inside = np.flatnonzero(listed)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = Lists(codes[inside], sizes[inside], group[inside])
    questions, found = np.flatnonzero(asking), []
    for at in range(0, len(questions), SLICE):
        some = questions[at : at + SLICE]
        rows = np.where(codes[some] < 0, -2, codes[some])
        q, s = lists.search(rows, sizes[some], group[some], start[some])
        found.append((some[q], inside[s]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


# ---- as Spark jobs ----


def _keyed(words: DataFrame, least: int) -> DataFrame:
    """Every word in four lists: of the words with its first, or last, half, where the shorter of a pair has its length or one less.

    The halves are those of the shorter word. Two words that are one edit apart either share the first half of the shorter or, if the edit is
    in there, the code points behind it.
    """
    size = F.length("word")

    def lists(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        front = F.struct(F.lit(0).alias("side"), m.alias("m"), F.substring(F.col("word"), F.lit(1), half).alias("key"))
        back = F.struct(F.lit(1).alias("side"), m.alias("m"), F.reverse(F.right(F.col("word"), m - half)).alias("key"))
        return [front, back]

    both = F.array(*lists(size), *lists(size - 1))
    rows = words.select("word", "n", F.explode(both).alias("list")).select("word", "n", "list.*")
    return rows.where(F.col("m") >= least).withColumn("turned", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))


def _blocks(keyed: DataFrame) -> DataFrame:
    """Rows with the block (i, j) of their list in which they meet: part i asks part j. A list of up to CHUNK words is one part."""
    names = ["side", "m", "key"]
    long_ = keyed.groupBy(*names).agg(F.count("*").alias("count")).where(F.col("count") > CHUNK)
    hot = stored(long_.select(*names, F.ceil(F.col("count") / CHUNK).cast("int").alias("parts")), "lists")
    cut = keyed.join(small(hot), names, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    met = cut.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("i", F.least("mine", "with")).withColumn("j", F.greatest("mine", "with"))


def _search(schema: pa.Schema):
    """Reads rows (side, m, key, i, j, mine, word, turned, n) in order of list, block and turned word, and searches some lists at a time."""

    def searched(rows: list[tuple], groups: list[int]) -> Iterator[pa.RecordBatch]:
        group = np.array(groups)
        alone = np.bincount(group)[group] == 1
        kept = np.flatnonzero(~alone).tolist()
        rows, group = [rows[k] for k in kept], group[~alone]
        if not rows:
            return
        side, m, key, i, j, mine, word, turned, n = zip(*rows)
        m, i, j, mine, n, size = np.array(m), np.array(i), np.array(j), np.array(mine), np.array(n), np.fromiter(map(len, word), np.int64, len(word))
        q, s = near_in(group, list(turned), mine == j, mine == i, np.fromiter(map(len, key), np.int64, len(key)))
        of_list = np.minimum(size[q], size[s]) == m[q]  # else another list has the pair
        q, s = q[of_list], s[of_list]
        crossed = i[q] != j[q]
        q, s = np.concatenate([q, s[crossed]]), np.concatenate([s, q[crossed]])
        if len(q):
            taken = [[side[x] for x in q.tolist()], [word[x] for x in q.tolist()], [word[x] for x in s.tolist()], n[s]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(taken, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, groups, codes, now = [], [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != now:
                    if len(rows) >= BATCH_WORDS or codes >= BATCH_CODES:
                        yield from searched(rows, groups)
                        rows, groups, codes = [], [], 0
                    now = row[:5]
                    groups.append(groups[-1] + 1 if groups else 0)
                else:
                    groups.append(groups[-1])
                rows.append(row)
                codes += len(row[6])
        if rows:
            yield from searched(rows, groups)

    return run


def near_words(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, other, other_n): all ordered pairs of distinct words that differ by one inserted, deleted or replaced code point.

    ``words`` (word, n) are distinct, of at least ``least`` code points. Each word stands in four short lists (``_keyed``), so that no list is
    the whole vocabulary. A sorted list is searched by edit matrices cut to three cells a row, rows being shared by all words with a common
    prefix and ranges skipped as soon as their prefix exceeds one edit. A list longer than CHUNK words is cut into parts, and blocks of
    two parts are searched on their own, so that no task holds a longer one. No pair is found twice.
    """
    order = ["side", "m", "key", "i", "j"]
    rows = _blocks(_keyed(words, least)).select(*order, "mine", "word", "turned", "n")
    schema = as_schema(NEAR)
    found = rows.repartition(*order).sortWithinPartitions(*order, "turned").mapInArrow(_search(to_arrow_schema(schema)), schema)
    half = F.floor(F.least(F.length("word"), F.length("other")) / 2).cast("int")
    one = F.lit(1)
    in_front = F.substring(F.col("word"), one, half) == F.substring(F.col("other"), one, half)  # then the list of first halves has the pair
    return found.where((F.col("side") == 0) | ~in_front).select("word", "other", "other_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, to) lead in the end, by joining paths of doubled length until none goes on."""
    now = stored(links, "roots")
    while True:
        onward = now.select(F.col("word").alias("to"), F.col("to").alias("then"))
        now = stored(now.join(onward, "to", "left").select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "roots")
        if now.where("moved").limit(1).count() == 0:
            return now.select("word", F.col("to").alias("root"))
        now = now.drop("moved")


def variants(words: DataFrame, least: int = 5, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the spelling that each word of a vocabulary (word, n) is a variant of.

    The form of a word is its near word (one edit apart) of largest n, ties to the smallest in code-point order, if its n is at least ``factor``
    times the word's own, else null. The root is where forms lead in the end: n grows by that factor with each, so they form no circle. Words without
    a form are their own root; ``n_near`` counts near words, 0 if there are none. An empty vocabulary gives no row.
    """
    kept = stored(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(kept, least).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.n") >= factor * F.col("n")
    formed = stored(
        kept.join(near, "word", "left").select(
            "word",
            F.when(chosen, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(chosen, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("to")))
    joined = formed.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3, slip_every: int | None = None
) -> DataFrame:
    """``variants`` of the ``vocabulary`` of a table of texts. Other columns of the table do not matter, whatever their names."""
    return variants(vocabulary(df, key, text, least_chars, least_count, slip_every), least_chars)
