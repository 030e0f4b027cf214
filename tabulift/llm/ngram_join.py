"""N-gram Jaccard join: documents linked by the overlap of their word n-gram sets, through rare-first prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tabulift.llm.common import Remembered, by_rows, components, quoted, small, stored

#: Counters of n-grams, by the first bits of their hash, and the rows in which a task sends them.
COUNTER_BITS, COUNTER_ROWS = 20, 64
#: N-grams that a task collects before it counts them.
COLLECTED = 1 << 19
#: Ranges of hashes whose n-grams the suffix filter counts.
RANGES = 64
#: Sets whose prefixes a task remembers to have sent.
SENT_SETS = 1 << 14
#: Rows of prefixes that a task sends at once.
SENT_ROWS = 1 << 17
#: Lists of n-grams whose counter is so large (and far above most counters) are cut into parts before they are shuffled.
HOT_COUNT, HOT_PARTS = 1 << 17, 64
#: Common n-grams that prefixes are long enough to show of every linked pair (all, if they must have fewer).
SHOWN = 3
#: Rounds in which a list is compared with one of its sets only, before what is still apart is compared.
STARS = 1
BASE = np.uint64(0x9E3779B97F4A7C13)

MARKED = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("counter", pa.int32()), ("counts", pa.binary())])
PREFIX = pa.schema([("token", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("part", pa.int16())])
SETS = "id bigint, n bigint, ranges array<int>, tokens array<bigint>"


@dataclass(frozen=True)
class Rule:
    """Links hold where ``of * intersection >= part * union`` of the sets of n-grams of ``width`` words."""

    width: int = 4
    part: int = 85
    of: int = 100

    def least_size(self, n):
        """The smallest set that can link with one of ``n``."""
        return -(-self.part * n // self.of)

    def overlap(self, total):
        """The least intersection of two linked sets that have ``total`` elements together."""
        return -(-self.part * total // (self.of + self.part))


# ---- sets ----


def ngrams(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of the words, A-Z in lower case; of fewer words the whole sequence is one."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * BASE + hashes[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rare_first(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The tokens in one order for the whole table: those of small counters first, equal ones by hash."""
    return tokens[np.lexsort((tokens, common[_counter(tokens)]))]


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _marking(width: int) -> Callable:
    """(row, n, digest) of every row's set, and the counters of all n-grams of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << COUNTER_BITS, np.int64), [], 0
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = ngrams(text.as_py(), width)
                out.append((row, len(tokens), *_digest(tokens), None, None))
                held.append(_counter(tokens))
                size += len(tokens)
                if size >= COLLECTED:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            if out:
                yield _batch(list(zip(*out)), MARKED)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        if counts.any():
            parts = counts.astype("<u4").reshape(COUNTER_ROWS, -1)
            none = [None] * COUNTER_ROWS
            yield _batch([none, none, none, none, range(COUNTER_ROWS), [p.tobytes() for p in parts]], MARKED)

    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = {}
    for batch in batches:
        for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            totals[number] = totals.get(number, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
    if totals:
        schema = pa.schema([("counter", pa.int32()), ("counts", pa.binary())])
        yield _batch([list(totals), [t.astype("<i8").tobytes() for t in totals.values()]], schema)


def _commonness(marked: DataFrame) -> np.ndarray:
    """For each counter how common its n-grams are, in eighths of a doubling: a megabyte at every size of the table."""
    parts = marked.where("counter is not null").select("counter", "counts").repartition(COUNTER_ROWS, "counter")
    rows = parts.mapInArrow(_summing, "counter int, counts binary").collect()  # COUNTER_ROWS rows
    totals = np.zeros(1 << COUNTER_BITS, np.int64)
    for number, counts in rows:
        totals.reshape(COUNTER_ROWS, -1)[number] = np.frombuffer(counts, "<i8")
    return np.minimum(np.round(8 * np.log2(totals + 1)), 255).astype(np.uint8)


def _prefixes(rule: Rule, common) -> Callable:
    """The rare-first prefix of every set, which shares SHOWN n-grams with that of every linked one: (token, digest, n, place, part). A task sends a set once, as long as it remembers it."""
    hot = min(255, max(int(8 * np.log2(HOT_COUNT)), int(np.median(common.value)) + 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, parts, size = Remembered(SENT_SETS), [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = ngrams(text.as_py(), rule.width)
                digest, n = _digest(tokens), len(tokens)
                if not n or sent.get(digest):
                    continue
                sent.put(digest, True)
                length = min(n, n - rule.least_size(n) + SHOWN)
                prefix = rare_first(tokens, common.value)[:length]
                part = np.where(common.value[_counter(prefix)] >= hot, 1 + digest[0] % HOT_PARTS, 0)
                parts.append((prefix.view(np.int64), *(np.full(length, x) for x in (*digest, n)), np.arange(length), part.astype(np.int16)))
                size += length
                if size >= SENT_ROWS:
                    yield _batch([np.concatenate(c) for c in zip(*parts)], PREFIX)
                    parts, size = [], 0
        if parts:
            yield _batch([np.concatenate(c) for c in zip(*parts)], PREFIX)

    return run


def _fetching(rule: Rule) -> Callable:
    """(id, n, ranges, tokens) of a row (id, digest, text) whose text has that digest."""

    def fetch(id_: int, d1: int, d2: int, text: str | None) -> Iterator[tuple[int, tuple]]:
        tokens = ngrams(text, rule.width)
        if _digest(tokens) == (d1, d2):
            ranges = np.bincount((tokens & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES)
            yield 8 * len(tokens) + 300, (id_, len(tokens), ranges.tolist(), tokens.view(np.int64))

    return fetch


# ---- candidates ----


def _long_enough(rule: Rule, a: str, b: str) -> Column:
    """Length filter of two rows of a list."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return rule.of * F.least(n_a, n_b) >= rule.part * F.greatest(n_a, n_b)


def _fits(rule: Rule, a: str, b: str) -> Column:
    """Length and positional filter of two rows of a list: what may still be common from their places on is enough for their sizes.

    Right for the first common n-gram of two sets; in the lists of others it may refuse a pair that this one lets pass.
    """
    n_a, n_b, at_a, at_b = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (a, b))
    return _long_enough(rule, a, b) & ((rule.of + rule.part) * F.least(n_a - at_a, n_b - at_b) >= rule.part * (n_a + n_b))


def _postings(rule: Rule, df: DataFrame, text: str, sets: DataFrame, common) -> DataFrame:
    """(token, id, n, pos): the rows of prefix lists that can pair with another row of their list, stored.

    If the i-th common n-gram of two sets stands at ``pos``, at most ``n - pos + i - 1`` are common. With i = SHOWN and
    ``free = (of + part) (n - pos + i - 1) - part n`` two rows pass this positional filter if the ``free`` of each is at least ``part`` times the
    other's n. So a row whose free is too small for the smallest other n, or whose n is too large for the largest other free, pairs with
    none. Most n-grams stand in one set, and most lists hold chance meetings: these go here, before anything is written. Lists that were cut into parts keep all rows. A linked set keeps SHOWN rows at least (or as many
    as its least overlap); sets with fewer go.
    """
    sent = df.select(quoted(text)).mapInArrow(_prefixes(rule, common), from_arrow_schema(PREFIX))
    list_ = Window.partitionBy("token", "part")
    met = sent.repartition("token", "part").withColumn("rows", F.count("*").over(list_)).where("part > 0 or rows > 1")
    rows = met.drop("rows").distinct()  # what several tasks sent
    free, me = rule.of * F.col("n") - (rule.of + rule.part) * (F.col("pos") - (SHOWN - 1)), F.struct("d1", "d2")
    most, least = F.max(F.struct(F.col("free"), F.col("me"))).over(list_), F.min(F.struct(F.col("n"), F.col("me"))).over(list_)
    ends = rows.withColumn("free", free).withColumn("me", me).withColumn("most", most).withColumn("least", least)
    second = ends.withColumn("next_free", F.max(F.when(F.col("me") != F.col("most.me"), F.col("free"))).over(list_)).withColumn(
        "next_n", F.min(F.when(F.col("me") != F.col("least.me"), F.col("n"))).over(list_)
    )
    other_free = F.when(F.col("me") == F.col("most.me"), F.col("next_free")).otherwise(F.col("most.free"))
    other_n = F.when(F.col("me") == F.col("least.me"), F.col("next_n")).otherwise(F.col("least.n"))
    can = (F.col("free") >= rule.part * other_n) & (other_free >= rule.part * F.col("n"))
    kept = second.where((F.col("part") > 0) | can).select("token", "d1", "d2", "n", "pos")
    named = kept.join(sets.select("id", "d1", "d2", "n"), ["d1", "d2", "n"]).select("token", "id", "n", "pos")
    shown = named.withColumn("rows", F.count("*").over(Window.partitionBy("id")))
    enough = F.least(F.lit(SHOWN), F.ceil(F.lit(rule.part) * F.col("n") / rule.of))
    return stored(shown.where(F.col("rows") >= enough).drop("rows"), "postings")


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists in which several components meet, with the component of each row as ``label``; stored."""
    if links.limit(1).count() == 0:
        return stored(lists.withColumn("label", F.col("id")), "lists")
    found = components(links)
    rows = lists.join(found.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("label"))
    rows = stored(rows, "labelled")
    apart = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    return stored(rows.join(apart, "token"), "lists")


def _star_pairs(rule: Rule, lists: DataFrame, number: int) -> DataFrame:
    """(a, b): every row of a list with one of its rows, in each round another one. A pair may meet in one list only, so places are no filter.

    The first one has the fewest rarer n-grams before the list's: of near copies of one text the one that was changed least, to which most link.
    """
    first = F.col("pos").cast("bigint") if number == 0 else F.xxhash64("id", F.lit(number))
    chosen = lists.groupBy("token").agg(F.min(F.struct(first.alias("by"), "id", "n", "pos", "label")).alias("x")).select("token", "x.*")
    l, r = chosen.alias("l"), lists.alias("r")
    met = l.join(r, F.col("l.token") == F.col("r.token")).where((F.col("l.label") != F.col("r.label")) & _long_enough(rule, "l", "r"))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def _other_pairs(rule: Rule, lists: DataFrame) -> DataFrame:
    """(a, b): all pairs of a list in different components that pass the filters; rows of a list's largest component only meet the others."""
    sizes = lists.groupBy("token", "label").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("rows", "label")).getField("label").alias("top"))
    with_top = lists.join(largest, "token").withColumn("others", F.col("label") != F.col("top"))
    l, r = with_top.where("others").alias("l"), with_top.alias("r")
    once = ~F.col("r.others") | (F.col("l.id") < F.col("r.id"))
    met = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.label") != F.col("r.label")) & once & _fits(rule, "l", "r"))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


# ---- verification ----


def _fetched(rule: Rule, df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(id, n, ranges, tokens) of the wanted sets (id, row, d1, d2), each taken from one row that has it; stored."""
    asked = small(wanted.withColumnRenamed("row", "row_"))

    def of(rows: DataFrame) -> DataFrame:
        return by_rows(rows.select("id", "d1", "d2", quoted(text).alias("text")), SETS, ("id", "d1", "d2", "text"), _fetching(rule))

    rows = df.join(asked, "row_")
    again = stored(rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "again")
    if again.limit(1).count() == 0:
        return stored(of(rows), "sets")
    alone, several = of(rows.join(again, "id", "left_anti")), of(rows.join(again, "id", "left_semi").dropDuplicates(["id", text]))
    return stored(alone.unionByName(several.dropDuplicates(["id"])), "sets")


def _may_link(rule: Rule, a: Column, b: Column, n: Column) -> Column:
    """Suffix filter, for two sets' counts by range and their sizes together: what differs inside single ranges of hashes cannot be common."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    return (rule.of + rule.part) * (n - apart) >= 2 * rule.part * n


def _linked(rule: Rule, a: Column, b: Column, n: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return (rule.of + rule.part) * both >= rule.part * n


def _verified(rule: Rule, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: first by the counts of ranges, then by the sets themselves, which only survivors fetch."""

    def looked_up(rows: DataFrame, column: str, judge: Callable) -> DataFrame:
        asked = stored(rows.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
        each = sets.select("id", "n", column).join(small(asked), "id", "left_semi")  # others are not moved
        both = rows.join(each.toDF("a", "n_a", "x"), "a").join(each.toDF("b", "n_b", "y"), "b")
        return both.where(judge(rule, F.col("x"), F.col("y"), F.col("n_a") + F.col("n_b"))).select("a", "b")

    possible = stored(looked_up(pairs, "ranges", _may_link), "possible")
    return stored(looked_up(possible, "tokens", _linked), "links")


# ---- the join ----


def similar_sets(df: DataFrame, text: str, sets: DataFrame, first_rows: DataFrame, common, rule: Rule, known: DataFrame) -> DataFrame:
    """(a, b): links between sets (id, d1, d2, n) that connect all pairs which meet the rule, and the links ``known`` before.

    Every prefix list is compared with one of its sets at first; lists whose rows are in one component by then are done. In the
    others all pairs of different components are compared that the filters leave. No pair is verified twice, and no link between
    components is lost, though a group of copies does not list all its pairs.
    """
    lists = _postings(rule, df, text, sets, common)
    wanted = stored(lists.select("id").distinct().join(first_rows, "id"), "wanted")
    fetched = _fetched(rule, df, text, wanted)
    links, tested = known, None
    for number in range(STARS + 1):
        lists = _labelled(lists.select("token", "id", "n", "pos"), links)
        pairs = _star_pairs(rule, lists, number) if number < STARS else _other_pairs(rule, lists)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = links.unionByName(_verified(rule, pairs, fetched))
    return links


def similar_documents(df: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set of n-grams and the smallest key that links lead to.

    Texts are taken whole. A null text, or one without words, has an empty set, which links with nothing, so that its component is its own key. Rows
    of one key with words are one document: their links count together. A null key takes no part and has a null component. Equal sets
    are joined once, whatever the number of their copies. Sets are kept as 64-bit hashes of n-grams, by which links are verified. An
    empty table gives no row; other columns do not matter. The key must be an integer column.
    """
    if df.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise ValueError(f"{key} must be an integer column")
    spark = df.sparkSession
    rows = df.select(quoted(key).cast("bigint").alias("row_"), quoted(text).alias("text"))
    marked = stored(rows.mapInArrow(_marking(rule.width), from_arrow_schema(MARKED)), "marked")
    common = spark.sparkContext.broadcast(_commonness(marked))
    each = marked.where("counter is null").drop("counter", "counts")
    keyed = each.where("row is not null and n > 0")
    sets = keyed.groupBy("d1", "d2", "n").agg(F.min("row").alias("row")).select(F.monotonically_increasing_id().alias("id"), "*")
    sets = stored(sets, "distinct")
    members = keyed.join(sets.select("id", "d1", "d2", "n"), ["d1", "d2", "n"]).select("row", "id")
    several = members.groupBy("row").agg(F.min("id").alias("a"), F.max("id").alias("high")).where("a < high").select("row", "a")
    known = stored(members.join(several, "row").select("a", F.col("id").alias("b")).where("a < b").distinct(), "links")
    links = similar_sets(rows.where("row_ is not null"), "text", sets, sets.select("id", "row", "d1", "d2"), common, rule, known)
    labels = components(links)
    grouped = stored(
        sets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "grouped"
    )
    least = grouped.groupBy("component").agg(F.min("row").alias("least"))
    ends = grouped.join(least, "component").select("d1", "d2", "n", "least")
    found = each.join(ends, ["d1", "d2", "n"], "left")
    component = F.when(F.col("row").isNotNull(), F.coalesce("least", "row"))
    return found.select(F.col("row").cast(df.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
