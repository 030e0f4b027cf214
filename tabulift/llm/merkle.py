"""Merkle manifest: a content-addressed tree over every group of rows, one tree over the groups, and proofs by descent from the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tabulift.llm.common import as_schema, free_name, quoted, stored

#: Consecutive nodes that become one.
FAN = 3
#: Levels of one page of records, which holds at most FAN ** HEIGHT bottom nodes and half as many records.
HEIGHT = 6
WIDTH = FAN**HEIGHT
SIZE = 32
PAGE = "group string, block bigint, n bigint, height int, digest binary, records array<struct<digest: binary, children: binary>>"
BATCH_BYTES = 1 << 22


# ---- digests: lowercase hexadecimal text where they are hashed, 32 bytes where they are kept ----


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


def _height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def _page(leaves: list[bytes], height: int) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """The node that stands ``height`` levels above the leaves, and the records (digest, children) of all nodes up to it."""
    records, level = [], leaves
    for _ in range(height):
        above = [b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        level = [_parent(children) for children in above]
        records += zip(level, above)
    return level[0], records


def _descent(records: dict[bytes, bytes], top: bytes, place: int, height: int) -> tuple[bytes, bytes, bytes]:
    """From the top to the bottom node at ``place`` by its digits: that node, the unselected children and the steps, from the bottom up."""
    node, others, steps = top, [], []
    for level in reversed(range(height)):
        children, digit = records[node], place // FAN**level % FAN
        node = children[SIZE * digit : SIZE * (digit + 1)]
        others.append(children[: SIZE * digit] + children[SIZE * (digit + 1) :])
        steps.append(4 * digit + len(children) // SIZE - 1)
    return node, b"".join(reversed(others)), bytes(reversed(steps))


def fold(leaf: bytes, siblings: bytes, steps: bytes) -> bytes:
    """The root that a leaf and its proof lead to. A step is four times the number of siblings before the node, plus their number."""
    node, at = leaf, 0
    for step in steps:
        before, end = at + SIZE * (step >> 2), at + SIZE * (step & 3)
        node = _parent(siblings[at:before] + node + siblings[before:end])
        at = end
    return node


@F.arrow_udf(BinaryType())
def folded(leaf: pa.Array, siblings: pa.Array, steps: pa.Array) -> pa.Array:
    """``fold`` of each row; null for a null leaf."""
    rows = zip(leaf.to_pylist(), siblings.to_pylist(), steps.to_pylist())
    return pa.array([None if x is None else fold(x, s, p) for x, s, p in rows], pa.binary())


# ---- building: pages of records, a few levels at a time ----


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``low``, the rows of the group before this one (each counts ``copies`` times), and ``n``, all rows of the group.

    Rows are sorted over ranges and written; a window runs inside each range and group, and totals of earlier ranges are added, so
    that a group which holds most rows is spread over the ranges.
    """
    sorted_ = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    kept = stored(sorted_.withColumn("range", F.spark_partition_id()), "ranges")
    totals = kept.groupBy("group", "range").agg(F.sum("copies").alias("here"))
    by_group = Window.partitionBy("group")
    earlier = by_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("group").alias("g"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("offset"),
        F.sum("here").over(by_group).alias("n"),
    )
    before = Window.partitionBy("group", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = kept.withColumn("own", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    joined = numbered.join(offsets, F.col("group").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return joined.withColumn("low", F.col("own") + F.col("offset")).drop("g", "r", "range", "own", "offset")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of WIDTH ranks that the copies of a row reach, with the ranks ``low`` to ``high`` inside it."""
    last = F.col("low") + F.col("copies") - 1
    blocks = F.sequence(F.floor(F.col("low") / WIDTH), F.floor(last / WIDTH))
    split = rows.withColumn("last", last).withColumn("block", F.explode(blocks))
    low, high = F.greatest("low", F.col("block") * WIDTH), F.least("last", (F.col("block") + 1) * WIDTH - 1)
    return split.withColumn("high", high).withColumn("low", low).drop("last", "copies")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES from (size, row) pairs."""
    held, size = [], 0
    for more, row in rows:
        held.append(row)
        size += more
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _paged(schema: pa.Schema):
    """Pages of the nodes that come in order of group, block and rank."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (group, block, n), rows in groupby(_rows_of(batches), key=lambda row: row[:3]):
            leaves = [digest for *_, low, high, digest in rows for _ in range(high - low + 1)]
            height = HEIGHT if n > WIDTH else _height(n)
            top, records = _page(leaves, height)
            yield 100 * len(records) + 100, (group, block, n, height, top, [{"digest": d, "children": c} for d, c in records])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(pages(batches), schema)

    return run


def _tree(leaves: DataFrame) -> list[DataFrame]:
    """Pages from the bottom up, for rows (group, block, low, high, n, digest): each segment's tops are the bottom of the next one."""
    segments, schema = [], as_schema(PAGE)
    while True:
        rows = leaves.select("group", "block", "n", "low", "high", "digest")
        placed = rows.repartition("group", "block").sortWithinPartitions("group", "block", "low")
        pages = stored(placed.mapInArrow(_paged(to_arrow_schema(schema)), schema), "pages")
        segments.append(pages)
        if pages.where(F.col("n") > WIDTH).limit(1).count() == 0:
            return segments
        above = pages.where(F.col("n") > WIDTH).select("group", F.col("block").alias("low"), F.lit(1).alias("copies"), "digest", "n")
        leaves = _in_blocks(above.withColumn("n", F.ceil(F.col("n") / WIDTH)))


def _tops(segments: list[DataFrame]) -> DataFrame:
    """(group, digest, segment): the one node of each group that is left at the end, and the segment in which that is."""
    parts = [pages.where(F.col("n") <= WIDTH).select("group", "digest", F.lit(i).alias("segment")) for i, pages in enumerate(segments)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@dataclass(frozen=True)
class Manifest:
    """The stored trees: pages of records of the groups' trees and of the tree over the groups, bottom segments first, and the leaves."""

    leaves: DataFrame
    segments: list[DataFrame]
    over: list[DataFrame]

    def subroots(self) -> DataFrame:
        """(group, digest) of every group's tree."""
        return _tops(self.segments).select("group", "digest")

    def root(self) -> DataFrame:
        """(digest,) of the whole table; no row for an empty one."""
        return _tops(self.over).select("digest")

    def records(self) -> DataFrame:
        """(digest, children): every inner node once, with its children's digests one after the other."""
        whole = None
        for pages in [*self.segments, *self.over]:
            part = pages.select(F.explode("records").alias("record")).select("record.*")
            whole = part if whole is None else whole.unionByName(part)
        return whole.distinct()


def manifest(df: DataFrame, leaf: Column, by: str, order: str, carry: tuple[str, ...] = ()) -> Manifest:
    """Trees over the leaves (32 bytes) of every group of ``by``, ascending by ``order``, and a tree over the groups in their order.

    While several nodes remain, every three consecutive ones (the last run: fewer, even one) become the digest of their digests as
    hexadecimal text. A lone leaf is its own root. Nulls of ``by`` are one group, the first; nulls of ``order`` come first. Equal keys
    are ordered by leaf and then by the columns of ``carry``; equal rows count once each, in places next to each other. ``by`` is compared as UTF-8 bytes.
    Equal rows are counted before they are shuffled, and no group needs one task.
    """
    named = df.select(
        quoted(by).cast("string").alias("group"), quoted(order).alias("place"), leaf.alias("digest"), F.struct(*[quoted(c) for c in carry], F.lit(0).alias("none_")).alias("held")
    )
    counted = named.groupBy("group", "place", "digest", "held").agg(F.count("*").alias("copies"))
    leaves = stored(_in_blocks(_ranked(counted, ["place", "digest", "held"])), "leaves")
    segments = _tree(leaves)
    tops = _tops(segments).select(F.lit(None).cast("string").alias("group"), F.col("group").alias("place"), "digest", F.lit(1).alias("copies"))
    over = _tree(_in_blocks(_ranked(tops, ["place"])).withColumnRenamed("place", "name"))
    return Manifest(leaves, segments, over)


# ---- proofs: descent from the root ----

_NODE = [StructField("rank", LongType()), StructField("digest", BinaryType()), StructField("siblings", BinaryType()), StructField("steps", BinaryType())]


def _descend(frontier: DataFrame, pages: DataFrame, requests: DataFrame, kept: list[str]) -> DataFrame:
    """From each node of the frontier (group, block, digest, siblings, steps and the columns ``kept``) to the requested ranks below it.

    The node's digest finds its page. Requests (group, block, low, high, held) meet it by their block, at most WIDTH ranks at once. Of a page that many
    equal nodes share one is kept and joined to them all.
    """
    page = pages.groupBy("digest").agg(F.first("height").alias("height"), F.first("records").alias("records"))
    opened = frontier.join(page, "digest").withColumn("asked", F.lit(False))
    asked = requests.select("group", "block", "low", "high", "held").withColumn("asked", F.lit(True))
    columns = ["group", "block", "asked", "low", "high", "held", "digest", "siblings", "steps", "height", "records", *kept]
    both = opened.unionByName(asked, allowMissingColumns=True).select(*columns)
    fields = {f.name: f for f in both.schema.fields}
    schema = StructType([fields["group"], *_NODE, fields["held"], *(fields[k] for k in kept)])

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            open_, records = None, {}
            for row in _rows_of(batches):
                group, block, is_request, low, high, held, digest, siblings, steps, height, stored_, *more = row
                if not is_request:
                    open_ = (digest, height, siblings, steps, more)
                    records = {r["digest"]: r["children"] for r in stored_}
                    continue
                top, height, siblings, steps, more = open_
                for rank in range(low, high + 1):
                    node, others, turns = _descent(records, top, rank - block * WIDTH, height)
                    yield 200 + len(others) + len(siblings), (group, rank, node, others + siblings, turns + steps, held, *more)

        return _batches(found(), out)

    return both.repartition("group", "block").sortWithinPartitions("group", "block", "asked", "low").mapInArrow(run, schema)


def _requests(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Requests of every segment: the leaves, then, for each segment above, the blocks that are asked for below."""
    found = [leaves]
    for _ in range(levels - 1):
        below = found[-1].where(F.col("n") > WIDTH).select("group", "block", F.ceil(F.col("n") / WIDTH).alias("n")).distinct()
        here = below.select("group", F.col("block").alias("low"), F.lit(1).alias("copies"), "n", F.lit(None).alias("held"))
        found.append(_in_blocks(here))
    return found


def _proven(segments: list[DataFrame], leaves: DataFrame, tops: DataFrame, kept: list[str]) -> DataFrame:
    """The leaves with their paths, for tops (group, segment, digest, siblings, steps and ``kept``)."""
    requests, frontier = _requests(leaves, len(segments)), None
    for i in reversed(range(len(segments))):
        nodes = tops.where(F.col("segment") == i).withColumn("block", F.lit(0).cast("bigint")).drop("segment")
        if frontier is not None:
            nodes = nodes.unionByName(frontier.select("group", F.col("rank").alias("block"), "digest", "siblings", "steps", *kept))
        frontier = _descend(nodes, segments[i], requests[i], kept)
        if i:
            frontier = stored(frontier, "frontier")
    return frontier


def proofs(tree: Manifest) -> DataFrame:
    """(group, rank, digest, siblings, steps, held, subroot, root): every leaf with its proof, from its own level up to the root.

    ``siblings`` are the digests of the other nodes of each run, left to right, 32 bytes each; ``steps`` has one byte a level (see ``fold``). Requests
    descend from the root by the digits of their rank, all requests below a node together until they part, and a page of records
    answers several levels at once; segments of the path are reversed on the way.
    """
    empty = F.lit(b"")
    start = _tops(tree.over).select("group", "segment", "digest", empty.alias("siblings"), empty.alias("steps"), F.col("digest").alias("root"))
    tops = _tops(tree.segments)
    names = _in_blocks(_ranked(tops.select(F.lit(None).cast("string").alias("group"), F.col("group").alias("place"), F.lit(1).alias("copies")), ["place"]))
    asked = names.withColumn("held", F.struct(F.col("place").alias("name")))
    above = _proven(tree.over, asked, start, ["root"])
    ways = above.select(F.col("held.name").alias("name"), "siblings", "steps", "root", F.col("digest").alias("subroot"))
    starts = stored(tops.join(ways, F.col("group").eqNullSafe(F.col("name"))).drop("name"), "subroots")
    return _proven(tree.segments, tree.leaves, starts, ["subroot", "root"])


def prove(df: DataFrame, leaf: Column, by: str, order: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(order, by, the columns of ``carry``, leaf, subroot, root as hexadecimal text, rank, siblings, steps): the proof of every row of the table.

    As ``manifest`` and ``proofs`` say. Each row has a proof of its own, equal rows too; an empty table gives no row. A column of ``carry`` that has
    the name of a new one keeps it, and the new one gets underscores.
    """
    found = proofs(manifest(df, leaf, by, order, (order, *(c for c in carry if c != order))))
    out = [F.col("held").getField(order).alias(order), F.col("group").alias(by), *[F.col("held").getField(c).alias(c) for c in carry if c not in (order, by)]]
    taken = df.select(*{order, by, *carry})
    new = {"leaf": as_hex(F.col("digest")), "subroot": as_hex(F.col("subroot")), "root": as_hex(F.col("root"))}
    new |= {c: F.col(c) for c in ("rank", "siblings", "steps")}
    return found.select(*out, *[value.alias(free_name(taken, name)) for name, value in new.items()])
