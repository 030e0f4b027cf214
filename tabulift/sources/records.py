"""Records of CSV files whose quoted cells may hold line breaks, read by many tasks a file.

A file is read by byte ranges, each cut at line ends. Whether a range starts inside a quoted cell depends on all that stands before it.
So the first pass reads every range under both assumptions and keeps, for each, only the state at its end and the pieces of
records that reach over its ends. The states are then put together along each file, and the second pass cuts every range into records
from its true state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulift.plans.scratch import scratch_path

QUOTE, DELIMITER = '"', ","
#: Kinds of pieces: a whole record, the header, the end of a record begun before, a range inside one record, and the beginning of a record.
WHOLE, HEADER, ENDING, INSIDE, BEGINNING = range(5)
#: Characters of a piece that the first pass keeps; longer ones are read again.
KEPT_CHARS = 1 << 20

_ENDS = "file string, at bigint, assumed int, ends int, pieces array<struct<kind: int, text: string>>, long boolean"
_PIECES = "file string, at bigint, kind int, text string"


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind the line, if one is open before it.

    A quote opens a cell only at the cell's beginning; two quotes inside stand for one; behind a closing quote the cell goes on to the next delimiter.
    """
    i = 0
    while True:
        if not inside:
            if not line.startswith(QUOTE, i):
                i = line.find(DELIMITER + QUOTE, i)
                if i < 0:
                    return False
                i += 1
            i += 1
        while True:
            i = line.find(QUOTE, i)
            if i < 0:
                return True
            if not line.startswith(QUOTE, i + 1):
                break
            i += 2
        i = line.find(DELIMITER, i)
        if i < 0:
            return False
        i, inside = i + 1, False


class Cutter:
    """Cuts the lines of one range into pieces of records, from a state at its beginning."""

    def __init__(self, inside: bool, first: bool, most: int | None = None):
        self.inside, self.before, self.header, self.most = inside, inside, first, most
        self.held, self.size, self.long = [], 0, False

    def line(self, line: str) -> tuple[int, str] | None:
        """The piece that ends with this line, if one does."""
        after = inside_after(line, self.inside) if QUOTE in line else self.inside
        if self.inside or after:
            self.size += len(line)
            if self.most is not None and self.size > self.most:
                self.long = True
            else:
                self.held.append(line)
        self.inside = after
        if after:
            return None
        text = "\n".join(self.held) if self.held else line
        kind = ENDING if self.before else WHOLE
        self.held, self.size, self.before = [], 0, False
        if kind == WHOLE and self.header and text.strip("\r"):
            kind, self.header = HEADER, False
        return kind, text

    def end(self) -> tuple[int, str] | None:
        if not self.inside:
            return None
        return (INSIDE if self.before else BEGINNING), "\n".join(self.held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, more in rows:
        held.append(row)
        size += more + 50
        if size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _both_ways(schema: pa.Schema):
    """For every range (file, at) and both states at its beginning: the state at its end, and the pieces that reach over its ends."""

    def ended(key: tuple, cutters: tuple, pieces: tuple) -> Iterator[tuple]:
        for assumed, (cutter, found) in enumerate(zip(cutters, pieces)):
            last = cutter.end()
            kept = [{"kind": k, "text": t} for k, t in [*found, *([last] if last else [])]]
            yield (*key, assumed, int(cutter.inside), [] if cutter.long else kept, cutter.long), sum(len(p["text"]) for p in kept)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, cutters, pieces = None, (), ()
        for file, at, line in _rows(batches):
            if (file, at) != now:
                if now:
                    yield from ended(now, cutters, pieces)
                now, pieces = (file, at), ([], [])
                cutters = tuple(Cutter(bool(s), at == 0, KEPT_CHARS) for s in (0, 1))
            for cutter, found in zip(cutters, pieces):
                piece = cutter.line(line)
                if piece and piece[0] == ENDING:
                    found.append(piece)
        if now:
            yield from ended(now, cutters, pieces)

    return lambda batches: _in_batches(ranges(batches), schema)


def _pieces(schema: pa.Schema):
    """All pieces of every range, from its true state."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, cutter = None, None
        for file, at, line, inside in _rows(batches):
            if (file, at) != now:
                if now and (piece := cutter.end()):
                    yield (*now, *piece), len(piece[1])
                now, cutter = (file, at), Cutter(bool(inside), at == 0)
            if piece := cutter.line(line):
                yield (*now, *piece), len(piece[1])
        if now and (piece := cutter.end()):
            yield (*now, *piece), len(piece[1])

    return lambda batches: _in_batches(cut(batches), schema)


def _states(ends: DataFrame) -> DataFrame:
    """(file, at, inside): the true state at the beginning of every range.

    A range turns the state around, leaves it, or ends in one state whatever it was. So the state is that behind the last range of the last
    kind, turned as often as ranges between do; a file begins outside.
    """
    both = ends.groupBy("file", "at").agg(
        F.max(F.when(F.col("assumed") == 0, F.col("ends"))).alias("e0"), F.max(F.when(F.col("assumed") == 1, F.col("ends"))).alias("e1")
    )
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("turns", F.coalesce(F.sum(((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int")).over(before), F.lit(0)))
    fixed = F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("state"), F.col("turns")))
    known = counted.withColumn("last", F.last(fixed, ignorenulls=True).over(before))
    turned = F.col("turns") - F.coalesce("last.turns", F.lit(0))
    return known.select("file", "at", ((F.coalesce("last.state", F.lit(0)) + turned) % 2).cast("int").alias("inside"))


def _across(pieces: DataFrame) -> DataFrame:
    """The records that reach over the end of a range, put together from their pieces."""
    in_file = Window.partitionBy("file").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("place", F.col("kind")).where(F.col("kind") >= ENDING)  # in a range, the end of a record comes before the beginning of another
    owned = placed.select("file", "at", "place").withColumn("record", F.sum((F.col("place") == BEGINNING).cast("int")).over(in_file))
    joined = placed.join(owned, ["file", "at", "place"])
    texts = joined.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "place", "text"))).alias("parts"))
    return texts.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(text,): every record of CSV files but each file's header and empty records; no order.

    Lines end with a line feed, with or without a carriage return before it, which goes at the end of a record. The pass over the ranges
    sends two short rows a range; of these, the states (one row for each range that begins inside a cell) are broadcast: about a hundred bytes
    for each ``spark.sql.files.maxPartitionBytes`` of input.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line")
    )
    ends_schema, pieces_schema = _schema(_ENDS), _schema(_PIECES)
    place = scratch_path(spark, "ranges")
    lines.mapInArrow(_both_ways(ends_schema), _ENDS).write.parquet(place)
    ends = spark.read.schema(_ENDS).parquet(place)
    states = _states(ends)
    inside = states.where("inside = 1")
    cut = lines.join(F.broadcast(inside), ["file", "at"], "left").mapInArrow(_pieces(pieces_schema), _PIECES)
    true = ends.join(states.withColumnRenamed("inside", "assumed"), ["file", "at", "assumed"])
    if true.where("long").limit(1).count():
        reaching = cut.where(F.col("kind") >= ENDING)
    else:
        reaching = true.select("file", "at", F.inline("pieces"))
    text = F.regexp_replace("text", r"\r$", "")
    records = cut.where(F.col("kind") == WHOLE).select("text").unionByName(_across(reaching))
    return records.select(text.alias("text")).where(F.col("text") != "")


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
