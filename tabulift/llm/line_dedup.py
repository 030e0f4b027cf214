"""Line dedup: drop every line within one edit of an earlier line, by a join of deletion variants. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulift.llm.common import free_name, quoted, small, stored

#: Edit distance up to which two lines are copies.
EDITS = 1
#: Blocks that a line is cut into before single characters are deleted, and again while those of a key can be longer than LONGEST.
BLOCKS = 4
LONGEST = 64


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.where(quoted(key).isNotNull()).select(quoted(key).alias("doc"), F.posexplode(F.split(quoted(text), "\n", -1)).alias("line_no", "line"))
    return rows.where("line <> ''")


def _step(n: Column) -> Column:
    return F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(n)) - 4).cast("int"))


def _grid(n: Column) -> Column:
    """A length of at most n: n itself for short lines, else at most a sixteenth shorter, so that nearly all lines of similar length share it."""
    return n - F.pmod(n, _step(n))


def _block_variants(line: Column, key: Column | None = None) -> Column:
    """Array of (key, head, size, long): the variants that delete one block, as hashed keys, and where the window stands.

    For two strings one edit apart, base is the grid length of the shorter one; each string emits the bases of its own
    length and, where it differs, of one character less. Block j of a base g leaves the first floor(j g / 4) characters
    and the last g - floor((j + 1) g / 4), so the string around some block is equal in both. The window is what was deleted.
    It is long if a window of this base and block can exceed LONGEST: all windows of a key are long or none, so both
    strings of a pair go the same way.
    """
    n = F.char_length(line)
    bases = F.array_distinct(F.array(_grid(n), F.when(n > 1, _grid(n - 1)).otherwise(_grid(n))))

    def of(base: Column, j: int) -> Column:
        head = F.floor(base * j / BLOCKS).cast("int")
        tail = base - F.floor(base * (j + 1) / BLOCKS).cast("int")
        around = [base, F.lit(j), F.substr(line, F.lit(1), head), F.substr(line, n - tail + 1, tail)]
        return F.struct(
            F.xxhash64(*([key] if key is not None else []), *around).alias("key"),
            head.alias("head"),
            (n - head - tail).alias("size"),
            (base - head - tail + _step(base) > LONGEST).alias("long"),
        )

    return F.flatten(F.transform(bases, lambda base: F.array(*[of(base, j) for j in range(BLOCKS)])))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key at least two lines have."""
    keys = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    return rows.join(small(keys), "key", "left_semi")


def copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(first lines, near copies), both stored.

    First lines are (doc, line_no, keys) of the earliest place of each distinct line. Near copies are (doc, line_no,
    of_doc, of_line_no): first lines with an earlier line within one edit, and the earliest such line that was met.

    Variants are emitted in two steps, so that their number stays near that of the lines. First whole blocks are
    deleted: a line has a partner only if some variant's key is shared, and only what was deleted is looked at further. Then every
    single character of those short windows is deleted. Two windows within one edit are equal after one
    deletion in the longer, or after deleting the same place in both; windows are joined on such variants, the
    partner is the earliest, found by a grouped minimum, and its edit distance is verified. No group is paired with itself.
    """
    lines = _lines(df, key, text)
    line = F.col("line")
    hashed = lines.select("doc", "line_no", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("h2"), _block_variants(line).alias("variants"))
    earliest = hashed.groupBy("h", "h2").agg(F.min(F.struct("doc", "line_no")).alias("at"), F.any_value("variants").alias("variants"))
    firsts = stored(earliest.select("at.doc", "at.line_no", "variants"), "lines")
    spread = firsts.select("doc", "line_no", F.inline("variants"))
    places = stored(_shared(spread), "places")
    windows = stored(
        lines.join(small(places), ["doc", "line_no"]).select("doc", "line_no", "key", "long", F.substr("line", F.col("head") + 1, F.col("size")).alias("w")),
        "windows",
    )
    while not windows.where("long").isEmpty():
        parts = windows.where("long").select("doc", "line_no", "w", F.inline(_block_variants(F.col("w"), F.col("key"))))
        cut = parts.select("doc", "line_no", "key", "long", F.substr("w", F.col("head") + 1, F.col("size")).alias("w"))
        windows = stored(windows.where("not long").unionByName(_shared(stored(cut, "parts"))), "windows")
    return firsts, stored(_near(windows), "near")


def _near(windows: DataFrame) -> DataFrame:
    w, i = F.col("w"), F.col("i")
    at = F.sequence(F.lit(0), F.char_length(w))
    variant = F.when(i == 0, w).otherwise(F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.char_length(w))))
    own = F.struct("doc", "line_no", "w")
    emitted = (
        windows.select("doc", "line_no", "key", "w", F.explode(at).alias("i"))
        .select(F.xxhash64("key", variant).alias("k"), F.xxhash64(F.lit(1), "key", variant).alias("k2"), "i", own.alias("own"))
    )
    emitted = stored(emitted, "variants")
    same_place = emitted.groupBy("k", "k2", "i").agg(F.min("own").alias("there"))
    either = same_place.groupBy("k", "k2").agg(
        F.min(F.when(i == 0, F.col("there"))).alias("whole"), F.min(F.when(i > 0, F.col("there"))).alias("cut"), F.count("*").alias("places")
    )
    met = emitted.join(same_place, ["k", "k2", "i"]).join(either, ["k", "k2"])
    partners = F.when(i == 0, F.array("cut")).otherwise(F.array("there", "whole"))
    found = met.select("own", F.explode(partners).alias("of")).where("of is not null")
    earlier = F.struct(F.col("of.doc"), F.col("of.line_no")) < F.struct(F.col("own.doc"), F.col("own.line_no"))
    verified = found.where(earlier & (F.levenshtein("own.w", "of.w") <= EDITS))
    return (
        verified.groupBy("own.doc", "own.line_no")
        .agg(F.min(F.struct("of.doc", "of.line_no")).alias("of"))
        .select("doc", "line_no", F.col("of.doc").alias("of_doc"), F.col("of.line_no").alias("of_line_no"))
    )


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with, in ``text``, only the lines that are not within one edit of an earlier line, and n_lines and n_removed.

    A line is what stands between line breaks. Earlier means a smaller key or, within a document, a
    smaller line number; lines are judged on the input, not on what is left. Empty lines take no part and stay. A text all of
    whose lines go is empty. Null texts stay null, with no lines; rows with a null key take no part and stay as they are.
    Rows with the same key are one document: each keeps the lines whose place counts as first. Other columns stay; the two counts get
    underscores if a column has their name. Edit distance counts code points.
    """
    firsts, near = copies(df, key, text)
    kept = firsts.select("doc", "line_no").join(small(near.select("doc", "line_no")), ["doc", "line_no"], "left_anti")
    return _apply(df, kept.groupBy("doc").agg(F.collect_list("line_no").alias("kept")), key, text)


def _apply(df: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    names = {n: free_name(df, n) for n in ("doc", "kept", "lines", "places", "n_lines", "n_removed")}
    kept = kept.select(F.col("doc").alias(names["doc"]), F.col("kept").alias(names["kept"]))
    lines, places = quoted(names["lines"]), quoted(names["places"])
    empty = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.element_at(lines, i + 1) == "")
    stays = F.array_sort(F.array_union(empty, F.coalesce(quoted(names["kept"]), F.array().cast("array<int>"))))
    joined = df.join(kept, quoted(key) == quoted(names["doc"]), "left").withColumn(names["lines"], F.split(quoted(text), "\n", -1))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    placed = joined.withColumn(names["places"], F.when(quoted(key).isNull(), every).otherwise(F.array_intersect(stays, every)))
    left = F.array_join(F.transform(places, lambda i: F.element_at(lines, i + 1)), "\n")
    return (
        placed.withColumn(names["n_lines"], F.when(lines.isNull(), 0).otherwise(F.size(lines)))
        .withColumn(names["n_removed"], F.when(lines.isNull(), 0).otherwise(F.size(lines) - F.size(places)))
        .withColumn(text, F.when(quoted(text).isNull(), F.lit(None)).otherwise(left))
        .drop(names["doc"], names["kept"], names["lines"], names["places"])
    )
