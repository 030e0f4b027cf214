"""Chat formatting: every assistant turn becomes an example whose context is all turns before it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabulift.llm.common import quoted
from tabulift.plans.ranks import running_totals

# The marks of the template. A turn is START role HEAD text END.
START = "<|im_start|>"
HEAD = "\n"
END = "<|im_end|>\n"

#: Bounds of the ordering value that cuts conversations into ranges: the largest doubles.
FAR = 1.7976931348623157e308


def escaped(text):
    """A column in which no mark begins: every ``<`` that backslashes and ``|`` follow gets one more backslash."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def escaped_role(role):
    """As ``escaped``, and without line breaks, so that the header ends at the first one."""
    plain = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escaped(F.replace(plain, F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def examples(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, example, n, context_chars, delta, loss_start, loss_end): one row for every formatted turn, the n-th of its conversation.

    An example's text is all formatted turns up to and including its reply. Each row holds one turn (``delta``), the
    number of the example that it first stands in, and where it stands: ``context_chars`` code points come before. So the
    rows of a conversation grow with its length, not with its square; ``expand`` writes whole texts. ``loss_start`` and
    ``loss_end`` (code points in the whole text) enclose a reply, the only trainable part; they are null for other turns.

    No conversation is collected: running totals are taken over ranges of the turn and added up, so one that holds
    most rows is spread over tasks, unless its turns are equal or no numbers.

    Rows are taken by turn, then role, then text; repeated rows are turns of their own. Null roles and texts are empty, a
    null turn comes first, a null key is a conversation of its own. Only the role ``assistant`` is a reply. An empty table gives none.
    """
    rows = df.select(quoted(key).alias("key_"), quoted(turn).alias("turn_"), quoted(role).alias("role_"), quoted(text).alias("text_"))
    number = isinstance(rows.schema["turn_"].dataType, NumericType)
    place = F.greatest(F.least(F.coalesce(F.col("turn_").cast("double"), F.lit(-FAR)), F.lit(FAR)), F.lit(-FAR)) if number else F.lit(0.0)
    head = F.concat(F.lit(START), escaped_role(F.col("role_")), F.lit(HEAD))
    body = escaped(F.col("text_"))
    turns = rows.select(
        "*",
        place.alias("place_"),
        F.lit(1).cast("bigint").alias("one_"),
        F.coalesce(F.col("role_") == "assistant", F.lit(False)).cast("bigint").alias("reply_"),
        F.length(body).cast("bigint").alias("size_"),
        F.length(F.concat(head, body, F.lit(END))).cast("bigint").alias("chars_"),
    )
    sums = {"one_": "before_", "reply_": "example", "chars_": "context_chars"}
    placed = running_totals(turns, "place_", sums, by=["key_"], then=["turn_", "role_", "text_"])
    reply, stop = F.col("reply_") == 1, F.col("context_chars") + F.col("chars_") - len(END)
    return placed.select(
        F.col("key_").alias(key),
        "example",
        (F.col("before_") + 1).alias("n"),
        "context_chars",
        F.concat(head, body, F.lit(END)).alias("delta"),
        F.when(reply, stop - F.col("size_")).alias("loss_start"),
        F.when(reply, stop).alias("loss_end"),
    )


def whole_texts(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, example, n, text, loss_start, loss_end, last): the whole text of every example, and of every conversation.

    The row of a reply holds its example, all turns up to and including the reply; the row with ``last`` holds all turns of its conversation,
    also those behind the last reply, and is both where a conversation ends with a reply.
    """
    in_turn = Window.partitionBy(key).orderBy("n")
    before = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("last", F.lead("n").over(in_turn).isNull()).withColumn("so_far", F.collect_list("delta").over(before))
    return marked.where("last or loss_end is not null").select(
        key, "example", "n", F.array_join("so_far", "").alias("text"), "loss_start", "loss_end", "last"
    )


def expand(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, example, text, loss_start, loss_end): the whole text of every example that has a reply.

    What this writes grows with the square of a conversation's turns, as the training examples themselves do.
    """
    return whole_texts(rows, key).where("loss_end is not null").select(key, "example", "text", "loss_start", "loss_end")
