"""Chat formatting as a relational job, in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share a block; blocks are
concatenated from segments.  A segment is markup or one turn's text and says whether it is under the loss mask, so the
mask needs no offsets, and a conversation of any length costs one pass over its turns.

Template of a block: ``<|im_start|>role\\ntext<|im_next|>text...<|im_end|>\\n``.  A ``<|`` in a text, with any number of
backslashes between the two characters, gets one backslash more, so that control strings can't occur in texts and
reading back takes the backslash away again.  A line break in a role is written as ``<|im_nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, NEXT, END, BREAK = "<|im_start|>", "<|im_next|>", "<|im_end|>\n", "<|im_nl|>"

TURN = "struct<turn:long,role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def format_turns(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text,loss>>) for every conversation.

    Turns go by turn number (null first), ties by role and text; repeated rows are turns of their own.  Null role or
    text is empty; a null conv_id is one conversation.  An empty table gives an empty result.  A conversation is a
    value of one row by its nature; only its own turns are gathered there.  Other columns are not looked at.
    """
    one = F.struct(
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    gathered = turns.select(F.col(conv).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    before = F.concat(F.array(F.lit(None).cast(TURN)), F.slice("turns", 1, n - 1))
    after = F.concat(F.slice("turns", 2, n), F.array(F.lit(None).cast(TURN)))
    # (head, text, loss, tail) for each turn: the first of a block opens it and the last closes it
    near = F.arrays_zip(F.col("turns").alias("now"), before.alias("before"), after.alias("after"))

    def pieces(x: Column) -> Column:
        opens = ~x["now"]["role"].eqNullSafe(x["before"]["role"])
        closes = ~x["now"]["role"].eqNullSafe(x["after"]["role"])
        head = F.when(opens, F.concat(F.lit(START), escape_role(x["now"]["role"]), F.lit("\n"))).otherwise(F.lit(NEXT))
        mark = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(
            mark(head, F.lit(False)),
            mark(escape(x["now"]["text"]), x["now"]["role"] == learn),
            mark(F.when(closes, F.lit(END)).otherwise(F.lit("")), F.lit(False)),
        )

    parts = gathered.select("conv_id", near.alias("near")).select("conv_id", F.flatten(F.transform("near", pieces)).alias("segments"))
    shown = F.filter("segments", lambda s: (s["text"] != "") | s["loss"])
    return parts.select("conv_id", shown.alias("segments")).select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns of a formatted conversation, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2)
        texts = F.split(F.substr(body, F.lit(1), F.length(body) - len(END)), r"<\|im_next\|>")
        return F.transform(texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
