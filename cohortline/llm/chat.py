"""Conversations as training examples.

Method: prefix-target expansion. Every assistant turn becomes an example of its
own: all turns before it as context, and its reply as the only trainable text.
Turns that no reply follows are kept in an example without trainable text, so
that the whole conversation can be read back.

The template opens a turn with ``<|im_start|>role``, a line feed, and closes it with
``<|im_end|>`` and a line feed. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no control string of a text is one of the template;
in roles a line feed becomes a backslash and n. All of it is undone when read.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    """Undo ``escaped``; a backslash only ever stands before the sign it protects."""
    if role:  # doubled backslashes are set aside before the line feeds are undone
        text = F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\\\")
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), escaped(turn["role"], True), F.lit("\n"), escaped(turn["text"]), F.lit(END))


def expand(turns: DataFrame) -> DataFrame:
    """``(conv_id, example, formatted, loss_start, loss_length)`` from ``turns(conv_id, turn, role, text)``.

    ``example`` counts from 0 within a conversation. The trainable text is the
    ``loss_length`` code points of ``formatted`` from ``loss_start`` on (from 0); it is null where
    an example only keeps the turns that no reply follows. Null roles and texts are empty; turns are ordered by
    number (null first), role and text, repeated rows are turns of their own, and rows without conv_id are one
    conversation. Other columns are not looked at; an empty table gives no examples. A
    conversation is brought together, as an example holds all of it.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    count = F.size("turns")
    at = F.filter(F.sequence(F.lit(1), count), lambda k: (F.element_at("turns", k)["role"] == "assistant") | (k == count))
    examples = whole.select("conv_id", "turns", F.posexplode(at).alias("example", "upto")).withColumn("last", F.element_at("turns", F.col("upto")))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto") - 1), rendered), "")
    reply = escaped(F.col("last.text"))
    head = F.concat(context, F.lit(START), escaped(F.col("last.role"), True), F.lit("\n"))
    trained = F.col("last.role") == "assistant"
    return examples.select("conv_id", F.col("example").cast("long"), F.concat(head, reply, F.lit(END)).alias("formatted"),
                           F.when(trained, F.length(head)).cast("long").alias("loss_start"), F.when(trained, F.length(reply)).cast("long").alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss, formatted_chars)`` from the examples alone: the turns as they were, the trainable texts in order, and all code points formatted."""
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.sum(F.length("formatted")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))))).alias("trained"))
    pieces = F.filter(F.split("longest", r"<\|im_start\|>", -1), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(p, "\n", 1), True).alias("role"),
        unescaped(F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END))).alias("text")))
    return per.select("conv_id", turns.alias("turns"), F.array_join(F.transform("trained", lambda t: t["text"]), "").alias("loss"), "formatted_chars")
