"""Chat formatting with Spark expressions only, reversible, with a loss mask.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Adjacent turns of one role are merged into
one block, their texts set apart by ``<|im_next|>``.  Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so a control string can't occur there; in roles a line feed becomes ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Undo escaped_role: a line feed is the only single backslash before an n."""
    marked = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescaped(marked)


def format_conversations(turns: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """One row per conv_id: ``formatted`` and its ``pieces``, an array of (text, loss).

    The pieces put together are ``formatted``; loss is true for the texts of the learned role alone.
    Turns are ordered by turn, then role and text, so repeated rows and ties give one defined order and
    all of them stay; a null turn comes first.  Null role and null text count as empty; rows without
    conv_id form one conversation with a null conv_id.  An empty table gives no rows.  A conversation is
    one output row, so its turns meet in one task: that is the only group collected.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    first = F.col("turns")

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(t: Column, i: Column) -> Column:
        before = F.get(first, i - 1)["role"]
        after = F.get(first, i + 1)["role"]
        head = F.when(before.eqNullSafe(t["role"]), F.lit(NEXT)).otherwise(
            F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
        )
        tail = F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END + "\n"))
        return F.array(
            piece(head, F.lit(False)),
            piece(escaped(t["text"]), t["role"] == F.lit(learned)),
            piece(tail, F.lit(False)),
        )

    pieces = ordered.select("conv_id", F.flatten(F.transform(first, block)).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.filter("pieces", lambda p: F.length(p["text"]) > 0).alias("pieces"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        body = F.substring(b, F.lit(len(START) + 1), F.length(b))
        role = F.substring_index(body, "\n", 1)
        texts = F.substring(body, F.length(role) + 2, F.length(body))
        return F.transform(
            F.split(texts, r"<\|im_next\|>"),
            lambda x: F.struct(unescaped_role(role).alias("role"), unescaped(x).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, put together."""
    return F.array_join(
        F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"])), ""
    )


def digest_conversations(turns: DataFrame) -> DataFrame:
    """What formatted conversations hold when they are read back."""
    read = format_conversations(turns).select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("pieces")).alias("loss")
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
