"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role are
merged into one message, and everything is concatenated. The template::

    <|im_start|>role\ntext<|im_next|>text of the same role<|im_end|>\n ...

Control strings inside a text or role get one escape character after their
first character (or one more, if they had some), which never yields a control
string and is undone exactly by taking one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
#: An opening bracket, escapes, and the rest of a control string of this template or of another common one.
CONTROL = r"([<\[])(\\*)(\|im_(?:start|next|end)\|>|/?s>|/?INST\]|/?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\|im_(?:start|next|end)\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def escape_role(role: Column) -> Column:
    """As escape, and with no line break, for a line break ends the role."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``: conv_id, formatted, pieces.

    ``pieces`` cuts ``formatted`` into array<struct<piece, loss>>: the pieces
    with loss are exactly the texts of ``trained_role``. Turns are ordered by
    turn (nulls first), ties by role, then text. A null role or text counts as
    empty; a null conv_id is a conversation of its own; repeated rows are turns
    of their own; an empty table has no conversations. Other columns are not
    read. A conversation's turns meet in one row, for they make one string.
    """
    cleaned = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    grouped = cleaned.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def pieces_of(turn: Column, at: Column) -> Column:
        before = F.try_element_at("turns", F.when(at > 0, at).otherwise(F.lit(None)))  # 1-based: the one before
        after = F.try_element_at("turns", at + 2)
        opens = before.isNull() | (before["role"] != turn["role"])
        ends = after.isNull() | (after["role"] != turn["role"])
        head = F.when(opens, F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"))).otherwise(F.lit(NEXT))
        tail = F.when(ends, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.array(
            F.struct(head.alias("piece"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("piece"), (turn["role"] == trained_role).alias("loss")),
            F.struct(tail.alias("piece"), F.lit(False).alias("loss")),
        )

    pieces = F.filter(F.flatten(F.transform("turns", pieces_of)), lambda p: F.length(p["piece"]) > 0)
    return grouped.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces"
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Turns and loss text of formatted conversations: conv_id, turns array<struct<role, text>>, loss_text."""
    # each message without its end mark; the last cut is empty
    messages = F.slice(
        F.split("formatted", r"<\|im_end\|>\n", -1), 1, F.size(F.split("formatted", r"<\|im_end\|>\n", -1)) - 1
    )

    def turns_of(message: Column) -> Column:
        role = F.substring_index(message, "\n", 1)
        body = message.substr(F.length(role) + 2, F.length(message))
        name = unescape_role(role.substr(F.lit(len(START) + 1), F.length(role)))
        return F.transform(
            F.split(body, r"<\|im_next\|>", -1), lambda t: F.struct(name.alias("role"), unescape(t).alias("text"))
        )

    loss = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["piece"]))
    return chats.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(messages, turns_of)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
    )
