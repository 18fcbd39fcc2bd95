"""Chat formatting by prefix-target expansion.

Each assistant turn of a conversation becomes an example of its own: all turns up to it in the template, with
only that reply trainable.  Turns after the last assistant turn (or all, if there is none) form
one more example without a trainable part, so that every turn can be read back.

Template of a turn: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.  Control strings
inside texts and roles get a backslash after their first character (one more if they have some already),
which breaks them and can be undone exactly; in roles ``%`` and line feeds are percent-encoded, because a line
feed ends the role.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks and further strings that chat templates use for control.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

ASSISTANT = "assistant"


def _control_rest() -> str:
    return "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=lambda c: (-len(c), c)))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_control_rest()})", r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_control_rest()})", r"$1$2$3")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, example, formatted, loss_start, loss_end)``: the examples of every conversation.

    ``loss_start`` and ``loss_end`` are code point offsets into ``formatted`` (end exclusive) of the
    trainable reply, null in an example without one.  Turns are ordered by ``turn`` (nulls first), then role,
    then text, so ties and repeated rows, which stay, have a fixed order.  A null role or text is
    empty; rows with a null ``conv_id`` are one conversation.  Other columns are ignored; an empty table
    gives an empty result.  A conversation is one row while it is expanded, as its last example is anyway.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("replies"),
        F.transform("turns", lambda t: F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("texts"),
    )
    parts = parts.select("conv_id", "replies", "heads", "texts", F.zip_with("heads", "texts", lambda h, t: F.concat(h, t, F.lit(END + "\n"))).alias("pieces"))
    n = F.size("pieces")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: F.get("replies", k - 1) | (k == n))
    each = parts.select("conv_id", "replies", "heads", "texts", "pieces", F.posexplode_outer(ends).alias("example", "k"))
    before = F.length(F.array_join(F.slice("pieces", 1, F.col("k") - 1), "")) + F.length(F.get("heads", F.col("k") - 1))
    start = F.when(F.get("replies", F.col("k") - 1), before)
    made = each.select("conv_id", "example", F.array_join(F.slice("pieces", 1, F.col("k")), "").alias("formatted"), start.alias("loss_start"), F.length(F.get("texts", F.col("k") - 1)).alias("size"))
    return made.select("conv_id", "example", "formatted", "loss_start", (F.col("loss_start") + F.col("size")).alias("loss_end"))


def loss_text(formatted: str = "formatted", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The unescaped text under an example's loss mask; empty where it has none."""
    return F.coalesce(unescaped(F.substring(F.col(formatted), F.col(start) + 1, F.col(end) - F.col(start))), F.lit(""))


def read_turns(formatted: Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted example."""
    chunks = F.split(formatted, re.escape(START))
    chunks = F.slice(chunks, 2, F.size(chunks))

    def turn(chunk: Column) -> Column:
        head = F.substring_index(chunk, "\n", 1)
        size = F.length(chunk) - F.length(head) - 1 - len(END + "\n")
        return F.struct(_unescaped_role(head).alias("role"), unescaped(F.substring(chunk, F.length(head) + 2, size)).alias("text"))

    return F.transform(chunks, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """``(conv_id, turns array<(role, text)>, loss_text, formatted_chars)`` from the examples of ``expand``.

    The turns come from a conversation's last example, which holds all of them; ``loss_text`` is the
    trainable text of all examples in order.
    """
    each = examples.select("conv_id", "example", "formatted", loss_text().alias("loss"))
    whole = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    return whole.select("conv_id", read_turns(F.col("last")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
