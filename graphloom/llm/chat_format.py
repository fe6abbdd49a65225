"""Prefix-target expansion of conversations, with DataFrame functions only.

Each assistant turn becomes one example: all preceding turns as context, and
only that reply under the loss mask.  A turn is written as

    <s>ROLE[INST]TEXT</s>

and a reader cuts at the marks.  Texts and roles may hold the marks, or other
control strings, themselves; there a backslash goes after the first character
of each, and each backslash is doubled, so no control string survives inside a
text and unescape() restores every character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<s>", "[INST]", "</s>"
#: Control strings of the template and of tokenizers that read it.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = r"(\\|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>))"


def escape(text: Column) -> Column:
    """Put a backslash after every backslash and every control string's first character."""
    return F.regexp_replace(text, _FIRST, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trainable: str = "assistant",
) -> DataFrame:
    """One row per example: conv, example, is_last, n_turns, formatted, loss_start, loss_len.

    loss_start (from 0) and loss_len are in code points of ``formatted``.
    Null text and null role: empty.  Turns are ordered by turn (null first),
    then role, then text; repeated rows are repeated turns.  Rows with a null
    conv form one conversation.  Turns after the last assistant turn, or a
    conversation without one, go into a last example without loss (loss_len
    null), so that no turn is lost.  Other columns are not read.

    A conversation must fit into one row, as each example holds all of it.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    talks = turns.groupBy(F.col(conv).alias("conv")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), part(role).alias("r"), part(text).alias("x")))).alias("turns")
    )
    marked = talks.select(
        "conv",
        F.transform("turns", lambda t: t.r == trainable).alias("train"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t.r), F.lit(BODY))).alias("heads"),
        F.transform("turns", lambda t: escape(t.x)).alias("bodies"),
    )
    last = F.size("train") - 1
    places = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("train", i) | (i == last))
    return (
        marked.select("*", F.posexplode(places).alias("example", "at"))
        .select(
            "conv",
            "example",
            (F.col("at") == last).alias("is_last"),
            (F.col("at") + 1).alias("n_turns"),
            F.concat(
                F.array_join(
                    F.zip_with(F.slice("heads", F.lit(1), F.col("at")), F.slice("bodies", F.lit(1), F.col("at")), lambda h, b: F.concat(h, b, F.lit(CLOSE))),
                    "",
                ),
                F.get("heads", F.col("at")),
            ).alias("before"),
            F.get("bodies", F.col("at")).alias("body"),
            F.get("train", F.col("at")).alias("trained"),
        )
        .select(
            F.col("conv").alias(conv),
            "example",
            "is_last",
            "n_turns",
            F.concat("before", "body", F.lit(CLOSE)).alias("formatted"),
            F.when(F.col("trained"), F.length("before")).alias("loss_start"),
            F.when(F.col("trained"), F.length("body")).alias("loss_len"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    pieces = F.split(formatted, CLOSE)

    def one(piece: Column) -> Column:
        head = F.substring_index(piece, BODY, 1)
        return F.struct(
            unescape(F.substring(head, len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substr(piece, F.length(head) + len(BODY) + 1)).alias("text"),
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask; empty where there is none."""
    return F.coalesce(unescape(F.substr(formatted, start + 1, length)), F.lit(""))


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: counts and hashes of turns and loss."""
    back = examples.select(
        conv,
        "example",
        F.length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_len")).alias("loss"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
    )
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    whole = back.select(conv, "example", "chars", "loss", F.size("turns").cast("long").alias("n"), F.when(F.col("turns").isNotNull(), plain).alias("plain"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "")
    return (
        whole.groupBy(conv)
        .agg(F.max("n").alias("n_turns"), F.max("plain").alias("plain"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
        .select(
            conv,
            "n_turns",
            F.sha2(F.col("plain").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
