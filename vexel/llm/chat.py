"""Prefix-target expansion of conversations.

A conversation becomes one transcript in which control strings mark the turns; each assistant turn is an example whose
context is the transcript before its text, and only that text is trainable. Examples name their prefix by its length, so
that their size grows with the turns and not with their square: ``expand`` has a row for each, ``full_examples`` spells contexts out.
Inside texts and roles a backslash is doubled and "<|" becomes "<\\|", which is undone exactly on reading.

Defined results: rows are taken by (turn, role, text), nulls first, repeated rows as turns of their own; a null role or text
counts as empty; a null conv_id is a conversation of its own; a conversation without assistant turns has no example.
A conversation is the unit of the transcript and of its digest, so its text must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _plain_role(role: Column) -> Column:
    """One scan from the left: what lies between doubled backslashes has only single escapes."""
    single = lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(role, r"\\\\"), single), "\\")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (0..), role, segment (the turn in the template), before (its first character's place in the transcript), and mask_start and mask_chars within the segment (assistant turns)."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    base = conversations.select("conv_id", "turn", "role", "text", F.concat(F.lit(START), _role(role), F.lit("\n")).alias("head"), escape(text).alias("body"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = F.concat("head", "body", F.lit(END))
    placed = base.select(
        "conv_id", "role", (F.row_number().over(by) - 1).alias("place"), whole.alias("segment"),
        (F.sum(F.char_length(whole).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length(whole)).alias("before"), "head", "body",
    )
    mine = F.col("role") == "assistant"
    return placed.select("conv_id", "place", "role", "segment", "before", F.when(mine, F.char_length("head")).alias("mask_start"), F.when(mine, F.char_length("body")).alias("mask_chars"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (the transcript) and examples: an array of (place of the target turn, context_chars, mask_start within the turn, mask_chars)."""
    example = F.when(F.col("mask_start").isNotNull(), F.struct("place", (F.col("before") + F.col("mask_start")).alias("context_chars"), "mask_start", "mask_chars"))
    packed = turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "segment"))).alias("parts"), F.sort_array(F.collect_list(example)).alias("examples"))
    return packed.select("conv_id", F.array_join(F.col("parts.segment"), "").alias("formatted"), "examples")


def expand(made: DataFrame) -> DataFrame:
    """A row per assistant turn: conv_id, place, context_chars (the length of all before its text), formatted (the transcript that holds the context) and target (the trainable text as it stands there).

    A context ends with the turn's own head and the target is followed by the end mark, else the row is an error.
    """
    each = made.select("conv_id", "formatted", F.explode("examples").alias("e")).select("conv_id", "formatted", "e.place", "e.context_chars", "e.mask_chars")
    at = lambda start, n: F.substring("formatted", start.cast("int"), n.cast("int"))
    head = F.lit(START + "assistant\n")
    framed = (at(F.col("context_chars") - F.char_length(head) + 1, F.char_length(head)) == head) & (at(F.col("context_chars") + F.col("mask_chars") + 1, F.lit(len(END))) == END)
    target = F.when(framed, at(F.col("context_chars") + 1, F.col("mask_chars"))).otherwise(F.raise_error(F.lit("no assistant's text at that place")))
    return each.select("conv_id", "place", "context_chars", "formatted", target.alias("target"))


def full_examples(made: DataFrame) -> DataFrame:
    """The rows of expand() with the context as a string; for export, as its size is quadratic in a conversation's length."""
    return expand(made).select("conv_id", "place", F.substring("formatted", F.lit(1), F.col("context_chars").cast("int")).alias("context"), "target")


def read_back(made: DataFrame) -> DataFrame:
    """The digests of each conversation: its turns from the transcript, the loss text from the rows of expand()."""
    parts = F.filter(F.split("formatted", "<\\|im_end\\|>\n"), lambda x: x != "")
    inner = lambda x: F.substring(x, F.lit(len(START) + 1), F.char_length(x))
    role = lambda x: F.substring_index(inner(x), "\n", 1)
    body = lambda x: F.substring(inner(x), F.char_length(role(x)) + 2, F.char_length(x))
    told = F.array_join(F.transform("parts", lambda x: F.concat(_plain_role(role(x)), F.lit("\n"), unescape(body(x)), F.lit("\n"))), "")
    turns_ = made.select("conv_id", parts.alias("parts"), F.char_length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", F.size("parts").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"), "formatted_chars",
    )
    taught = expand(made).select("conv_id", "place", unescape(F.col("target")).alias("target"))
    losses = taught.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "target"))).alias("taught")).select(F.col("conv_id").alias("id"), F.array_join(F.col("taught.target"), "").alias("loss"))
    loss = F.coalesce("loss", F.lit(""))
    return turns_.join(losses, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )
