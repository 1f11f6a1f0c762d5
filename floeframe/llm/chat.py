"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only its text is
trainable. Turns are formatted once, as segments with their place in the conversation's transcript, and an example
is a prefix of the transcript, so that a conversation of n turns costs n segments and not n * n. ``materialise``
writes the examples' whole texts out where they are wanted.

A segment is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Inside roles and texts every backslash is
doubled and every control string gets a backslash after its first character, so a control string in the output is
always the template's own, and ``unescape`` restores the text exactly.

Edge cases: a null role or text is empty; a null conversation id is a conversation of its own; turns sort by number
(null first), then role, then text, so repeated turns all stay; a conversation without assistant turn gives segments
and no example; turns after the last assistant turn are in the transcript and in no example; an empty reply is an
example with an empty loss span. Other columns, and their names, do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# control strings of common templates, escaped wherever they stand in a text
CONTROLS = (START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>")
BLOCK = 1024         # turns of one conversation that a window task takes together


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    # a control string is matched as its first character before the rest of it
    inner = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True))
    return F.regexp_replace(doubled, inner, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(conversations: DataFrame) -> DataFrame:
    """One row per turn: formatted segment, and code points of the transcript before it.

    Columns: conv_id, seq (0-based), turn, role, segment, seg_start, seg_chars, text_start, text_chars.
    The running position is summed by blocks of turns first, so that no task walks a whole long conversation.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shaped = (rows.withColumn("_role", escape(F.col("role"))).withColumn("_text", escape(F.col("text")))
              .withColumn("segment", F.concat(F.lit(START), "_role", F.lit(SEP), "_text", F.lit(END + "\n")))
              .withColumn("seg_chars", F.char_length("segment").cast("long"))
              .withColumn("_head", F.char_length("_role") + len(START) + len(SEP))
              .withColumn("text_chars", F.char_length("_text").cast("long"))
              .withColumn("_block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)))
    order = ["turn", "role", "text"]
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (shaped.groupBy("conv_id", "_block").agg(F.sum("seg_chars").alias("_chars"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_base"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = (shaped.withColumn("_end", F.sum("seg_chars").over(inside)).withColumn("_rn", F.count(F.lit(1)).over(inside))
              .join(base, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b"))))
    return placed.select("conv_id", (F.col("_first") + F.col("_rn") - 1).alias("seq"), "turn", "role", "segment",
                         (F.col("_base") + F.col("_end") - F.col("seg_chars")).alias("seg_start"), "seg_chars",
                         (F.col("_base") + F.col("_end") - F.col("seg_chars") + F.col("_head")).alias("text_start"), "text_chars")


def examples(segs: DataFrame) -> DataFrame:
    """One row per assistant turn: the transcript prefix that it takes, and its loss span.

    Columns: conv_id, example_seq, n_context (turns before), context_chars, formatted_chars, loss_start, loss_end.
    """
    return (segs.where(F.col("role") == "assistant")
            .select("conv_id", F.col("seq").alias("example_seq"), F.col("seq").alias("n_context"), F.col("seg_start").alias("context_chars"),
                    (F.col("seg_start") + F.col("seg_chars")).alias("formatted_chars"), F.col("text_start").alias("loss_start"),
                    (F.col("text_start") + F.col("text_chars")).alias("loss_end")))


def transcripts(segs: DataFrame) -> DataFrame:
    """One row per conversation: its whole formatted text (a single value, as one string has to be)."""
    return (segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "segment"))).alias("_s"))
            .select("conv_id", F.array_join(F.col("_s.segment"), "").alias("transcript")))


def materialise(segs: DataFrame) -> DataFrame:
    """Examples with their whole texts: context, reply, and the loss span as offsets in ``formatted``."""
    t = transcripts(segs).withColumnRenamed("conv_id", "_c")
    return (examples(segs).join(t, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
            .withColumn("formatted", F.substring("transcript", F.lit(1), F.col("formatted_chars").cast("int"))).drop("transcript"))


def read_back(segs: DataFrame) -> DataFrame:
    """Turns and trained texts of each conversation, parsed from the formatted output.

    Columns: conv_id, turns (array of role, text), losses (array of unescaped text), formatted_chars.
    """
    spans = (examples(segs).groupBy(F.col("conv_id").alias("_e"))
             .agg(F.array_sort(F.collect_list(F.struct("loss_start", "loss_end"))).alias("spans")))
    whole = transcripts(segs).join(spans, F.col("conv_id").eqNullSafe(F.col("_e")), "left")
    parts = F.split(F.col("transcript"), re.escape(END + "\n"))
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.split(F.substring(p, len(START) + 1, F.lit(2147483647)), re.escape(SEP), 2))
    return whole.select(
        "conv_id",
        F.transform(turns, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text"))).alias("turns"),
        F.transform(F.coalesce("spans", F.array().cast("array<struct<loss_start:bigint,loss_end:bigint>>")),
                    lambda s: unescape(F.substring(F.col("transcript"), (s["loss_start"] + 1).cast("int"),
                                                   (s["loss_end"] - s["loss_start"]).cast("int")))).alias("losses"),
        F.char_length("transcript").cast("long").alias("formatted_chars"))
