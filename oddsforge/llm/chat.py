"""Operator 1: chat formatting by prefix-target expansion, in DataFrame functions only.

``segments`` renders each turn as ``<|im_start|>role\\ntext<|im_end|>\\n`` and gives it its place in
the conversation's formatted text. ``examples`` then makes one example of every assistant turn: its
context is the formatted text up to the turn's start, and only the reply is trainable. An example
names its context by offset (``context_end``) and carries its reply by value, so n replies cost n
rows, not n copies of a growing prefix; ``example_texts`` joins the prefix in where text is wanted.

Escaping is reversible. In texts a backslash goes between ``<`` and ``|`` (and before backslashes
already standing there), so no control string survives; roles percent-encode ``%``, newline and ``<``.

Defined results: null role or text reads as empty; a null conv_id is a conversation of its own; rows go by
turn (null first), ties by role then text; repeated rows are all kept; an empty table gives no rows.
Columns besides conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of one conversation that are laid out by one window group; longer conversations are laid out
#: in pieces of this many turn numbers, whose offsets come from the pieces' summed lengths.
PIECE = 1024


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def segments(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per turn: conv_id, piece, pos (from 0), role, segment, and offsets in code points:
    start and end of the segment, body_start and body_end of its escaped text."""
    t = (turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
         .withColumn("piece", F.floor(F.col("turn") / piece))
         .withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
         .withColumn("body", escape_text(F.col("text")))
         .withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
         .withColumn("n", F.char_length("segment").cast("long")))
    before = Window.partitionBy("conv_id").orderBy(F.col("piece").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (t.groupBy("conv_id", "piece").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("rows"))
              .select(F.col("conv_id").alias("p_conv"), F.col("piece").alias("p_piece"),
                      F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
                      F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")))
    within = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = (t.withColumn("pos", F.row_number().over(within) - 1)
         .withColumn("end", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0))))
    t = t.join(pieces, F.col("conv_id").eqNullSafe(F.col("p_conv")) & F.col("piece").eqNullSafe(F.col("p_piece")))
    start = F.col("end") - F.col("n") + F.col("chars_before")
    body = start + F.char_length("head")
    return t.select("conv_id", "piece", (F.col("pos") + F.col("rows_before")).alias("pos"), "role", "segment",
                    start.alias("start"), (start + F.col("n")).alias("end"),
                    body.alias("body_start"), (body + F.char_length("body")).alias("body_end"))


def examples(segs: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, piece, n_context_turns, context_end (all before it is context),
    loss_start, loss_end (the only trainable span), example_end, and reply, the escaped text in that span."""
    return segs.filter(F.col("role") == "assistant").select(
        "conv_id", "piece", F.col("pos").alias("n_context_turns"), F.col("start").alias("context_end"),
        F.col("body_start").alias("loss_start"), F.col("body_end").alias("loss_end"), F.col("end").alias("example_end"),
        F.substring("segment", (F.col("body_start") - F.col("start") + 1).cast("int"), (F.col("body_end") - F.col("body_start")).cast("int")).alias("reply"))


def _joined(rows: DataFrame, order: str, text: str, out: str) -> DataFrame:
    """The texts of each conversation in order, put together by piece first."""
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    return (rows.groupBy("conv_id", "piece").agg(part.alias("part"), F.min(order).alias("first"))
            .groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "part"))), lambda x: x["part"]), "").alias(out)))


def conversation_texts(segs: DataFrame) -> DataFrame:
    """conv_id and its formatted text, which the offsets of ``examples`` count in."""
    return _joined(segs, "pos", "segment", "formatted")


def example_texts(exs: DataFrame, texts: DataFrame) -> DataFrame:
    """Each example with its whole text (context, reply and the reply's end mark); this is the one form
    whose size grows with the square of a conversation's turns, as the expansion itself does."""
    t = texts.select(F.col("conv_id").alias("t_conv"), "formatted")
    return exs.join(t, F.col("conv_id").eqNullSafe(F.col("t_conv"))).select(
        "conv_id", "n_context_turns", F.substring("formatted", F.lit(1), F.col("example_end").cast("int")).alias("text"), "loss_start", "loss_end")


def parsed(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a conversation's formatted text."""
    turn = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: s != "")
    return F.transform(F.transform(turn, lambda s: F.split(F.substring(s, len(START) + 1, 2**31 - 1), "\n", 2)),
                       lambda p: F.struct(unescape_role(p[0]).alias("role"), unescape_text(p[1]).alias("text")))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text and the examples: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_examples and example_chars (all examples' lengths together)."""
    segs = segments(turns)
    said = conversation_texts(segs).withColumn("back", parsed(F.col("formatted"))).select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
    exs = examples(segs).withColumn("reply", unescape_text(F.col("reply")))
    loss = _joined(exs, "n_context_turns", "reply", "loss")
    sums = exs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_examples"), F.sum("example_end").alias("example_chars"))
    loss = loss.select(F.col("conv_id").alias("l_conv"), "loss")
    sums = sums.withColumnRenamed("conv_id", "s_conv")
    joined = (said.join(loss, F.col("conv_id").eqNullSafe(F.col("l_conv")), "left")
              .join(sums, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left"))
    loss_text = F.coalesce("loss", F.lit(""))
    return joined.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss_text).cast("long").alias("loss_chars"),
                         F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars",
                         F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("example_chars", F.lit(0)).alias("example_chars"))
