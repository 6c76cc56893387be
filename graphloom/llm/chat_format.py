"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it are context and only
its own reply is trainable.  Because examples of a conversation are prefixes of each other,
they share storage: ``format_turns`` writes each turn's formatted segment once, with its
character range in the conversation, and ``expand`` makes one row per assistant turn that
names the prefix (``context_end``) and the mask (``loss_start``, ``loss_end``).  The number of
characters written grows with the turns, not with their square; ``materialize`` joins the
texts for those who want them spelled out.

Template: ``### Role: text</turn>`` and a newline.  Inside a role or text every backslash is
doubled and a backslash is put before ``###`` and ``</turn>`` (and before ``:`` in a role), so
no text can close its turn or open another, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, running

OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    """Backslash before every backslash, ``###`` and ``</turn>``."""
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.regexp_replace(escape(role), ":", r"\\:"), F.lit(": "), escape(text), F.lit(CLOSE))


def read_role(seg: Column) -> Column:
    return unescape(F.regexp_extract(seg, r"(?s)^### ((?:[^\\:]|\\.)*+): ", 1))


def read_text(seg: Column) -> Column:
    """The text of a formatted turn, as it was before formatting."""
    return unescape(F.regexp_extract(seg, r"(?s)^### (?:[^\\:]|\\.)*+: (.*)</turn>\n$", 1))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, pos (1..), role, segment, seg_start, seg_end, loss_start, loss_end.

    Offsets count characters (code points) from the start of the formatted conversation.  For
    assistant turns loss_start/loss_end enclose the escaped reply, else both are null.  A null
    role or text is empty, a null conv_id is a conversation of its own, ties in ``turn`` are
    ordered by role and text, repeated rows are repeated turns, and a null turn comes first.
    An empty table gives no rows; further columns are not read.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "_text")
    t = t.withColumn("pos", F.row_number().over(order)).withColumn("segment", segment(F.col("role"), F.col("_text")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_n", F.length("segment").cast("bigint")).withColumn("seg_end", F.sum("_n").over(upto)).withColumn("seg_start", F.col("seg_end") - F.col("_n"))
    reply = F.col("role") == "assistant"
    end = F.col("seg_end") - len(CLOSE)
    return t.select("conv_id", "pos", "role", "segment", "seg_start", "seg_end", F.when(reply, end - F.length(escape(F.col("_text")))).alias("loss_start"), F.when(reply, end).alias("loss_end"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, target (its pos), context_end, loss_start, loss_end, chars (the example's length)."""
    return formatted.where(F.col("loss_start").isNotNull()).select("conv_id", F.col("pos").alias("target"), F.col("seg_start").alias("context_end"), "loss_start", "loss_end", F.col("seg_end").alias("chars"))


def materialize(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """The examples with their text spelled out; its size grows with the square of a conversation's turns."""
    e = examples.select(F.col("conv_id").alias("_c"), "target", F.col("loss_start").alias("start"), F.col("loss_end").alias("end"))
    j = e.join(formatted, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("pos") <= F.col("target")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "segment")))
    return j.groupBy(F.col("_c").alias("conv_id"), "target", "start", "end").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("text"))


def digest(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    An example's length is counted from the segments up to its target, and its reply is what its
    own mask cuts out of its target's segment; so another mask gives another result, and a turn
    without an example has no reply.  formatted_chars is the sum of the examples' lengths.  The two
    hashes are of one value a conversation, so a conversation's text must fit in a row.  A null
    conv_id is a conversation; empty tables give no rows.
    """
    example = F.struct("target", "loss_start", "loss_end")
    turn = F.struct("pos", "segment")
    written = formatted.select(F.col("conv_id").alias("_c"), turn.alias("turn"), F.lit(None).cast(examples.select(example.alias("e")).schema["e"].dataType).alias("example"))
    shown = examples.select(F.col("conv_id").alias("_c"), F.lit(None).cast(written.schema["turn"].dataType).alias("turn"), example.alias("example"))
    per = written.unionByName(shown).groupBy("_c").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.sort_array(F.collect_list("example")).alias("examples"))

    def read(starts):
        def one(e):
            segment, start = F.get("turns", e["target"] - 1)["segment"], F.get(starts, e["target"] - 1)
            reply = F.substring(segment, (e["loss_start"] - start + 1).cast("int"), (e["loss_end"] - e["loss_start"]).cast("int"))
            return F.struct(unescape(reply).alias("reply"), (start + F.length(segment)).cast("bigint").alias("chars"))

        return F.transform("examples", one)

    starts = running(F.col("turns"), lambda at, t: at + F.length(t["segment"]))
    lines = F.transform("turns", lambda t: F.concat(read_role(t["segment"]), F.lit("\n"), read_text(t["segment"]), F.lit("\n")))
    per = per.select(F.col("_c").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), let(starts, read).alias("read"))
    per = per.select("conv_id", "n_turns", "turns_sha256", F.array_join(F.transform("read", lambda r: r["reply"]), "").alias("said"), F.aggregate("read", F.lit(0).cast("bigint"), lambda a, r: a + r["chars"]).alias("formatted_chars"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("said").cast("bigint").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")
