"""Chat formatting by prefix-target expansion: one example for each assistant turn, trained on that reply alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template: what opens a turn's header, what ends the header, what closes a turn.
OPEN, HEADED, CLOSE = "### ", ":\n", "\n</turn>\n"


def escaped(text: Column) -> Column:
    """Doubles backslashes and puts one before the template's control strings; unescaped() reverses it."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("\\</turn>"))
    return F.replace(out, F.lit("###"), F.lit("\\###"))


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\<#])", "$1")).otherwise(text)


def examples(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text (others ignored). Returns an example for each assistant turn: conv_id, example (from 1),
    last (the conversation's longest example), text, loss_start, loss_end.

    An example's text holds the formatted turns up to its own, and its loss mask (code points from loss_start, up to but not including
    loss_end) covers that turn's escaped reply alone. A conversation that doesn't end on an assistant turn gets one more
    example over all turns with an empty mask, so that no turn is lost.

    Turns are ordered by turn, then role and text, nulls first. Null text is empty; null role is an empty role; rows of a null
    conv_id are one conversation. Repeated rows are turns of their own. No rows: no rows.
    """
    text = escaped(F.col("text"))
    head = F.concat(F.lit(OPEN), F.url_encode(F.coalesce("role", F.lit(""))), F.lit(HEADED))
    first = lambda c: F.col(c).asc_nulls_first()
    by = Window.partitionBy("conv_id").orderBy(first("turn"), first("role"), first("text"))
    t = turns.select("conv_id", "turn", "role", "text", head.alias("head"), text.alias("body"), F.row_number().over(by).alias("place"))
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    t = t.withColumn("end", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    stop = F.col("end") - len(CLOSE)
    row = F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("said"), "end", (stop - F.char_length("body")).alias("start"), stop.alias("stop"), F.lower("role").eqNullSafe("assistant").alias("reply"))
    held = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: x.said), "")
    marks = F.filter("t", lambda x, i: x.reply | (i == F.size("t") - 1))
    marks = F.transform(marks, lambda x: F.struct(x.end.alias("end"), x.start.alias("start"), x.stop.alias("stop"), x.reply.alias("reply")))
    laid = held.select("conv_id", whole.alias("whole"), marks.alias("marks"))
    each = laid.select("conv_id", "whole", F.size("marks").alias("n"), F.posexplode("marks").alias("i", "m"))
    return each.select(
        "conv_id",
        (F.col("i") + 1).alias("example"),
        (F.col("i") + 1 == F.col("n")).alias("last"),
        F.left("whole", F.col("m.end")).alias("text"),
        F.when(F.col("m.reply"), F.col("m.start")).otherwise(F.col("m.end")).alias("loss_start"),
        F.when(F.col("m.reply"), F.col("m.stop")).otherwise(F.col("m.end")).alias("loss_end"),
    )


def turns_of(text: Column) -> Column:
    """The turns of an example's text: array of structs of role and text."""
    parts = F.split(text, CLOSE, -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def read(part: Column) -> Column:
        at = F.instr(part, HEADED)
        return F.struct(F.url_decode(F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescaped(F.substring(part, at + len(HEADED), F.char_length(part))).alias("text"))

    return F.transform(parts, read)


def reply_of(text: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask, as it was before escaping."""
    return unescaped(F.substring(text, start + 1, end - start))
