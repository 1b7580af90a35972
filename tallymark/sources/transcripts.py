"""Transcripts as line tables.

A transcript is one row.  Its lines stay inside that row as an array until the
context of each line has been attached, so windows over neighbouring lines need
no shuffle and a long transcript never meets another one in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import text as tx


def explode_lines(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per non-blank line with two lines of context on both sides."""
    lined = df.select(*keys, tx.line_array(F.col(text_col)).alias("lines"))
    return explode_line_array(lined, keys)


def explode_line_array(lined: DataFrame, keys: list[str], lines_col: str = "lines") -> DataFrame:
    lines = F.col(lines_col)
    near = lambda i, step: F.get(lines, i + step)["text"]
    rich = F.transform(
        lines,
        lambda l, i: F.struct(
            l["line_index"].alias("line_index"), l["text"].alias("text"), (i + 1).cast("int").alias("position"),
            near(i, -2).alias("prev2"), near(i, -1).alias("prev1"), near(i, 1).alias("next1"), near(i, 2).alias("next2"),
        ),
    )
    return lined.select(*keys, F.inline(rich))


def context_text(before: int = 1, after: int = 1) -> Column:
    """Neighbouring lines joined by a bar, from the columns of ``explode_lines``."""
    names = ["prev2", "prev1"][2 - before:] + ["text"] + ["next1", "next2"][:after]
    return F.concat_ws(" | ", *[F.col(n) for n in names])


def surfaces_to_lines(df: DataFrame, keys: list[str], surfaces_col: str = "surfaces") -> DataFrame:
    """Surfaces with arrays of text lines to one numbered line table per scan.

    Marks such as ``?`` or ``[unclear]`` make a line uncertain.
    """
    flat = F.flatten(F.transform(F.col(surfaces_col), lambda s: F.transform(
        s["text_lines"], lambda t: F.struct(s["surface"].alias("surface"), t.alias("text")))))
    unsure = lambda t: F.contains(t, F.lit("?")) | F.contains(F.lower(t), F.lit("[unclear]"))
    numbered = F.transform(flat, lambda l, i: F.struct(
        (i + 1).cast("int").alias("line_index"), l["surface"].alias("surface"), l["text"].alias("text"),
        unsure(l["text"]).alias("is_uncertain"), F.when(unsure(l["text"]), 0.55).otherwise(0.94).alias("confidence")))
    return df.select(*keys, F.inline(numbered))


def append_client_lines(df: DataFrame, keys: list[str], lines_col: str, extra_col: str) -> DataFrame:
    """Lines sent by the client continue the numbering of the scan's own lines."""
    own, extra = F.col(lines_col), F.filter(F.col(extra_col), lambda t: tx.strip(t) != "")
    tail = F.transform(extra, lambda t, i: F.struct(
        (F.size(own) + i + 1).cast("int").alias("line_index"), tx.strip(t).alias("text"), t.alias("raw_text")))
    return df.select(*keys, F.inline(F.concat(own, tail)))
