"""Column helpers for text.  All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v"


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only the space character."""
    return F.btrim(col, F.lit(BLANKS))


def has(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


def any_word(words: Sequence[str]) -> str:
    """One alternation that matches any of ``words`` as whole words."""
    return r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")\b"


def needles(pattern: str) -> frozenset[str]:
    """Texts in lower case of which one at least stands in the lower case of all that ``pattern`` matches; ``''`` stands everywhere.

    Of a sequence the runs of letters are known that must be there, and those
    are taken whose shortest is longest; of alternatives all are.
    """

    def of(items) -> frozenset[str]:
        found, run = [], ""
        for kind, value in [*items, (None, None)]:
            if kind is parser.LITERAL:
                run += chr(value).lower() if chr(value).isascii() else chr(value)
                continue
            found, run = [*found, frozenset([run])], ""
            if kind is parser.SUBPATTERN:
                found.append(of(value[3]))
            elif kind is parser.BRANCH:
                found.append(frozenset().union(*(of(x) for x in value[1])))
            elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
        return max(found, key=lambda texts: (min(map(len, texts)), -len(texts)))

    return of(parser.parse(pattern))


def any_text(texts: Iterable[str]) -> str:
    """One pattern that finds any of ``texts``, letter by letter from shared beginnings."""
    after: dict[str, list[str]] = {}
    for t in sorted(set(texts)):
        if not t:
            return ""
        after.setdefault(t[0], []).append(t[1:])
    ways = [re.escape(first) + any_text(rest) for first, rest in after.items()]
    if len(ways) > 6:  # a letter is looked for among few ways: those of its part of the alphabet
        parts = [slice(k, k + 5) for k in range(0, len(ways), 5)]
        ways = [f"(?=[{''.join(map(re.escape, [*after][part]))}])(?:{'|'.join(ways[part])})" for part in parts]
    return "(?:" + "|".join(ways) + ")"


def grab(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or null (``regexp_extract`` gives ``''``)."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def first_of(*cols: Column) -> Column:
    return F.coalesce(*cols)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.btrim(col), F.lit(""))


def hit_count(col: Column, patterns: Sequence[str]) -> Column:
    """How many of ``patterns`` occur in ``col`` (each counted once)."""
    total = F.lit(0)
    for p in patterns:
        total = total + has(col, p).cast("int")
    return total


def similarity(a: Column, b: Column) -> Column:
    """Edit-distance ratio in [0, 1]; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it for ``body``.

    A column expression that is used several times inside a lambda would be
    evaluated again for every element; a bound one is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_array(text: Column) -> Column:
    """``array<struct<line_index,text,raw_text>>`` of the non-blank lines.

    The index counts every physical line from 1, blanks included, so that the
    numbers stay stable when blank lines are dropped.
    """
    numbered = F.transform(
        F.split(text, "\n", -1),
        lambda raw, i: F.struct(
            (i + 1).cast("int").alias("line_index"),
            strip(raw).alias("text"),
            raw.alias("raw_text"),
        ),
    )
    return F.filter(numbered, lambda l: l["text"] != "")


def with_lines(df: DataFrame, text_col: str = "text", out: str = "lines") -> DataFrame:
    """Add the line array.  Narrow: a label never leaves its row."""
    return df.withColumn(out, line_array(F.col(text_col)))


def first_line_match(lines: Column, pattern: str, group: int = 1) -> Column:
    """Value of ``pattern`` on the first line that has it, or null."""
    hits = F.filter(
        F.transform(lines, lambda l: F.regexp_extract(l["text"], pattern, group)),
        lambda v: v != "",
    )
    return F.get(hits, F.lit(0))
