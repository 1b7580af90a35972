"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one document.  The corpus rule hashes every normalised line,
counts for each host the distinct documents that hold it, takes the lines above
the host's limit out, and rejects documents of which less than half is left.

Only hashes, ids and word counts of lines are shuffled.  A line is first merged
within its document and then counted with partial sums, so a host or line with
a third of all rows is added up before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.lines import STRIP, key_of, wide_hash
from tallymark.session import cut_lineage

#: Fixed values of the contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"

#: A line goes from a host when more documents of it than this hold the line, however large the host is.
LINE_DOCS = 10
#: Lines above the limit that are broadcast, of some 40 bytes each.
SENT_ROWS = 100_000
#: A document is depleted when less than this part of its words is left.
LEAST_LEFT_PERCENT = 50


def measures(docs: DataFrame) -> DataFrame:
    """The base measures of every row, in one pass without a shuffle; see :func:`quality_rules`."""
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(STRIP))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(*docs.columns, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP)).alias("words"), F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    windows = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2))), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    counted = words.select(
        *[c for c in docs.columns if c != "text"], F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    # Only texts in which some window comes twice are sorted: equal windows then stand side by side.
    plain = [c for c in counted.columns if c != "windows"]
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = counted.select(*plain, F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    same = F.filter("ordered", lambda x, i: (F.get(F.col("ordered"), i - 1)["h"] == x["h"]) | (F.get(F.col("ordered"), i + 1)["h"] == x["h"]))
    placed = ordered.select(*plain, F.sort_array(F.transform(same, lambda x: x["i"])).alias("places"))
    cover = F.aggregate(F.transform("places", lambda p, i: F.coalesce(F.least(F.lit(3), F.get(F.col("places"), i + 1) - p), F.lit(3))), F.lit(0), lambda a, b: a + b)
    return placed.select(*plain, F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def depletion(docs: DataFrame, limit: int = LINE_DOCS) -> DataFrame:
    """Words that each (doc_id, t1, t2, source) loses with the lines that more than ``limit`` documents of its host hold.

    A host is a value of ``source``, null being one of its own.  Lines are
    compared without white space at both ends and with A-Z lower-cased; lines
    without a word are not counted.  Rows that repeat an id are one document.
    """
    lines = docs.select("doc_id", "t1", "t2", F.col("source").alias("host"), F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.col("line").rlike(WORD))
    hashed = lines.select("doc_id", "t1", "t2", "host", *wide_hash(key_of(F.col("line"))), F.regexp_count("line", F.lit(WORD)).alias("n"))
    one_each = hashed.groupBy("host", "h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    often = one_each.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > limit)
    above = cut_lineage(often.select(F.col("host").alias("at"), F.col("h1").alias("k1"), F.col("h2").alias("k2")))
    # Their number grows with the corpus, so they are counted: up to the bound they are sent along, beyond it the lines meet them by sorting.
    sent = F.broadcast(above) if above.count() <= SENT_ROWS else above
    lost = hashed.join(sent, hashed.host.eqNullSafe(sent["at"]) & (hashed.h1 == sent.k1) & (hashed.h2 == sent.k2))
    return lost.groupBy("doc_id", "t1", "t2", "host").agg(F.sum("n").alias("n_lost"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words_lost, base_failed, kept.

    One row for each row of ``docs`` (columns doc_id, text and source are
    read).  A null or empty text has no words, so it fails; repeated rows are
    judged alike and count as one document of their host; very long texts are
    measured whole; other columns may have any name; an empty table gives no rows.
    """
    named = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
    base = measures(named)
    lost = depletion(named).select(F.col("doc_id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "host", "n_lost")
    met = base.join(lost, base.doc_id.eqNullSafe(lost.d) & base.source.eqNullSafe(lost.host) & (base.t1 == lost.u1) & (base.t2 == lost.u2), "left")
    gone = F.coalesce("n_lost", F.lit(0)).cast("long")
    failed: Column = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    kept = ~failed & ((F.col("n_words") - gone) * 100 >= F.col("n_words") * LEAST_LEFT_PERCENT)
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("n_line_words_lost"), failed.alias("base_failed"), kept.alias("kept"))


SQL = r"""
with split as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from split, unnest(range(1, len(words) - 1)) as r(i)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
covered as (select doc_id, count(distinct i + o) as n from twice, unnest([0, 1, 2]) as t(o) group by doc_id),
lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line from split),
worded as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select doc_id, count(*) - count(distinct line) as n from worded group by doc_id),
above as (select source, key from worded group by source, key having count(distinct doc_id) > 10),
lost as (select w.doc_id, sum(w.n) as n from worded w join above a on w.source is not distinct from a.source and w.key = a.key group by w.doc_id),
base as (
  select s.doc_id, len(s.words)::bigint as n_words, length(array_to_string(s.words, ''))::bigint as word_chars,
    length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(d.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(l.n, 0)::bigint as n_line_words_lost
  from split s left join dups d on d.doc_id = s.doc_id left join covered c on c.doc_id = s.doc_id left join lost l on l.doc_id = s.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and (n_words - n_line_words_lost) * 100 >= n_words * 50 as kept
from base
"""
