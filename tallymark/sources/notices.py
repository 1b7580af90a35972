"""Statutory notices as a knowledge base: one entry per relevant paragraph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import normalise as nm
from tallymark.functions import text as tx
from tallymark.operators.filters import contains_any

# fixed values
PARAGRAPH_BREAK = r"\n\s*\n|\n(?=[0-9]+\.\s+)"
MIN_PARAGRAPH = 30
RULE_MENTION = r"[Rr]ule\s+([0-9]{1,2}(?:\s*\([0-9a-zA-Z]+\))*)"
SCHEDULE_MENTION = r"(?i)(First|Second|Third|Fourth|Fifth|Sixth|Seventh)\s+Schedule"
SUBRULE_MENTION = r"(?i)(?:sub-rule|sub rule)\s*\(([0-9a-zA-Z]+)\)"
CLAUSE_MENTION = r"(?i)(?:clause)\s*\(([a-zA-Z0-9]+)\)"
EXCEPTION = r"(?i)(?:except|provided that|shall not apply to|other than|exemption)\s*([^.;]+)"
DATE_WORDS = r"([0-9]{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+,?\s+[0-9]{4}|1st\s+day\s+of\s+[A-Za-z]+,?\s+[0-9]{4})"
LOCAL_DATE = r"(?i)(?:w\.e\.f\.|with effect from|come into force on)\s*" + DATE_WORDS
NOTIFICATION = r"(?i)(?:G\.S\.R\.|GSR)\s*[0-9]+(?:\s*\([A-Z]\))?"
GENERAL_TAG = "General Packaged Commodities"


def product_tags(text: Column) -> Column:
    """Comma-joined product tags of a paragraph."""
    tags = F.array_compact(F.array(*[F.when(tx.has(text, p), F.lit(name)) for name, p in lx.NOTICE_TAGS.items()]))
    return F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(GENERAL_TAG)


def _clean(col: Column) -> Column:
    return tx.strip(F.regexp_replace(col, r"\s+", " "))


# Values that filters ask for are generated by ``explode`` and ``inline``: plain columns
# would be pushed into each filter with all they are made of, and evaluated there again.

def paragraphs(notices: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    parts = F.posexplode(F.split(F.col(text_col), PARAGRAPH_BREAK, -1)).alias("paragraph", "raw")
    cut = notices.select(*keys, parts)
    return cut.select("*", F.explode(F.array(_clean(F.col("raw")))).alias("text")).filter(F.length("text") >= MIN_PARAGRAPH)


def knowledge_entries(notices: DataFrame, keys: list[str], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Entries for paragraphs that name a rule, a schedule, a product or an amendment."""
    par = paragraphs(notices, [*keys, source_col] if source_col not in keys else keys, text_col)
    columns, t = par.columns, F.col("text")
    par = par.select("*", F.inline(F.array(F.struct(
        tx.grab(t, RULE_MENTION).alias("_rule"), tx.grab(t, SCHEDULE_MENTION).alias("_schedule"), product_tags(t).alias("_tags")))))
    rule, schedule, tags = F.col("_rule"), F.col("_schedule"), F.col("_tags")
    exceptions = F.transform(F.regexp_extract_all(t, F.lit(EXCEPTION), F.lit(1)), lambda m: F.substring(_clean(m), 1, 150))
    sub_rule = tx.grab(t, SUBRULE_MENTION)
    clause = tx.grab(t, CLAUSE_MENTION)
    out = par.select(
        *columns,
        F.coalesce(F.concat(F.lit("Rule "), rule), F.concat(schedule, F.lit(" Schedule")), F.lit("Legal Metrology Rules General")).alias("rule_number"),
        F.coalesce(F.concat(F.lit("Sub-rule ("), sub_rule, F.lit(")")), F.concat(F.lit("Clause ("), clause, F.lit(")")), F.lit("General")).alias("sub_rule_or_clause"),
        tags.alias("product_category"),
        F.when(F.size(exceptions) > 0, F.array_join(exceptions, "; ")).otherwise("None specifically mentioned").alias("exceptions"),
        F.coalesce(tx.grab(t, LOCAL_DATE), F.lit("As per notification")).alias("effective_date"),
        nm.language(F.col("raw")).alias("language"),
        (rule.isNotNull() | schedule.isNotNull() | (tags != GENERAL_TAG) | F.contains(F.lower(t), F.lit("amendment"))).alias("relevant"),
    )
    kept = out.filter("relevant").drop("relevant", "raw")
    # Identity comes from the content address, not from a global counter.
    return kept.withColumn("entry_id", F.concat(F.lit("KB-"), F.substring(F.sha2(F.concat_ws(":", *keys, "paragraph"), 256), 1, 12)))


def advisory_entries(scans: DataFrame, keys: list[str], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One entry per scanned advisory (text from OCR), same columns as above."""
    t = F.col(text_col)
    hindi = F.regexp_count(t, F.lit(r"[ऀ-ॿ]"))
    latin = F.regexp_count(t, F.lit(r"[A-Za-z]"))
    scans = scans.withColumn("_tags", F.explode(F.array(product_tags(t))))
    tags = F.col("_tags")
    rule = F.nullif(F.regexp_extract(t, r"[Rr]ule\s*([0-9]{1,2}(?:\s*\([0-9a-zA-Z]+\))*)", 1), F.lit(""))
    return scans.select(
        *keys, *([] if source_col in keys else [source_col]), F.lit(0).alias("paragraph"), t.alias("text"),
        F.coalesce(F.concat(F.lit("Rule "), rule), F.lit("Legal Metrology Advisory / Guidelines")).alias("rule_number"),
        F.lit("Advisory / Direction / SOP").alias("sub_rule_or_clause"),
        tags.alias("product_category"),
        F.coalesce(tx.grab(t, r"(?i)(?:except|provided that|exemption|shall not apply)\s*([^.;|]+)"), F.lit("None specifically mentioned")).alias("exceptions"),
        F.coalesce(tx.grab(t, r"(?i)(?:dated|date of issue|the)\s*" + DATE_WORDS), F.lit("As per advisory")).alias("effective_date"),
        F.when((hindi > 30) & (latin > 30), "Bilingual (Hindi & English)").when(hindi > latin, "Hindi").otherwise("English").alias("language"),
        F.concat(F.lit("KB-"), F.substring(F.sha2(F.concat_ws(":", *keys, F.lit("advisory")), 256), 1, 12)).alias("entry_id"),
    )


def merge_knowledge(entries: DataFrame, advisories: DataFrame) -> DataFrame:
    return entries.unionByName(advisories, allowMissingColumns=True)


def search_rule(entries: DataFrame, wanted: str) -> DataFrame:
    return entries.filter(contains_any(("rule_number", "sub_rule_or_clause"), wanted.strip()))


def search_category(entries: DataFrame, wanted: str) -> DataFrame:
    return entries.filter(contains_any(("product_category",), wanted.strip()))


def search_text(entries: DataFrame, wanted: str) -> DataFrame:
    blob = F.lower(F.concat_ws(" ", "rule_number", "sub_rule_or_clause", "text", "product_category"))
    return entries.filter(F.contains(blob, F.lit(wanted.strip().lower())))


def entry_by_id(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.filter(F.col("entry_id") == entry_id)


def _pieces(text: Column, size: int) -> Column:
    """Distinct runs of up to ``size`` letters of a text."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.filter(F.concat(*[runs(n) for n in range(1, size + 1)]), lambda p: p != ""))


def first_containing(wanted: DataFrame, entries: DataFrame, fields: Sequence[str], order: Sequence[str], size: int = 3) -> DataFrame:
    """(wanted, hit): for each distinct string of ``wanted`` the first entry that holds it in one of ``fields``.

    Without regard to case.  A string asks by its rarest run of three letters
    (all of it, where it is shorter); only texts with that run are searched.
    Equal field texts are one, with their first entry, so entries that repeat a
    rule number by the million are looked at once.
    """
    first = F.min(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in entries.columns if c not in order]).alias("_rest")))
    held = entries.select(F.explode(F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields])).alias("_text"), *entries.columns).groupBy("_text").agg(first.alias("hit"))
    listed = held.select("_text", "hit", F.explode(_pieces(F.col("_text"), size)).alias("piece"))
    often = listed.groupBy("piece").agg(F.count(F.lit(1)).alias("many"))
    asked = wanted.select(F.lower(F.trim("wanted")).alias("key")).filter("key is not null").distinct()
    whole = F.least(F.length("key"), F.lit(size))
    parts = asked.filter("key <> ''").select("key", F.explode(F.filter(_pieces(F.col("key"), size), lambda p: F.length(p) == whole)).alias("piece"))
    rarest = parts.join(often, "piece").groupBy("key").agg(F.min(F.struct("many", "piece"))["piece"].alias("piece"))
    hits = rarest.join(listed, "piece").filter(F.contains("_text", F.col("key"))).groupBy("key").agg(F.min("hit").alias("hit"))
    # An empty string is in every text.
    anything = held.agg(F.min("hit").alias("hit")).select(F.lit("").alias("key"), "hit").join(asked, "key", "left_semi")
    return hits.unionByName(anything)


def attach_citation(checks: DataFrame, entries: DataFrame, order: Sequence[str] = ("entry_id",), fallback: str = "Legal Metrology (Packaged Commodities) Rules, 2011") -> DataFrame:
    """Citation per check: the first entry (by ``order``) whose rule number or clause holds the check's rule number, else its sub-rule.

    "RULE 6" is found in "Rule 6(1)(a)".  The distinct strings asked for are
    settled first (:func:`first_containing`); a check then meets one row.  A
    null string finds nothing.
    """
    known = entries.select(*dict.fromkeys([*order, "entry_id", "source", "rule_number", "sub_rule_or_clause"]))
    asked = checks.select(F.explode(F.array("rule_no", "sub_rule")).alias("wanted")).distinct()
    found = first_containing(asked, known, ["rule_number", "sub_rule_or_clause"], order)
    rest = lambda f: F.col(f"hit.{f}") if f in order else F.col(f"hit._rest.{f}")
    found = found.select("key", F.struct(rest("entry_id").alias("entry_id"), rest("source").alias("source")).alias("hit"))
    by_rule, by_sub = found.select(F.col("key").alias("k1"), F.col("hit").alias("h1")), found.select(F.col("key").alias("k2"), F.col("hit").alias("h2"))
    joined = checks.join(by_rule, F.lower(F.trim("rule_no")) == F.col("k1"), "left").join(by_sub, F.lower(F.trim("sub_rule")) == F.col("k2"), "left")
    hit = F.coalesce("h1", "h2")
    return joined.select(*checks.columns, hit["entry_id"].alias("citation_id"), F.coalesce(hit["source"], F.lit(fallback)).alias("citation_source"))
