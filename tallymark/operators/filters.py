"""Predicates, searches and facets over dockets, violations, rules and lines.

Each function returns the filtered frame; nothing is collected, so Catalyst can
push the comparisons down to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import text as tx

# fixed values: vocabulary that must agree with stored dockets
ALL = "ALL"
COMPLIANT_WORDS = ("COMPLIANT", "Compliant")
NON_COMPLIANT_WORDS = ("NON_COMPLIANT", "Non-Compliant")
REVIEW_WORDS = ("NEEDS_REVIEW", "Under Review", "Needs Review")
SENTINELS = ("not_visible", "unknown", "none", "")


def contains_any(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive substring test over several columns; blank needle passes."""
    if needle == "":
        return F.lit(True)
    wanted = needle.lower()
    test = F.lit(False)
    for name in columns:
        test = test | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(wanted)), F.lit(False))
    return test


def equals_unless_all(column: str, value: str) -> Column:
    return F.lit(True) if value == ALL else F.col(column) == F.lit(value)


def search_dockets(df: DataFrame, needle: str, columns: Sequence[str] = ("product_name", "manufacturer", "ocr_text", "scan_id")) -> DataFrame:
    return df.filter(contains_any(columns, needle))


def inspection_history(df: DataFrame, needle: str = "", status: str = ALL, category: str = ALL, officer: str = ALL) -> DataFrame:
    kept = contains_any(("id", "product_name", "brand", "manufacturer", "barcode"), needle)
    kept = kept & equals_unless_all("status", status) & equals_unless_all("category", category)
    if officer != ALL:
        kept = kept & F.contains(F.col("officer_name"), F.lit(officer))
    return df.filter(kept)


def violation_registry(df: DataFrame, needle: str = "", severity: str = ALL) -> DataFrame:
    columns = ("violation_type", "rule_reference", "product_name", "violation_id")
    return df.filter(contains_any(columns, needle) & equals_unless_all("severity", severity))


def product_catalogue_filter(df: DataFrame, needle: str = "", category: str = ALL, status: str = ALL) -> DataFrame:
    columns = ("name", "brand", "manufacturer", "barcode")
    return df.filter(
        contains_any(columns, needle)
        & equals_unless_all("category", category)
        & equals_unless_all("compliance_status", status)
    )


def audit_log_filter(df: DataFrame, needle: str = "", module: str = ALL, status: str = ALL) -> DataFrame:
    columns = ("action", "officer_name", "record_id", "details")
    return df.filter(
        contains_any(columns, needle) & equals_unless_all("module", module) & equals_unless_all("status", status)
    )


def rule_library_filter(df: DataFrame, needle: str = "", category: str = ALL) -> DataFrame:
    columns = ("rule_number", "title", "applicable_declaration", "requirement")
    return df.filter(contains_any(columns, needle) & equals_unless_all("category", category))


def line_viewer(df: DataFrame, needle: str = "", surface: str = ALL) -> DataFrame:
    return df.filter(contains_any(("text",), needle) & equals_unless_all("surface", surface))


def check_list(df: DataFrame, needle: str = "", category: str = ALL, status: str = ALL) -> DataFrame:
    """Checks by facet.  ``NEEDS_REVIEW`` also takes unreadable checks."""
    kept = contains_any(("rule_no", "sub_rule", "title"), needle) & equals_unless_all("category", category)
    if status == "NEEDS_REVIEW":
        kept = kept & F.col("status").isin("NEEDS REVIEW", "UNREADABLE")
    elif status == "NOT_APPLICABLE":
        kept = kept & (F.col("status") == "NOT APPLICABLE")
    elif status != ALL:
        kept = kept & (F.col("status") == status)
    return df.filter(kept)


def field_list(df: DataFrame, needle: str = "", category: str = ALL) -> DataFrame:
    return df.filter(contains_any(("label", "rule_ref", "value"), needle) & equals_unless_all("category", category))


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; partial aggregation collapses hot values before the shuffle."""
    return df.select(column).distinct()


def status_label(overall: Column) -> Column:
    return (
        F.when(overall.isin(*NON_COMPLIANT_WORDS), "Non-Compliant")
        .when(overall.isin(*COMPLIANT_WORDS), "Compliant")
        .otherwise("Under Review")
    )


def notice_candidates(df: DataFrame) -> DataFrame:
    """Dockets for which a notice may be drawn up."""
    return df.filter((F.col("status") == "Non-Compliant") | (F.col("violation_count") > 0))


def evidence_lookup(evidence: DataFrame, scan_id: str, wanted: str) -> DataFrame:
    """Evidence rows of one scan by region id or image id."""
    return evidence.filter(
        (F.col("scan_id") == scan_id) & ((F.col("region_id") == wanted) | (F.col("image_id") == wanted))
    )


def first_filled(*columns: Column, default: str | None = None) -> Column:
    """Fallback chain: the first value that is neither null nor blank."""
    filled = [tx.blank_to_null(c) for c in columns]
    if default is not None:
        filled.append(F.lit(default))
    return F.coalesce(*filled)


def clean_sentinel(col: Column) -> Column:
    """Null for the words that stand for "nothing read"."""
    value = tx.strip(col.cast("string"))
    return F.when(F.lower(value).isin(*SENTINELS), F.lit(None)).otherwise(value)


def district_typeahead(states: DataFrame, typed: str) -> DataFrame:
    """Per state, the districts whose name contains what was typed."""
    return states.withColumn(
        "districts", F.filter(F.col("districts"), lambda d: F.contains(F.lower(d), F.lit(typed.lower())))
    )
