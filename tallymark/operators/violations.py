"""Violations and review items from rule evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.analytics import count_if


def route(evaluations: DataFrame) -> DataFrame:
    """Decide per evaluation: ``skip``, ``compliant``, ``review`` or ``violation``."""
    status, applies = F.col("evaluation_status"), F.col("applicability_status")
    out = (
        F.when((applies == "NOT_APPLICABLE") | (status == "NOT_APPLICABLE"), "skip")
        .when(status == "COMPLIANT", "compliant")
        .when(status.isin("NEEDS_REVIEW", "CONFLICT", "UNKNOWN", "NOT_VISIBLE") | applies.isin("NEEDS_REVIEW", "UNKNOWN"), "review")
        .when((status == "NON_COMPLIANT") & (applies == "APPLICABLE"), "violation")
        .otherwise("skip")
    )
    return evaluations.withColumn("route", out)


def violation_type(rule_id: Column, title: Column) -> Column:
    up, low = F.upper(rule_id), F.lower(title)
    has = lambda c, w: F.contains(c, F.lit(w))
    return (
        F.when(has(up, "NET_QUANTITY") | has(low, "quantity"), "QUANTITY_NON_COMPLIANCE")
        .when(has(up, "MRP") | has(low, "price"), "PRICE_DECLARATION_ISSUE")
        .when(has(up, "DATE") | has(low, "month"), "DATE_DECLARATION_ISSUE")
        .when(has(up, "NAME_ADDRESS") | has(low, "manufacturer") | has(low, "packer"), "ENTITY_INFORMATION_ISSUE")
        .when(has(up, "CONSUMER_CARE") | has(low, "consumer"), "CONSUMER_INFORMATION_ISSUE")
        .when(has(up, "PRODUCT_NAME") | has(low, "generic name"), "MISSING_REQUIRED_DECLARATION")
        .otherwise("OTHER_VERIFIED_NON_COMPLIANCE")
    )


def review_reason(status: Column, applies: Column) -> Column:
    return (
        F.when(applies.isin("NEEDS_REVIEW", "UNKNOWN"), "AMBIGUOUS_APPLICABILITY")
        .when(status == "CONFLICT", "CONFLICTING_DECLARATIONS")
        .when(status == "NOT_VISIBLE", "NOT_VISIBLE")
        .when(status == "UNKNOWN", "UNKNOWN_STATUS")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


def description(rule_number: Column, title: Column, observed: Column) -> Column:
    """Neutral, factual wording; absent and defective declarations read differently."""
    rule = F.concat(rule_number, F.lit(" ("), title, F.lit(")"))
    return F.when(
        observed.isNotNull(),
        F.concat(F.lit("Declaration for "), rule, F.lit(" was observed as '"), observed,
                 F.lit("' and evaluated as non-compliant under statutory rule verification.")),
    ).otherwise(
        F.concat(F.lit("Mandatory declaration for "), rule, F.lit(" was not found on available product package panels."))
    )


def fingerprint(product_id: Column, rule_id: Column, kind: Column, issue: Column) -> Column:
    """Stable identity of an issue: same inputs, same 32 hex digits."""
    text = F.concat_ws(":", product_id, rule_id, kind, F.lower(F.trim(F.coalesce(issue, F.lit("")))))
    return F.substring(F.sha2(text, 256), 1, 32)


def violation_rows(routed: DataFrame, product: str = "product_id") -> DataFrame:
    kind = violation_type(F.col("rule_id"), F.col("title"))
    issue = F.coalesce(F.col("observed_value"), F.lit("missing_declaration"))
    return routed.filter(F.col("route") == "violation").select(
        product, "rule_id", "rule_number", F.col("title").alias("requirement"),
        kind.alias("violation_type"), "observed_value", "confidence",
        description(F.col("rule_number"), F.col("title"), F.col("observed_value")).alias("description"),
        fingerprint(F.col(product), F.col("rule_id"), kind, issue).alias("fingerprint"),
    )


def review_rows(routed: DataFrame, product: str = "product_id") -> DataFrame:
    """Review queue.  Items are kept one per evaluation, not deduplicated."""
    reason = review_reason(F.col("evaluation_status"), F.col("applicability_status"))
    item_id = F.substring(F.sha2(F.concat_ws(":", F.col(product), F.col("rule_id"), reason), 256), 1, 16)
    return routed.filter(F.col("route") == "review").select(
        item_id.alias("review_id"), product, "rule_id", "rule_number", reason.alias("reason"),
        F.concat(F.lit("Rule "), F.col("rule_number"), F.lit(" evaluation status '"), F.col("evaluation_status"),
                 F.lit("' requires manual review (Reason: "), reason, F.lit(").")).alias("description"),
    )


def deduplicate(violations: DataFrame, ord_col: str) -> DataFrame:
    """One row per fingerprint: attributes of the first report, highest confidence."""
    body = F.struct(*[F.col(c) for c in violations.columns if c not in ("fingerprint", "confidence", ord_col)])
    return violations.groupBy("fingerprint").agg(
        F.min_by(body, F.col(ord_col)).alias("v"), F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("reports"),
    ).select("fingerprint", "v.*", "confidence", "reports")


def merge_evidence(evidence: DataFrame) -> DataFrame:
    """Distinct evidence per fingerprint, kept long so that no group is collected."""
    return evidence.dropDuplicates(["fingerprint", "image_id", "panel", "region_id", "bbox"])


def summary(routed: DataFrame, *keys: str) -> DataFrame:
    """Counts per product (or per session) and the overall status.

    One aggregate over the routed evaluations; a product meets a rule once, so
    its violations are distinct already.
    """
    kind = F.col("route")
    out = routed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        count_if(kind == "violation").alias("confirmed_violations"),
        count_if(kind == "review").alias("needs_review_items"),
        count_if(F.col("evaluation_status") == "COMPLIANT").alias("compliant_rules"),
        count_if((F.col("applicability_status") == "NOT_APPLICABLE") | (F.col("evaluation_status") == "NOT_APPLICABLE")).alias("not_applicable_rules"),
        count_if(F.col("evaluation_status").isin("NEEDS_REVIEW", "CONFLICT")).alias("undecided_rules"),
    )
    return out.withColumn("overall_status", overall_from_counts())


def overall_from_counts() -> Column:
    return (
        F.when(F.col("confirmed_violations") > 0, "NON_COMPLIANT")
        .when(F.col("needs_review_items") > 0, "NEEDS_REVIEW")
        .otherwise("COMPLIANT")
    )


def session_summary(product_summaries: DataFrame, key: str = "session_id") -> DataFrame:
    names = ("total_evaluations", "confirmed_violations", "needs_review_items", "compliant_rules", "not_applicable_rules")
    out = product_summaries.groupBy(key).agg(F.count(F.lit(1)).alias("products"), *[F.sum(n).alias(n) for n in names])
    return out.withColumn("overall_status", overall_from_counts())


def assemble_results(products: DataFrame, counts: DataFrame, key: str = "product_id") -> DataFrame:
    """Final row per product from the summary of its evaluations.

    Evaluations and violations are counted in the same pass, so the assembly is
    one left join of pre-aggregated rows.
    """
    c = counts.select(key, "total_evaluations", "confirmed_violations", "needs_review_items", "compliant_rules", "not_applicable_rules", "undecided_rules")
    joined = products.join(c, key, "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("bigint")
    status = (
        F.when(zero("confirmed_violations") > 0, "NON_COMPLIANT")
        .when((zero("needs_review_items") > 0) | (zero("undecided_rules") > 0), "NEEDS_REVIEW")
        .otherwise("COMPLIANT")
    )
    return joined.select(
        *products.columns, zero("total_evaluations").alias("rules_evaluated"), zero("compliant_rules").alias("compliant"),
        zero("confirmed_violations").alias("non_compliant"), zero("needs_review_items").alias("needs_review"),
        zero("not_applicable_rules").alias("not_applicable"), status.alias("overall_status"),
    )


def apply_decisions(violations: DataFrame, decisions: DataFrame, key: str = "violation_id", case: str = "case_id") -> DataFrame:
    """Officer decisions: the latest one counts, dismissed violations drop out.

    Returns per case the active count and the resulting status.
    """
    last = decisions.groupBy(key).agg(F.max_by("officer_status", F.struct("ts", "seq")).alias("officer_status"))
    marked = violations.join(last, key, "left")
    active = F.coalesce(F.col("officer_status"), F.lit("Needs Review")) != "Dismissed"
    out = marked.groupBy(case).agg(F.count(F.lit(1)).alias("violations"), count_if(active).alias("active_violations"))
    return out.withColumn("status", F.when(F.col("active_violations") > 0, "Non-Compliant").otherwise("Compliant"))


def drop_tax_violations(violations: DataFrame, edits: DataFrame, case: str = "case_id") -> DataFrame:
    """An edit that adds the tax phrase removes the tax violations of that case."""
    low = F.lower("value")
    cured = edits.filter(F.contains(low, F.lit("inclusive of all taxes")) | F.contains(low, F.lit("incl. of all taxes"))).select(case).distinct()
    tax = F.contains(F.lower("violation_type"), F.lit("tax"))
    return violations.filter(~tax).unionByName(violations.filter(tax).join(cured, case, "left_anti"))


def merge_violation_sets(parser: DataFrame, engine: DataFrame, scan: str = "scan_id", ord_col: str = "ord") -> DataFrame:
    """Parser violations plus the engine's, one per (scan, violation type)."""
    known = parser.select(scan, "violation_type").distinct()
    fresh = engine.join(known, [scan, "violation_type"], "left_anti")
    body = F.struct(*[F.col(c) for c in engine.columns if c not in (scan, "violation_type")])
    one = fresh.groupBy(scan, "violation_type").agg(F.min_by(body, F.col(ord_col)).alias("b")).select(scan, "violation_type", "b.*")
    return parser.unionByName(one, allowMissingColumns=True)


def vet_and_cite(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop reports refuted by their own evidence and attach the rule citation.

    A PIN complaint whose text shows a PIN is dropped, as is an address
    complaint that quotes an ingredient list.
    """
    low = F.lower("evidence_text")
    pin_refuted = F.contains(F.lower("violation_type"), F.lit("pin")) & F.col("evidence_text").rlike(r"\b[1-9][0-9]{5}\b")
    quoted = low.rlike(r"\b(?:ingredients?|aqua|glycerin|parfum)\b")
    kept = violations.filter(~F.coalesce(pin_refuted | quoted, F.lit(False)))
    cite = rules.select("rule_id", F.col("rule_number").alias("cited_rule"), F.col("title").alias("cited_title"))
    return kept.join(cite, "rule_id", "left")
