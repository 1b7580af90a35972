"""Dashboards and registers over dockets, violations, checks and stages.

Every roll-up is a plain aggregate with map-side combine; "first record of a
key" is ``min_by`` on an explicit order instead of a window, so a key that owns
a third of the table still costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.filters import COMPLIANT_WORDS, NON_COMPLIANT_WORDS, REVIEW_WORDS, first_filled

# fixed values
COMPOUNDING_FEE = 25000
PORT_INSPECTION = "Port of Entry Inward"


def count_if(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def kpi_card(dockets: DataFrame) -> DataFrame:
    """All head-line counts in one pass over the dockets."""
    overall = F.col("overall_status")
    counted = dockets.agg(
        F.count(F.lit(1)).alias("total_scans"),
        count_if(overall.isin(*COMPLIANT_WORDS)).alias("compliant_count"),
        count_if(overall.isin(*NON_COMPLIANT_WORDS)).alias("non_compliant_count"),
        count_if(overall.isin(*REVIEW_WORDS)).alias("review_count"),
        F.sum("violation_count").cast("bigint").alias("violations_count"),
    )
    return counted.withColumn("compliance_rate", percent(F.col("compliant_count"), F.col("total_scans")))


def recent(df: DataFrame, order_by: str, tie: str, n: int = 5) -> DataFrame:
    """The newest ``n`` rows (a top-k report, planned as TakeOrdered)."""
    return df.orderBy(F.col(order_by).desc(), F.col(tie)).limit(n)


def page(df: DataFrame, order_by: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return df.orderBy(F.col(order_by).desc(), F.col(tie)).offset(offset).limit(limit)


def status_breakdown(dockets: DataFrame) -> DataFrame:
    """Count and share of the three dashboard statuses (one row per status)."""
    status = F.col("status")
    one_row = dockets.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(status == "Compliant").alias("compliant"),
        count_if(status == "Non-Compliant").alias("non_compliant"),
        count_if(status == "Under Review").alias("under_review"),
    )
    slices = F.array(
        F.struct(F.lit("Compliant Packages").alias("name"), F.col("compliant").alias("value")),
        F.struct(F.lit("Non-Compliant (Violations)").alias("name"), F.col("non_compliant").alias("value")),
        F.struct(F.lit("Under Officer Review").alias("name"), F.col("under_review").alias("value")),
    )
    return (
        one_row.select("total", F.explode(slices).alias("s"))
        .select("s.name", "s.value", percent(F.col("s.value"), F.col("total")).alias("rate"))
    )


def monthly_timeline(dockets: DataFrame) -> DataFrame:
    """Totals per month; a non-compliant docket without listed violations counts one."""
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("Current"))
    failed = F.col("status") == "Non-Compliant"
    return dockets.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("status") == "Compliant").alias("compliant"),
        F.sum(F.when(failed, F.greatest(F.col("violation_count"), F.lit(1))).otherwise(0)).cast("bigint").alias("violations"),
    )


def infraction_label(full: bool = True) -> Column:
    rule = F.nullif(F.col("rule_reference"), F.lit(""))
    if full:
        return F.coalesce(F.concat(rule, F.lit(" — "), F.col("violation_type")), F.col("violation_type"))
    return F.coalesce(rule, F.col("violation_type"))


def infraction_distribution(violations: DataFrame, full_label: bool = True) -> DataFrame:
    """Count and share per infraction.

    The total is a scalar subquery over the already reduced counts.
    """
    counts = violations.groupBy(infraction_label(full_label).alias("infraction")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", percent(F.col("n"), total))


def top_infractions(violations: DataFrame, n: int = 5, full_label: bool = True) -> DataFrame:
    ranked = infraction_distribution(violations, full_label)
    return ranked.orderBy(F.col("n").desc(), F.col("infraction")).limit(n)


def violations_by_category(dockets: DataFrame) -> DataFrame:
    n = F.when(F.col("violation_count") > 0, F.col("violation_count")).otherwise(
        F.when(F.col("status") == "Non-Compliant", 1).otherwise(0)
    )
    out = dockets.groupBy(first_filled(F.col("category"), default="General").alias("category")).agg(
        F.sum(n).cast("bigint").alias("violations")
    )
    return out.withColumn("compounding_fines", F.col("violations") * COMPOUNDING_FEE)


def zone_caseload(dockets: DataFrame) -> DataFrame:
    out = dockets.groupBy(first_filled(F.col("zone"), default="Default Zone").alias("zone")).agg(
        F.count(F.lit(1)).alias("inspections"),
        count_if(F.col("status") == "Compliant").alias("compliant"),
    )
    return out.withColumn("compliance_rate", percent(F.col("compliant"), F.col("inspections")))


def port_detentions(dockets: DataFrame) -> DataFrame:
    held = (F.col("inspection_type") == PORT_INSPECTION) & (F.col("status") == "Non-Compliant")
    return dockets.agg(
        count_if(held).alias("port_detentions"),
        F.sum("violation_count").cast("bigint").alias("violations"),
        (F.sum("violation_count") * COMPOUNDING_FEE).cast("bigint").alias("compounding_total"),
    )


def product_catalogue(dockets: DataFrame, ord_col: str = "ord") -> DataFrame:
    """One row per barcode (or name): attributes of the first record, summed violations."""
    key = first_filled(F.col("barcode"), F.col("product_name"))
    head = F.struct(
        F.col("id"), F.col("product_name").alias("name"), "barcode", "brand", "category", "manufacturer",
        F.col("status").alias("compliance_status"), F.col("created_at").alias("last_inspection_at"),
    )
    grouped = dockets.groupBy(key.alias("product_key")).agg(
        F.min_by(head, F.col(ord_col)).alias("h"),
        F.sum("violation_count").cast("bigint").alias("total_violations"),
        F.count(F.lit(1)).alias("records"),
    )
    return grouped.select("product_key", "h.*", "total_violations", "records")


def product_register(finalized: DataFrame, ts: str = "created_at", tie: str = "ord") -> DataFrame:
    """Running register: audits, violations, last status; the High risk mark sticks."""
    failed = F.col("status") == "Non-Compliant"
    latest = F.max_by(F.struct("status", ts, "id"), F.struct(F.col(ts), F.col(tie)))
    grouped = finalized.groupBy("product_name").agg(
        F.count(F.lit(1)).alias("total_audits"),
        count_if(failed).alias("total_violations"),
        F.max(F.when(failed, 1).otherwise(0)).alias("ever_failed"),
        latest.alias("last"),
    )
    return grouped.select(
        "product_name", "total_audits", "total_violations",
        F.when(F.col("ever_failed") == 1, "High").otherwise("Low").alias("market_risk_rating"),
        F.col("last.status").alias("compliance_status"),
        F.col(f"last.{ts}").alias("last_inspection_at"),
        F.col("last.id").alias("last_inspection_id"),
    )


def flatten_violations(dockets: DataFrame, violations: DataFrame) -> DataFrame:
    """Violations with the columns of their docket.

    Equi-join on the case id; a docket that owns many violations is split by
    the skew handling of adaptive execution.
    """
    parent = dockets.select(
        F.col("id").alias("case_id"), F.col("created_at").alias("inspection_date"),
        F.col("officer_name").alias("officer"), "product_name",
    )
    return violations.join(parent, "case_id")


def flatten_nested_violations(dockets: DataFrame) -> DataFrame:
    """Same for dockets that carry their violations as an array."""
    return dockets.select(
        F.col("id").alias("inspection_id"), F.col("created_at").alias("inspection_date"),
        F.col("officer_name").alias("officer"), F.inline("violations"),
    )


def report_summary(checks: DataFrame) -> DataFrame:
    """Per scan: rules evaluated, infractions, reviews, notice flag."""
    out = checks.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_rules_evaluated"),
        count_if(F.col("status") == "FAIL").alias("infractions_count"),
        count_if(F.col("status") == "NEEDS REVIEW").alias("needs_review_count"),
    )
    return out.withColumn("notice_issuance_recommended", F.col("infractions_count") > 0)


def check_status_counts(checks: DataFrame) -> DataFrame:
    """Per scan counters of the validation screen."""
    status = F.col("status")
    return checks.groupBy("scan_id").agg(
        count_if(status == "PASS").alias("pass_count"),
        count_if(status == "FAIL").alias("fail_count"),
        count_if(status.isin("NEEDS REVIEW", "UNREADABLE")).alias("review_count"),
        count_if(status == "NOT APPLICABLE").alias("not_applicable_count"),
        count_if(status != "NOT APPLICABLE").alias("applicable_count"),
    )


def notification_counts(dockets: DataFrame) -> DataFrame:
    pending = count_if(F.col("status") == "Under Review")
    failed = count_if(F.col("status") == "Non-Compliant")
    return dockets.agg(pending.alias("pending_reviews"), failed.alias("violations")).withColumn(
        "total_notifications",
        F.greatest(F.lit(2), F.col("pending_reviews") + F.when(F.col("violations") > 0, 1).otherwise(0)).cast("bigint"),
    )


def text_coverage(regions: DataFrame, image_area: Column) -> DataFrame:
    """Share of an image that is covered by text boxes, with region statistics."""
    grouped = regions.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("regions"),
        F.sum(F.col("width") * F.col("height")).alias("text_area"),
        F.avg("confidence").alias("mean_confidence"),
    )
    return grouped.withColumn("coverage_pct", F.round(F.col("text_area") * 100.0 / image_area, 2))


def stage_latency(progress: DataFrame) -> DataFrame:
    """Latency per pipeline stage from progress rows (``stage``, ``duration_ms``)."""
    return progress.groupBy("stage").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("duration_ms"), 4).alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", F.lit(0.95), F.lit(10000)).alias("p95_ms"),
    )


def kb_statistics(entries: DataFrame) -> DataFrame:
    """Knowledge-base size: entries, linked rules, tagged and dated entries."""
    return entries.agg(
        F.count(F.lit(1)).alias("total_entries"),
        count_if(F.col("rule_number").isNotNull()).alias("with_rule_number"),
        count_if(F.col("product_category").isNotNull()).alias("with_category"),
        count_if(F.col("effective_date").isNotNull()).alias("with_date"),
        F.count_distinct("source").alias("sources"),
    )


def extraction_quality(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy and error rates per field of boolean predictions against the truth.

    ``predicted`` has (keys, field, predicted); ``truth`` has (keys, field, actual).
    """
    both = predicted.join(truth, [*keys, "field"])
    hit = F.col("predicted") == F.col("actual")
    out = both.groupBy("field").agg(
        F.count(F.lit(1)).alias("samples"),
        count_if(hit).alias("correct"),
        count_if(F.col("predicted") & ~F.col("actual")).alias("false_positives"),
        count_if(~F.col("predicted") & F.col("actual")).alias("false_negatives"),
        count_if(F.col("actual")).alias("positives"),
    )
    return out.select(
        "field", "samples", "correct",
        F.round(F.col("correct") * 100.0 / F.col("samples"), 2).alias("accuracy_pct"),
        percent(F.col("false_positives"), F.col("samples") - F.col("positives"), 2).alias("false_positive_pct"),
        percent(F.col("false_negatives"), F.col("positives"), 2).alias("false_negative_pct"),
    )
