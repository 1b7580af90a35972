"""Rule gating, field validation, fingerprints and decisions."""

import hashlib
import json

from pyspark.sql import functions as F

from tallymark.operators import rules as ru
from tallymark.operators import violations as vi
from tallymark.sources import rules_library as lib

FIELDS = "product_id string, field_name string, value string, status string, confidence double, ord int"


def evaluate(spark, fields, rules=None, category="FOOD", strict=False):
    facts = ru.collect_facts(spark.createDataFrame(fields, FIELDS), ["PRODUCT_NAME", "NET_QUANTITY", "MRP", "MANUFACTURER_NAME", "MANUFACTURER_ADDRESS", "MANUFACTURING_DATE", "COUNTRY_OF_ORIGIN", "CONSUMER_CARE"])
    products = facts.withColumn("category", F.lit(category)).withColumn("category_status", F.lit("CONFIRMED")).withColumn("imported", F.lit(False))
    rules = lib.standard_rules(spark) if rules is None else rules
    pairs = ru.rules_for_products(products, rules, F.lit("2024-06-01").cast("date"))
    return ru.evaluate(ru.applicability(pairs), strict_reference=strict)


def statuses(df):
    return {r.rule_id: r.evaluation_status for r in df.collect()}


BASE = [("p", "PRODUCT_NAME", "Tea", "CONFIRMED", 0.9, 1), ("p", "NET_QUANTITY", "500 g", "CONFIRMED", 0.9, 2), ("p", "MRP", "MRP ₹120", "CONFIRMED", 0.9, 3)]


def test_confirmed_conflicting_and_missing(spark):
    got = statuses(evaluate(spark, BASE[:2] + [("p", "MRP", "₹120", "CONFLICT", 0.9, 3)]))
    assert got["RULE_06_NET_QUANTITY"] == "COMPLIANT" and got["RULE_06_MRP"] == "CONFLICT" and got["RULE_06_DATE"] == "NON_COMPLIANT" and got["RULE_06_COUNTRY_ORIGIN"] == "NOT_APPLICABLE"


def test_unknown_category_goes_to_review(spark):
    assert set(statuses(evaluate(spark, BASE, category="UNKNOWN")).values()) == {"NEEDS_REVIEW"}


def test_small_pack_exemption(spark):
    got = statuses(evaluate(spark, [BASE[0], ("p", "NET_QUANTITY", "8 g", "CONFIRMED", 0.9, 2)]))
    assert got["RULE_06_MRP"] == got["RULE_06_NET_QUANTITY"] == "NOT_APPLICABLE"


def test_not_visible_is_review_unless_strict(spark):
    fields = [("p", "PRODUCT_NAME", "Tea", "NOT_VISIBLE", 0.9, 1)]
    assert statuses(evaluate(spark, fields))["RULE_06_PRODUCT_NAME"] == "NEEDS_REVIEW"
    assert statuses(evaluate(spark, fields, strict=True))["RULE_06_PRODUCT_NAME"] == "COMPLIANT"


def test_unverified_and_expired_rules(spark):
    rules = lib.standard_rules(spark).filter("rule_id in ('RULE_06_PRODUCT_NAME', 'RULE_06_MRP')")
    rules = rules.withColumn("verification_status", F.when(F.col("rule_id") == "RULE_06_MRP", "UNVERIFIED").otherwise("VERIFIED"))
    rules = rules.withColumn("effective_until", F.when(F.col("rule_id") == "RULE_06_PRODUCT_NAME", F.lit("2012-01-01").cast("date")))
    assert statuses(evaluate(spark, BASE, rules)) == {"RULE_06_MRP": "NEEDS_REVIEW"}


def test_library_file(spark, tmp_path):
    doc = {"version": "v1", "rules": [{"rule_id": "RULE_06_1_E", "rule_no": "RULE 6", "sub_rule": "Rule 6(1)(e)", "rule_title": "Maximum Retail Price", "version_date": "2011-03-07", "verification_status": "MANDATORY"},
                                      {"rule_id": "RULE_21", "rule_title": "Net quantity checks", "verification_status": "draft"}]}
    (tmp_path / "lib.json").write_text(json.dumps(doc), encoding="utf-8")
    got = {r.rule_id: r for r in lib.read_rule_library(spark, str(tmp_path / "lib.json")).collect()}
    assert got["RULE_06_MRP"].required_fields == ["MRP"] and got["RULE_06_MRP"].requirement_type == "MRP" and got["RULE_06_MRP"].verification_status == "VERIFIED"
    assert got["RULE_21"].requirement_type == "NET_QUANTITY" and got["RULE_21"].verification_status == "UNVERIFIED"
    assert lib.find_rule(lib.standard_rules(spark), " 6(1)(e) ").first().rule_id == "RULE_06_MRP"


def test_fingerprint_is_stable(spark):
    text = "p:RULE_06_MRP:PRICE_DECLARATION_ISSUE:missing_declaration"
    got = spark.range(1).select(vi.fingerprint(F.lit("p"), F.lit("RULE_06_MRP"), F.lit("PRICE_DECLARATION_ISSUE"), F.lit(" Missing_Declaration "))).first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()[:32]


def test_same_violation_on_two_panels_counts_once(spark):
    rows = [("fp", "p", 1, 0.5, "FRONT"), ("fp", "p", 2, 0.9, "BACK"), ("fp", "p", 3, 0.4, "BACK")]
    df = spark.createDataFrame(rows, "fingerprint string, product_id string, ord int, confidence double, panel string")
    one = vi.deduplicate(df, "ord").collect()
    assert len(one) == 1 and one[0].confidence == 0.9 and one[0].panel == "FRONT"
    ev = df.selectExpr("fingerprint", "'i' as image_id", "panel", "'r' as region_id", "'' as bbox")
    assert vi.merge_evidence(ev).count() == 2
