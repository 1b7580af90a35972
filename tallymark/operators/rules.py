"""Rule evaluation: products by rules, applicability, field validation, roll-up.

A product is one row with a ``facts`` map: field name -> (value, status,
confidence).  The map holds only names from the rule vocabulary, so it is
bounded by the rule book and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tallymark.functions import text as tx

# fixed values
FACT_TYPE = "struct<value:string,status:string,confidence:double>"
SMALL_PACK_RULES = ("RULE_06_NET_QUANTITY", "RULE_06_MRP", "RULE_06_DATE")
SMALL_PACK_LIMIT = 10.0
IMPORT_FIELDS = ("IMPORTER_NAME", "IMPORTER_ADDRESS", "COUNTRY_OF_ORIGIN")
QUANTITY_PATTERN = r"([\d.]+)\s*(g|kg|ml|l|ltr|mg)"
MRP_NAMED = r"(?:m\.?r\.?p\.?|retail price)\s*(?:rs\.?|₹)?\s*([\d.,]+)"
MRP_CURRENCY = r"(?:rs\.?|₹)\s*([\d.,]+)"
NOT_AN_ADDRESS = (
    "ingredients:", "contains:", "aqua,", "sugar,", "salt,", "protein",
    "directions for use", "apply 3-4 drops", "do not bleach", "iron low",
    "choking hazard", "keep out of reach", "calories", "carbohydrate",
)
SEVERITY_ORDER = ("COMPLIANT", "NEEDS_REVIEW", "NON_COMPLIANT", "CONFLICT")

# Keys that rules for all categories are dealt out under.
SHARES = 64


def is_non_address(text: Column) -> Column:
    """Formulation, usage or nutrition text that must not pass as an address."""
    low = F.lower(text)
    test = F.lit(False)
    for word in NOT_AN_ADDRESS:
        test = test | F.contains(low, F.lit(word))
    return F.coalesce(test, F.lit(False))


def normal_price(text: Column) -> Column:
    """``₹n`` without thousands separators, or null."""
    low = F.lower(text)
    digits = tx.first_of(tx.grab(low, MRP_NAMED), tx.grab(low, MRP_CURRENCY))
    return F.concat(F.lit("₹"), F.replace(digits, F.lit(","), F.lit("")))


def quantity_in_base(text: Column) -> tuple[Column, Column]:
    """(amount, unit) with kilograms as grams and litres as millilitres."""
    low = F.lower(text)
    unit = tx.grab(low, QUANTITY_PATTERN, 2)
    amount = tx.grab(low, QUANTITY_PATTERN, 1).try_cast("double")
    base = F.when(unit == "kg", "g").when(unit.isin("l", "ltr"), "ml").otherwise(unit)
    return F.when(unit.isin("kg", "l", "ltr"), amount * 1000).otherwise(amount), base


def collect_facts(fields: DataFrame, vocabulary: list[str], key: str = "product_id", ord_col: str = "ord") -> DataFrame:
    """Long field rows to one ``facts`` map per product.

    First level: best row per (product, field), combined map-side.  Second
    level: at most ``len(vocabulary)`` entries per product.
    """
    name = F.upper("field_name")
    usable = F.coalesce(F.col("value"), F.lit("")) != ""
    best = (
        fields.filter(name.isin(*vocabulary))
        .groupBy(key, name.alias("field_name"))
        .agg(F.min_by(F.struct("value", "status", "confidence"), F.struct((~usable).alias("z"), F.col(ord_col))).alias("fact"))
    )
    return best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "fact"))).alias("facts"))


def rules_for_products(products: DataFrame, rules: DataFrame, target_date: Column, market: str = "RETAIL") -> DataFrame:
    """Pair every product with the rules that cover its category and date.

    An equi-join on the category key: the product's own and ``ALL``.  Rules for
    all stand under 64 keys and a product asks by one of them, so that no key
    holds half of the rows where the rule side is too large to be sent; Spark
    broadcasts it when its measured size allows.
    """
    per_category = rules.withColumn("cat", F.explode("categories")).withColumn("cat", F.upper("cat"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(SHARES - 1)), lambda i: F.concat(F.lit("ALL#"), i.cast("string")))
    per_category = per_category.withColumn("cat", F.explode(F.when(F.col("cat") == "ALL", shares).otherwise(F.array("cat"))))
    own = F.upper(F.coalesce(F.col("category"), F.lit("UNKNOWN")))
    plain = [f.name for f in products.schema.fields if isinstance(f.dataType, AtomicType)]
    share = F.concat(F.lit("ALL#"), F.pmod(F.xxhash64(*plain), F.lit(SHARES)).cast("string"))
    keyed = products.withColumn("target_date", target_date).withColumn("cat", F.explode(F.array(share, own)))
    valid = (
        (F.col("effective_from").isNull() | (F.col("target_date") >= F.col("effective_from")))
        & (F.col("effective_until").isNull() | (F.col("target_date") <= F.col("effective_until")))
    )
    return keyed.join(per_category, "cat").filter(valid).drop("cat").withColumn("market", F.lit(market.upper()))


def valid_rules(rules: DataFrame, category: str, target_date: str, verified_only: bool = True) -> DataFrame:
    day = F.lit(target_date).cast("date")
    kept = rules.filter(
        (F.array_contains("categories", "ALL") | F.array_contains("categories", category.upper()))
        & (F.col("effective_from").isNull() | (day >= F.col("effective_from")))
        & (F.col("effective_until").isNull() | (day <= F.col("effective_until")))
    )
    if verified_only:
        kept = kept.filter(F.col("verification_status") == "VERIFIED")
    return kept


def _fact(name: str) -> Column:
    return F.try_element_at(F.col("facts"), F.lit(name))


def _filled(fact: Column) -> Column:
    return F.coalesce(F.trim(fact["value"]), F.lit("")) != ""


def _first_fact(*names: str) -> Column:
    return F.coalesce(*[_fact(n) for n in names])


def applicability(pairs: DataFrame) -> DataFrame:
    """Add ``applicability_status`` and its reason to product-rule pairs."""
    category = F.upper(F.coalesce(F.col("category"), F.lit("UNKNOWN")))
    unclear = category.isin("UNKNOWN", "UNRESOLVED") | (F.col("category_status") == "NEEDS_REVIEW")
    wrong_market = ~F.upper("market_context").isin("ALL") & (F.upper("market_context") != F.col("market"))
    quantity = F.when(_filled(_fact("NET_QUANTITY")), _fact("NET_QUANTITY")["value"]).otherwise(_fact("NET_VOLUME")["value"])
    amount, unit = quantity_in_base(quantity)
    small = (F.col("rule_id").isin(*SMALL_PACK_RULES)) & (amount <= SMALL_PACK_LIMIT) & unit.isin("g", "ml")
    import_rule = F.contains(F.col("requirement_type"), F.lit("IMPORTER")) | F.array_contains("required_fields", "COUNTRY_OF_ORIGIN")
    imported = F.coalesce(F.col("imported"), F.lit(False))
    for name in IMPORT_FIELDS:
        imported = imported | F.coalesce(_filled(_fact(name)), F.lit(False))
    status = (
        F.when(F.coalesce(unclear, F.lit(False)), "NEEDS_REVIEW")
        .when(F.coalesce(wrong_market | small, F.lit(False)), "NOT_APPLICABLE")
        .when(import_rule & ~imported, "NOT_APPLICABLE")
        .otherwise("APPLICABLE")
    )
    reason = (
        F.when(F.coalesce(unclear, F.lit(False)), "Unknown category")
        .when(F.coalesce(wrong_market, F.lit(False)), "Market context mismatch")
        .when(F.coalesce(small, F.lit(False)), "Small package exemption")
        .when(import_rule & ~imported, "Domestic product")
        .otherwise("Rule applies to the product")
    )
    return pairs.withColumn("applicability_status", status).withColumn("applicability_reason", reason)


def _quantity_status() -> Column:
    f = _first_fact("NET_QUANTITY", "NET_VOLUME")
    return (
        F.when((f["status"] == "CONFIRMED") & _filled(f), "COMPLIANT")
        .when(f["status"].isin("NEEDS_REVIEW", "UNKNOWN", "NOT_VISIBLE", "CONFLICT"), f["status"])
        .otherwise("NON_COMPLIANT")
    )


def _price_status() -> Column:
    f = _fact("MRP")
    return (
        F.when((f["status"] == "CONFIRMED") & normal_price(F.trim(f["value"])).isNotNull(), "COMPLIANT")
        .when(f["status"].isin("NEEDS_REVIEW", "CONFLICT", "NOT_VISIBLE", "UNKNOWN"), f["status"])
        .otherwise("NON_COMPLIANT")
    )


def _role_fact(role: str, part: str) -> Column:
    return _first_fact(f"{role}_{part}", role) if part == "NAME" else _fact(f"{role}_{part}")


def _entity_status(role: str) -> Column:
    f = _role_fact(role, "NAME")
    entity = _fact(f"ENTITY_{role}_NAME")
    return (
        F.when(_filled(f), F.when(f["status"] == "CONFIRMED", "COMPLIANT").otherwise("NEEDS_REVIEW"))
        .when(_filled(entity) & (entity["value"] != "NOT_VISIBLE"), "COMPLIANT")
        .otherwise("NON_COMPLIANT")
    )


def _address_status(role: str) -> Column:
    f = _fact(f"{role}_ADDRESS")
    entity = _fact(f"ENTITY_{role}_ADDRESS")
    good = _filled(f) & ~is_non_address(f["value"]) & (f["status"] == "CONFIRMED")
    return (
        F.when(F.coalesce(good, F.lit(False)), "COMPLIANT")
        .when(_filled(entity) & ~is_non_address(entity["value"]), "COMPLIANT")
        .otherwise("NON_COMPLIANT")
    )


def _generic_status(name: Column) -> Column:
    f = F.try_element_at(F.col("facts"), name)
    return F.when(
        _filled(f) & f["status"].isin("CONFIRMED", "CONFLICT", "NOT_VISIBLE", "UNKNOWN", "NEEDS_REVIEW"),
        F.when(f["status"] == "CONFIRMED", "COMPLIANT").otherwise(f["status"]),
    ).otherwise("NON_COMPLIANT")


def field_status(name: Column) -> Column:
    """Verdict on one required field of a declaration rule."""
    upper = F.upper(name)
    out = _generic_status(upper)
    for role in ("PACKER", "IMPORTER", "MANUFACTURER"):
        verdict = F.when(F.contains(upper, F.lit("ADDRESS")), _address_status(role)).otherwise(_entity_status(role))
        out = F.when(F.contains(upper, F.lit(role)), verdict).otherwise(out)
    return out


def evaluate(pairs: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Evaluate product-rule pairs that already carry their applicability.

    A required field that is only NOT_VISIBLE or UNKNOWN sends the rule to
    review; ``strict_reference`` lets it pass as compliant instead.
    """
    statuses = F.transform(F.col("required_fields"), field_status)
    seen = lambda *words: F.exists(statuses, lambda s: s.isin(*words))
    review_words = ("NEEDS_REVIEW",) if strict_reference else ("NEEDS_REVIEW", "NOT_VISIBLE", "UNKNOWN")
    declared = (
        F.when(seen("CONFLICT"), "CONFLICT")
        .when(seen("NON_COMPLIANT"), "NON_COMPLIANT")
        .when(seen(*review_words), "NEEDS_REVIEW")
        .otherwise("COMPLIANT")
    )
    kind = F.upper("requirement_type")
    checked = (
        F.when(kind == "NET_QUANTITY", _quantity_status())
        .when(kind == "MRP", _price_status())
        .when(kind.isin("DECLARATION", "CONSUMER_CARE", "IMPORTER"), declared)
        .otherwise("COMPLIANT")
    )
    unverified = F.col("verification_status") != "VERIFIED"
    unsure = F.col("applicability_status").isin("NEEDS_REVIEW", "UNKNOWN")
    skipped = F.col("applicability_status") == "NOT_APPLICABLE"
    status = (
        F.when(unverified, "NEEDS_REVIEW").when(skipped, "NOT_APPLICABLE").when(unsure, "NEEDS_REVIEW").otherwise(checked)
    )
    confidence = F.when(unverified, 0.5).when(skipped, 1.0).when(unsure, 0.5).otherwise(0.95)
    first_field = F.get("required_fields", F.lit(0))
    observed = (
        F.when(kind == "NET_QUANTITY", F.trim(_first_fact("NET_QUANTITY", "NET_VOLUME")["value"]))
        .when(kind == "MRP", F.coalesce(normal_price(_fact("MRP")["value"]), F.trim(_fact("MRP")["value"])))
        .otherwise(F.get(F.filter(F.transform("required_fields", lambda n: F.trim(F.try_element_at(F.col("facts"), n)["value"])), lambda v: v.isNotNull() & (v != "")), F.lit(0)))
    )
    gated = unverified | skipped | unsure
    return pairs.select(
        *pairs.columns,
        status.alias("evaluation_status"),
        confidence.alias("confidence"),
        F.when(~gated, F.nullif(observed, F.lit(""))).alias("observed_value"),
        first_field.alias("observed_field"),
    )


def trace(evaluations: DataFrame) -> DataFrame:
    """Machine-readable reasoning per evaluation."""
    steps = F.array_compact(F.array(
        F.concat(F.lit("Rule verification status: "), F.col("verification_status")),
        F.concat(F.lit("Applicability status: "), F.col("applicability_status"), F.lit(" ("), F.col("applicability_reason"), F.lit(")")),
        F.when(F.col("verification_status") != "VERIFIED", "automatic evaluation disabled"),
        F.when(F.col("applicability_status") == "NOT_APPLICABLE", "skipped"),
        F.concat(F.lit("Evaluation: "), F.col("evaluation_status")),
    ))
    return evaluations.withColumn("trace_steps", steps).withColumn("applicable", F.col("applicability_status") == "APPLICABLE")


def worst_status(status: Column, kinds: dict[str, int], names: dict[int, str]) -> Column:
    """Worst-of roll-up as ``max`` over severity ranks, mapped back to names."""
    rank = F.lit(0)
    for word, value in kinds.items():
        rank = F.when(status == word, F.lit(value)).otherwise(rank)
    top = F.max(rank)
    out = F.lit(names[0])
    for value, word in names.items():
        out = F.when(top == value, F.lit(word)).otherwise(out)
    return out


def roll_up(evaluations: DataFrame, *keys: str, status_col: str = "evaluation_status") -> DataFrame:
    """Overall status per key: any failure, else any review, else compliant."""
    overall = worst_status(
        F.col(status_col),
        {"NEEDS_REVIEW": 1, "CONFLICT": 1, "NON_COMPLIANT": 2},
        {0: "COMPLIANT", 1: "NEEDS_REVIEW", 2: "NON_COMPLIANT"},
    )
    return evaluations.groupBy(*keys).agg(overall.alias("overall_status"), F.count(F.lit(1)).alias("evaluated"))
