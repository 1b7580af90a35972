"""Statutory check matrix, scores, adaptive schema, risk, quality, jurisdiction.

The matrix is one array of structs per label, exploded into rows: every label
meets every rule without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import text as tx
from tallymark.operators.analytics import count_if

# fixed values: commodity words of the special provisions
GARMENT = ("garment", "hosiery", "shirt", "pant", "apparel", "clothing", "dress", "t-shirt", "trouser", "kurta", "jeans", "socks")
ELECTRONIC = ("electronic", "phone", "device", "gadget", "charger", "cable", "battery", "audio", "tv", "earphone", "headphones", "tablet", "laptop", "bulb")
PAN_MASALA = ("pan masala", "gutkha", "supari", "zarda")
EDIBLE_OIL = ("edible oil", "mustard oil", "sunflower oil", "soyabean oil", "ghee", "vanaspati", "fat")
MEDICAL = ("medical", "device", "surgical", "diagnostic", "bandage", "implant", "sanitizer")
MICRO_LIMIT, BULK_LIMIT = 10.0, 25.0
FORMULATION = ("aqua", "salicylic", "glycerin", "direction", "apply generously", "niacinamide", "sorbitan", "stearic", "octyl", "parfum", "tocopherol")
ALWAYS_PASS = ["RULE 1", "RULE 2", "RULE 5", "RULE 6(1)(g)", "RULE 6(11)", "RULE 8", "RULE 9", "RULE 11", "RULE 12", "RULE 6(10) E-COMMERCE",
               *[f"RULE {n}" for n in range(14, 32) if n != 26], "RULE 34"]
PASS, FAIL, REVIEW, NA = "PASS", "FAIL", "NEEDS REVIEW", "NOT APPLICABLE"

# Columns a fact row must have; absent ones are filled with null.
FACTS = {
    "product_name": "string", "commodity_name": "string", "net_value": "double", "net_unit": "string", "net_prohibited": "boolean", "net_conflict": "boolean",
    "mfd": "string", "mfd_uncertain": "boolean", "pkd": "string", "expiry": "string", "mrp_amount": "double", "tax_phrase": "boolean", "mrp_conflict": "boolean",
    "mrp_uncertain": "boolean", "phone": "string", "email": "string", "batch": "string", "maker_name": "string", "maker_address": "string", "maker_pin": "string",
    "marketer_name": "string", "marketer_pin": "string", "degraded": "boolean", "front_only": "boolean", "height_calibrated": "boolean", "height_ok": "boolean",
    "evidence_text": "string",
}


def with_facts(df: DataFrame) -> DataFrame:
    for name, kind in FACTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _words(low: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w))
    return test


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def statutory_checks(facts: DataFrame, key: str) -> DataFrame:
    """Array ``checks`` of (rule, status) per label, before vetoes and roll-ups."""
    f = with_facts(facts)
    low = F.lower(F.concat_ws(" ", "commodity_name", "product_name"))
    net = F.coalesce("net_value", F.lit(0.0))
    f = f.withColumn("_low", low)
    low = F.col("_low")
    pan, micro = _words(low, PAN_MASALA), (net > 0) & (net <= MICRO_LIMIT) & F.coalesce(F.col("net_unit").isin("g", "ml"), F.lit(False))
    exempt = micro & ~pan
    degraded, front = _yes("degraded"), _yes("front_only")
    maker, address, pin = _filled("maker_name"), _filled("maker_address"), F.length(F.coalesce("maker_pin", F.lit(""))) == 6
    mk, mk_pin = _filled("marketer_name"), F.length(F.coalesce("marketer_pin", F.lit(""))) == 6
    bulk = (net > BULK_LIMIT) & F.coalesce(F.col("net_unit").isin("kg", "l"), F.lit(False))
    named = _filled("product_name") & (F.col("product_name") != "Packaged Commodity")
    generic = _filled("commodity_name") & (F.col("commodity_name") != "Packaged Commodity")
    price = F.coalesce("mrp_amount", F.lit(0.0))
    bad_unit = _yes("net_prohibited")
    lenient = degraded | front
    only = lambda test: F.when(test, PASS).otherwise(NA)
    medical = _words(low, MEDICAL)
    status = {
        "RULE 3": F.when(bulk, NA).otherwise(PASS),
        "RULE 4": F.when(~named & degraded, REVIEW).when(named, PASS).otherwise(FAIL),
        "RULE 6(1)(a)": F.when(maker & pin, PASS).when(maker, FAIL).when(mk, F.when(mk_pin, REVIEW).otherwise(FAIL))
            .when(~address, F.when(lenient, REVIEW).otherwise(FAIL)).otherwise(FAIL),
        "RULE 6(1)(b)": F.when(generic, PASS).otherwise(FAIL),
        "RULE 6(1)(c)": F.when(_yes("net_conflict"), REVIEW).when(net == 0, F.when(degraded, REVIEW).otherwise(FAIL)).when(bad_unit, FAIL).otherwise(PASS),
        "RULE 6(1)(d)": F.when(exempt, NA).when(_yes("mfd_uncertain"), REVIEW).when(_filled("pkd"), PASS).when(~_filled("mfd"), F.when(lenient, REVIEW).otherwise(FAIL)).otherwise(PASS),
        "RULE 6(1)(da)": only(_filled("expiry")),
        "RULE 6(1)(e)": F.when(_yes("mrp_conflict") | _yes("mrp_uncertain"), REVIEW).when(price == 0, F.when(degraded, REVIEW).otherwise(FAIL)).when(~_yes("tax_phrase"), FAIL).otherwise(PASS),
        "RULE 6(1)(f)": F.when(exempt, NA).when(_filled("phone") | _filled("email"), PASS).when(lenient, REVIEW).otherwise(FAIL),
        "RULE 7": F.when(medical, PASS).when(~F.coalesce("height_calibrated", F.lit(True)), REVIEW).when(F.coalesce("height_ok", F.lit(True)), PASS).otherwise(FAIL),
        "RULE 10": F.when(mk & mk_pin & ~address, REVIEW).when(~address, F.when(lenient, REVIEW).otherwise(FAIL)).when(pin, PASS).otherwise(FAIL),
        "RULE 13": F.when((net > 0) & ~bad_unit, PASS).otherwise(FAIL),
        "RULE 33": F.lit(NA),
        "RULE 26(a)": F.when(micro, PASS).otherwise(NA),
        "RULE 26(e)": only(_words(low, GARMENT)),
        "RULE 6(1) PROVISO": only(_words(low, ELECTRONIC)),
        "RULE PAN MASALA": only(pan),
        "SOP EDIBLE OIL": only(_words(low, EDIBLE_OIL)),
        "RULE GSR 226(E)": only(medical),
    }
    entries = [F.struct(F.lit(rule).alias("rule_no"), s.alias("status")) for rule, s in status.items()]
    entries += [F.struct(F.lit(rule).alias("rule_no"), F.lit(PASS).alias("status")) for rule in ALWAYS_PASS]
    # Built in blocks, so that no generated method grows past its limit.
    blocks = [F.array(*entries[i:i + 8]) for i in range(0, len(entries), 8)]
    return f.select(key, "degraded", "marketer_name", "marketer_pin", "maker_address", "evidence_text", F.concat(*blocks).alias("checks"))


def settle(labels: DataFrame, key: str) -> DataFrame:
    """Degraded-image override, evidence veto, then rules 32 and 32A from the remaining failures.

    All of it happens on the array of the label's own row; the result is one
    row per (label, rule) and nothing has been shuffled.
    """
    marketed = _filled("marketer_name") & (F.length(F.coalesce("marketer_pin", F.lit(""))) == 6)
    refuted = _words(F.lower(F.concat_ws(" ", F.coalesce("maker_address", F.lit("")), F.coalesce("evidence_text", F.lit("")))), FORMULATION)
    d = labels.withColumn("_degraded", _yes("degraded")).withColumn("_vetoed", marketed | refuted)

    def own(c: Column) -> Column:
        soft = F.col("_degraded") | (F.col("_vetoed") & c["rule_no"].isin("RULE 6(1)(a)", "RULE 10"))
        return F.struct(c["rule_no"].alias("rule_no"), F.when((c["status"] == FAIL) & soft, REVIEW).otherwise(c["status"]).alias("status"))

    def derived(cs: Column) -> Column:
        verdict = F.when(F.exists(cs, lambda c: c["status"] == FAIL), FAIL).otherwise(PASS)
        return F.concat(cs, F.array(*[F.struct(F.lit(r).alias("rule_no"), verdict.alias("status")) for r in ("RULE 32", "RULE 32A")]))

    return d.select(key, F.inline(tx.let(F.transform("checks", own), derived)))


def check_counts(checks: DataFrame, key: str) -> DataFrame:
    """Counts per status and the overall status of each label, in one pass."""
    status = F.col("status")
    g = checks.groupBy(key).agg(
        count_if(status == PASS).alias("passed"), count_if(status == FAIL).alias("failed"), count_if(status == REVIEW).alias("reviews"), count_if(status == NA).alias("not_applicable"))
    return g.withColumn("overall_status", F.when(F.col("failed") > 0, "NON_COMPLIANT").when(F.col("reviews") > 0, "NEEDS_REVIEW").otherwise("COMPLIANT"))


def score(formula: str = "ratio", degraded: Column | None = None) -> Column:
    """Score from the columns of ``check_counts``.

    ``ratio``: passed share of passed and failed.  ``penalty``: 100 less 12 per
    failure, at least 20; 80 with open reviews, 65 for a degraded clean label.
    ``capped``: ratio, at most 85 while only reviews are open.
    """
    ratio = F.bround(F.col("passed") * 100.0 / F.greatest(F.lit(1), F.col("passed") + F.col("failed")), 0)
    if formula == "penalty":
        value = F.when(F.col("failed") > 0, F.greatest(F.lit(20), 100 - F.col("failed") * 12)).when(F.col("reviews") > 0, 80).otherwise(100)
        value = value if degraded is None else F.when(degraded & (F.col("failed") == 0), 65).otherwise(value)
    elif formula == "capped":
        value = F.when((F.col("failed") == 0) & (F.col("reviews") > 0), F.least(F.lit(85.0), ratio)).otherwise(ratio)
    else:
        value = ratio
    return value.cast("int")


def dossier(checks: DataFrame, key: str) -> DataFrame:
    """PASS, FAIL and review rule lists per label.

    The lists are bounded by the rule book (one entry per rule).
    """
    pick = lambda *words: F.array_join(F.sort_array(F.collect_set(F.when(F.col("status").isin(*words), F.col("rule_no")))), "; ")
    g = checks.groupBy(key).agg(pick(PASS).alias("compliant_rules"), pick(FAIL).alias("violated_rules"), pick(REVIEW, "WARN", "NOT DETECTED").alias("review_rules"))
    return g.withColumn("overall_status", F.when(F.col("violated_rules") != "", "NON_COMPLIANT").when(F.col("review_rules") != "", "NEEDS_REVIEW").otherwise("COMPLIANT"))


# --- rules of the client ---------------------------------------------------------------

STANDARD_PACKS = (25, 50, 75, 100, 150, 200, 250, 500, 1000, 2000, 5000)
DIMENSIONAL = r"(?i)cable|wire|rope|sheet|curtain|towel|garment|bedsheet"
SI_QUANTITY = r"(?i)^\d+(?:\.\d+)?\s*(?:g|kg|ml|l|count|piece|unit|n|u)\b"


def _leading_number(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def client_applicability(attributes: Column, net: Column, name: Column) -> Column:
    """array<struct<rule_id,applicable>> from product attributes (``product_attributes``)."""
    value = _leading_number(net)
    large_unit = tx.has(net, r"(?i)kg|l\b|litre")
    small_unit = tx.has(F.regexp_replace(net, r"^[\d.\s]+", ""), r"(?i)^(?:g|gm|ml)\b")
    multi = attributes["is_multipack"]
    rules = {
        "RULE-3": ~(large_unit & (value > BULK_LIMIT)),
        "RULE-5": attributes["is_scheduled"],
        "RULE-6-1-A": F.lit(True),
        "RULE-6-1-DA": attributes["is_perishable"] | attributes["product_type"].isin("Food", "Cosmetic/toiletry"),
        "RULE-6-11": multi | ~((small_unit & (value < 1000)) | (large_unit & (value <= 1))),
        "RULE-6-1-G": (attributes["product_type"] == "Clothing/textile") | tx.has(name, DIMENSIONAL),
        "RULE-7": F.lit(False), "RULE-24": F.lit(False), "RULE-14": multi, "RULE-15": multi, "RULE-16": F.lit(False),
        "RULE-26": tx.has(net, r"(?i)(?:g|gm|ml)\b") & (value <= MICRO_LIMIT) & (value > 0),
    }
    return F.array(*[F.struct(F.lit(r).alias("rule_id"), F.coalesce(v, F.lit(False)).alias("applicable")) for r, v in rules.items()])


def client_checks(net: Column, mrp_text: Column, tax_text: Column, maker: Column, address: Column, marketer: Column, marketer_pin: Column, packer: Column, packer_address: Column,
                  mfd: Column, expiry: Column, usp: Column, phone: Column, dims: Column, generic: Column) -> Column:
    """array<struct<rule_id,status>> of the client's own checks."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    pin = tx.has(address, lx.PIN)
    formulation = tx.has(address, r"(?i)(?:aqua|water|glycerin|salicylic|octocrylene|phenoxyethanol|apply\s*evenly|direction)")
    si = tx.has(net, SI_QUANTITY) & ~tx.has(net, r"(?i)when\s*packed")
    tax = tx.has(mrp_text, r"(?i)incl(?:usive)?\s*(?:of)?\s*all\s*taxes") | tx.has(tax_text, r"(?i)incl(?:usive)?\s*(?:of)?\s*all\s*taxes")
    prices = F.regexp_count(F.coalesce(mrp_text, F.lit("")), F.lit(r"(?i)₹|rs\.?"))
    rules = {
        "RULE-5": F.when(_leading_number(net).isin(*[float(v) for v in STANDARD_PACKS]), PASS).otherwise(REVIEW),
        "RULE-6-1-A": F.when(full(maker) & full(address) & pin & ~formulation, PASS).when(~full(maker) & full(marketer) & full(marketer_pin), REVIEW)
            .when(full(packer) & tx.has(packer_address, lx.PIN), PASS)
            .when(full(maker) & full(address) & ~pin & ~formulation & tx.has(address, r"(?i)address|road|street|nagar|plot|phase|industrial|city"), FAIL)
            .when(formulation, REVIEW).otherwise(FAIL),
        "RULE-6-1-B": F.when(full(generic), PASS).otherwise(FAIL),
        "RULE-6-1-C": F.when(full(net) & si & ~tx.has(net, r"(?i)per\s*100"), PASS).when(full(net) & ~si, FAIL).otherwise(REVIEW),
        "RULE-6-1-D": F.when(full(mfd) & ~tx.has(mfd, r"\?"), PASS).otherwise(REVIEW),
        "RULE-6-1-DA": F.when(full(expiry), PASS).otherwise(REVIEW),
        "RULE-6-1-E": F.when(prices > 2, REVIEW).when(full(mrp_text) & tax, PASS).when(full(mrp_text), FAIL).otherwise(REVIEW),
        "RULE-6-11": F.when(full(usp), PASS).otherwise(FAIL),
        "RULE-6-1-F": F.when(full(phone), PASS).otherwise(REVIEW),
        "RULE-6-1-G": F.when(full(dims), PASS).otherwise(FAIL),
        "RULE-10": F.when(full(address) & pin, PASS).when(full(address), FAIL).otherwise(REVIEW),
    }
    return F.array(*[F.struct(F.lit(r).alias("rule_id"), s.alias("status")) for r, s in rules.items()])


# --- adaptive schema, risk, quality, measurement ---------------------------------------------

# fixed values: core fields of every category
CORE_FIELDS = (
    "PRODUCT_NAME", "BRAND", "PRODUCT_VARIANT", "CATEGORY", "SUBCATEGORY", "MANUFACTURER", "MANUFACTURER_ADDRESS", "PACKER", "PACKER_ADDRESS", "MARKETER", "MARKETER_ADDRESS",
    "IMPORTER", "IMPORTER_ADDRESS", "DISTRIBUTOR", "DISTRIBUTOR_ADDRESS", "COUNTRY_OF_ORIGIN", "MRP", "NET_QUANTITY", "NET_VOLUME", "BATCH_NUMBER", "LOT_NUMBER", "SERIAL_NUMBER",
    "MODEL_NUMBER", "SKU", "ARTICLE_NUMBER", "MANUFACTURING_DATE", "PACKING_DATE", "IMPORT_DATE", "EXPIRY_DATE", "USE_BY_DATE", "BEST_BEFORE", "CONSUMER_CARE",
)
VISIBLE_FROM = 0.15


def adaptive_schema(products: DataFrame, extracted: DataFrame, template: DataFrame, key: str = "product_id") -> DataFrame:
    """Expected fields of the category against what was extracted.

    ``template`` has (category, field_name, relevance); the core fields apply to
    every category at 0.95 unless it says otherwise.  Extracted fields beyond
    the template are kept.
    """
    core = products.select(key, "category", F.explode(F.array(*[F.lit(n) for n in CORE_FIELDS])).alias("field_name")).withColumn("_core", F.lit(0.95))
    listed = products.join(template, "category").select(key, "category", "field_name", F.col("relevance").alias("_listed"))
    expected = core.join(listed, [key, "category", "field_name"], "full")
    e = extracted.select(key, "field_name", "value", F.col("status").alias("_status"), "confidence")
    unsure = F.coalesce("category", F.lit("UNKNOWN")).isin("UNKNOWN", "OTHER")
    j = expected.join(e, [key, "field_name"], "full").withColumn("expected", F.col("category").isNotNull())
    relevance = F.coalesce("_listed", "_core", F.when(unsure, 0.50).otherwise(0.10))
    status = F.coalesce(
        F.when(F.col("_status") == "CONFIRMED", "PRESENT").when(F.col("_status") == "AMBIGUOUS", "NEEDS_REVIEW").when(F.col("_status").isNotNull(), "UNKNOWN"),
        F.when(relevance >= VISIBLE_FROM, "NOT_VISIBLE").otherwise("NOT_APPLICABLE"))
    return j.select(key, "field_name", "value", status.alias("status"), relevance.alias("relevance"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "expected")


def risk(ocr_confidence: Column, units_ok: Column, tax_ok: Column, violations: Column, blurred: Column) -> Column:
    """struct<score,rating,review,reasons>."""
    num = lambda test, v: F.when(test, v).otherwise(0.0)
    total = F.least(F.lit(1.0), F.round(num(blurred, 0.40) + num(ocr_confidence < 0.70, 0.30) + num(~units_ok, 0.35) + num(~tax_ok, 0.30) + num(violations, 0.30), 2))
    reasons = F.array_compact(F.array(
        F.when(blurred, "blur"), F.when(ocr_confidence < 0.70, "low OCR confidence"), F.when(~units_ok, "prohibited unit"), F.when(~tax_ok, "tax phrase missing")))
    return F.struct(total.alias("score"), F.when(total >= 0.60, "HIGH").when(total >= 0.35, "MEDIUM").otherwise("LOW").alias("rating"),
                    ((total >= 0.40) | (ocr_confidence < 0.75) | blurred).alias("review"), reasons.alias("reasons"))


def quality_gate(blur: Column, resolution: Column, contrast: Column, glare: Column, perspective: Column, occlusion: Column,
                 laplacian: Column, glare_pct: Column, min_side: Column, occlusion_pct: Column, issues: Column) -> Column:
    """struct<score,status> of measured image metrics."""
    value = F.round(blur * 0.30 + resolution * 0.20 + contrast * 0.15 + glare * 0.15 + perspective * 0.10 + occlusion * 0.10, 1)
    bad = (laplacian < 20) | (glare_pct > 30) | (min_side < 180) | (occlusion_pct > 45) | (value < 30)
    return F.struct(value.alias("score"), F.when(bad, "INSUFFICIENT").when((value < 70) | (issues > 1), "DEGRADED").otherwise("GOOD").alias("status"))


def quality_points(blur_variance: Column, brightness: Column, contrast: Column, megapixels: Column, glare_pct: Column, noise: Column, shadow: Column) -> Column:
    """0 to 100 score of the advisory, within 15 and 99."""
    points = (
        F.least(F.lit(30.0), blur_variance / 150.0 * 30.0) + F.greatest(F.lit(0.0), 20.0 - F.abs(brightness - 140.0) / 140.0 * 20.0) + F.least(F.lit(20.0), contrast / 50.0 * 20.0)
        + F.least(F.lit(15.0), megapixels / 1.5 * 15.0) + F.greatest(F.lit(0.0), 15.0 - glare_pct * 1.5 - noise / 30.0 - F.when(shadow, 8.0).otherwise(0.0)))
    return F.greatest(F.lit(15), F.least(F.lit(99), F.bround(points, 0))).cast("int")


BARCODE_WIDTH_MM, MIN_HEIGHT_MM = 37.29, 2.0


def numeral_height(regions: DataFrame) -> DataFrame:
    """Numeral height per image, calibrated by the barcode width."""
    first = lambda cat, expr: F.min_by(expr, F.when(F.contains(F.col("category"), F.lit(cat)), F.col("ord")))
    g = regions.groupBy("image_id").agg(first("Barcode", F.col("w")).alias("bar"), first("Net Quantity", F.col("h")).alias("net"))
    per_mm = F.when(F.col("bar") > 40, F.col("bar") / BARCODE_WIDTH_MM)
    mm = F.greatest(F.lit(1.0), F.least(F.lit(12.0), F.round(F.col("net") * 0.5 / per_mm, 2)))
    return g.select("image_id", (per_mm.isNotNull() & F.col("net").isNotNull()).alias("calibrated"), F.when(F.col("net").isNotNull() & per_mm.isNotNull(), mm).alias("height_mm"),
                    F.coalesce(F.when(F.col("net").isNotNull() & per_mm.isNotNull(), mm) >= MIN_HEIGHT_MM, F.lit(True)).alias("complies"))


# --- jurisdiction -----------------------------------------------------------------------

def validate_pins(pins: DataFrame, states: DataFrame) -> DataFrame:
    """Format and location of PIN codes.

    ``states`` has (state, pin_prefixes array, district_overrides map).  Two
    equi-joins, on the state name and on the two-digit prefix, replace the
    search through all states; a prefix is reduced to its first state before.
    """
    pin = F.btrim(F.coalesce("pin", F.lit("")))
    own = states.select(F.lower("state").alias("_s"), F.col("pin_prefixes").alias("_own"), F.col("district_overrides").alias("_over"))
    owner = states.select(F.explode("pin_prefixes").alias("_p2"), "state").groupBy("_p2").agg(F.min("state").alias("_owner"))
    j = pins.withColumn("_pin", pin).withColumn("_s", F.lower(F.btrim("state"))).withColumn("_p2", F.substring("_pin", 1, 2))
    j = j.join(own, "_s", "left").join(owner, "_p2", "left")
    shape = (F.when(F.col("_pin") == "", "PIN Code is required.").when(~F.col("_pin").rlike(r"^\d+$"), "Only numbers are accepted.")
             .when(F.length("_pin") != 6, "PIN Code must contain exactly 6 digits.").when(F.col("_pin").rlike("^[09]"), "Invalid Indian PIN code prefix."))
    elsewhere = F.col("_own").isNotNull() & ~F.array_contains("_own", F.col("_p2"))
    error = F.coalesce(shape, F.when(elsewhere, F.concat(F.lit("PIN Code does not match the selected location."), F.coalesce(F.concat(F.lit(" (belongs to "), F.col("_owner"), F.lit(")")), F.lit("")))))
    allowed = F.try_element_at(F.col("_over"), F.col("district"))
    outside = error.isNull() & F.col("_own").isNotNull() & allowed.isNotNull() & ~F.array_contains(allowed, F.substring("_pin", 1, 3)) & ~F.array_contains(allowed, F.col("_p2"))
    warning = F.when(outside, F.concat(F.lit("Note: PIN "), F.col("_pin"), F.lit(" is usually outside primary postal sub-circle for "), F.col("district"), F.lit(".")))
    return j.select(*pins.columns, error.isNull().alias("is_valid"), error.alias("error"), warning.alias("warning"))
