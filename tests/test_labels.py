"""Declarations from small label texts."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import normalise as nm
from tallymark.functions import text as tx
from tallymark.operators import checks as ck
from tallymark.operators import classify as cl
from tallymark.operators import extract as ex
from tallymark.operators import interpret as it
from tallymark.operators import parties as pa

CASES = {
    "plain": "Brand\nNet Qty: 125 g\nMRP: Rs. 65.00 (incl. of all taxes)",
    "plural": "Brand\nNet Wt: 500 gms\nMRP Rs. 145",
    "nutrition": "Glow Gel\nEnergy per 100 g 250 kcal\nNET WT.\n56 g\nMRP ₹489/- inclusive of all taxes",
    "typo": "Tea\nNel Wt: 56 9",
    "hindi": "चाय\nवजन: 50 मिली\nMRP ₹10",
    "slash": "Soap\n489/-",
    "party": "Soap\nMfd by: Acme Foods Pvt Ltd, Plot No 4\nPhase II, Noida\nUttar Pradesh 201301\nMRP Rs 10",
    "split": "Soap\nManufactured by:\nHindustan Unilever\nLimited\nSector 18, Mumbai 400001\nBatch No: X1",
}


@pytest.fixture(scope="module")
def wide(spark):
    df = spark.createDataFrame(list(CASES.items()), "id string, text string")
    rows = ex.detect_price(ex.label_quantity(ex.declarations(df))).select("id", "net", "mrp", "qty", "price", "batch", "pin").collect()
    return {r.id: r for r in rows}


def test_quantity_and_prohibited_unit(wide):
    assert (wide["plain"].net.value, wide["plain"].net.unit, wide["plain"].net.status) == (125.0, "g", "Found")
    assert (wide["plural"].net.unit, wide["plural"].net.status) == ("g", "Defective")


def test_nutrition_table_is_not_the_quantity(wide):
    assert wide["nutrition"].net.value == 56.0
    assert (wide["nutrition"].qty.numeric, wide["nutrition"].qty.strategy) == (56.0, "two-line")


def test_quantity_typo_is_repaired(wide):
    assert (wide["typo"].qty.numeric, wide["typo"].qty.unit) == (56.0, "g")


def test_hindi_unit(wide):
    assert (wide["hindi"].net.value, wide["hindi"].net.unit) == (50.0, "ml")


def test_tax_phrase(wide):
    assert wide["plain"].mrp.status == "Found" and wide["plural"].mrp.status == "Defective"
    assert wide["slash"].price.strategy == "slash-dash" and wide["slash"].price.amount == 489.0


def test_entities(spark):
    df = ex.with_lines(spark.createDataFrame(list(CASES.items()), "id string, text string"))
    got = {(r.id, r.role): r for r in pa.commercial_entities(df).collect()}
    maker = got["party", "MANUFACTURER"]
    assert maker.name == "Acme Foods Pvt Ltd" and maker.pin == "201301" and "Phase II, Noida" in maker.address
    assert got["split", "MANUFACTURER"].name == "Hindustan Unilever Limited" and got["split", "MANUFACTURER"].pin == "400001"


def test_contextual_digits(spark):
    df = spark.createDataFrame([("MRP Rs. 2O9 net 5OOm1 O8/2O26 pin 4OO0l2",)], "t string")
    assert df.select(nm.contextual(F.col("t"))).first()[0] == "MRP Rs. 209 net 500 ml 08/2026 pin 400012"


def test_marketing_and_ingredients_are_shielded(spark):
    rows = [("Experience the radiant glow", "MARKETING_CLAIM"), ("Ingredients: Aqua, Plot 4, 201301", "INGREDIENTS"), ("Plot No 4, Sector 18, Noida 201301", "MANUFACTURER_ADDRESS"), ("MRP Rs 10", "MRP")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", cl.line_class(F.col("t"), F.lit(None), F.lit(None))["name"].alias("got")).collect():
        assert r.got == r.want


def test_words_found_like_patterns(spark):
    text = "Mineral water, non-veg t-shirt; floor  cleaner / floor cleaner, teapot"
    words = ["water", "mineral water", "non-veg", "t-shirt", "floor cleaner", "tea", "veg"]
    df = spark.createDataFrame([(text.lower(),)], "t string")
    got = set(df.select(cl.word_grams(F.col("t"), words)).first()[0])
    import re
    assert got == {w for w in words if re.search(rf"\b{re.escape(w)}\b", text.lower())}


def test_isolated_tokens_stay_open(spark):
    df = spark.createDataFrame([("50 g", "OTHER"), ("Net Qty 50 g", "OTHER"), ("50 g", "NUTRITION"), ("50 g", "INGREDIENTS")], "t string, s string")
    got = [r[0] for r in df.select(it.quantity(F.col("t"), F.col("s"), F.lit(None).cast("string"))["semantic_type"]).collect()]
    assert got == ["UNKNOWN", "NET_QUANTITY", "SERVING_SIZE", "INGREDIENT_QUANTITY"]
    price = df.limit(1).select(it.price(F.lit("₹299"), F.lit(None).cast("string"))["semantic_type"]).first()[0]
    assert price == "UNKNOWN"


def test_micro_pack_and_degraded_image(spark):
    rows = [("a", 5.0, "g", "", False), ("b", 50.0, "g", "", False), ("c", 50.0, "g", "", True)]
    df = spark.createDataFrame(rows, "id string, net_value double, net_unit string, mfd string, degraded boolean")
    got = {(r.id, r.rule_no): r.status for r in ck.settle(ck.statutory_checks(df, "id"), "id").collect()}
    assert got["a", "RULE 6(1)(d)"] == "NOT APPLICABLE" and got["b", "RULE 6(1)(d)"] == "FAIL" and got["c", "RULE 6(1)(d)"] == "NEEDS REVIEW"
    assert got["b", "RULE 32"] == "FAIL" and got["c", "RULE 32"] == "PASS"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_party_names_are_made_once(spark):
    """The role words stand in the plan twice, once to find the role and once to cut it off; a filter that is pushed down would repeat all of a name."""
    lines = ["Fresh Tea", "Mfd by: Acme Foods Pvt Ltd", "Plot No 12, Noida", "Packed by", "Bharat Mills Limited", "…Traders Ltd", "MRP Rs 10", "Uttar Pradesh 201301 Mills Ltd", "Marketed by: ?", "x"]
    df = ex.with_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "id int, text string"))
    found = pa.assembled_entities(df, "id")
    assert _plan(found).count("licen[sc]e") == 2
    got = sorted((r["at"], r["role"], r["name"], r["address"], r["pin"], r["confidence"], r["partial"]) for r in found.collect())
    below = "Uttar Pradesh 201301 Mills Ltd"
    assert got == [
        (2, "MANUFACTURER", "Acme Foods Pvt Ltd", "Plot No 12, Noida", None, 0.97, False),
        (4, "PACKER", "Bharat Mills Limited", below, "201301", 0.97, False),
        (5, "OTHER_ORGANIZATION", "Bharat Mills Limited", below, "201301", 0.48, False),
        (6, "OTHER_ORGANIZATION", "Traders Ltd", below, "201301", 0.38, True),
    ]


def test_line_values_are_bound_once(spark):
    """The unit sale price is cut out once for each line, and a line is trimmed once for its class."""
    df = ex.with_lines(spark.createDataFrame([(1, "Soap\nMRP Rs. 20 USP ₹1.20/g\nNet 5 g"), (2, "489/-"), (3, "30 g/-")], "id int, text string"))
    priced = ex.retail_price(df)
    assert _plan(priced).count("UNIT\\s*SALE") == 1
    assert {r["id"]: r["mrp"]["amount"] for r in priced.collect()} == {1: 20.0, 2: 489.0, 3: None}
    classed = ex.classified_lines(df)
    assert _plan(classed.select("id", "classed")).count("trim(") <= 4
    assert [c["line_class"] for c in classed.filter("id = 1").first()["classed"]] == ["GENERIC_NAME", "MRP", "NET_QUANTITY"]


def test_needles_stand_in_all_that_a_pattern_matches(spark):
    """Lines without digits and words of the patterns, which most are, are searched for these two only."""
    assert tx.needles(r"(?i)\b(?:plot\s*no\.?|sector|rd\b)\b") == {"plot", "sector", "rd"} and tx.needles(r"(?i)(?:tax)?x*[ab]") == {""}
    wanted = ["Power Couple", "RADIANTGLOW", "boosts", "100% natural", "pure & fresh", "lncl. of all taxes", "1nc tax", "सभी करों सहित", "कर सहित", "Made in", "उत्पत्ति: भारत X", "ind. area", "P.O. plot",
              "permitted natural color", "flavouring substance", "do not swallow", "Grievance Officer", "hair fall", "anti-aging", "sodium\tlaureth  sulfate", "dog food", "TEA", "wheatflour", "palm oil", "Sector 18", "kills 99.9%"]
    df = spark.createDataFrame([(w,) for w in wanted] + [("ordinary words, nothing else, here",), ("steam engines",)], "t string")
    got = {r["t"]: r["needed"] for r in df.select("t", tx.has(F.lower("t"), cl._NEEDED).alias("needed")).collect()}
    assert [w for w in wanted if not got[w]] == [] and not got["ordinary words, nothing else, here"] and not got["steam engines"]
    for p in cl._WORDED:
        for r in df.select("t", tx.has(F.col("t"), p).alias("hit"), F.lower("t").alias("low")).collect():
            assert not r["hit"] or any(n in r["low"] for n in tx.needles(p))
