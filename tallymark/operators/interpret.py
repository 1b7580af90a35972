"""Meaning of quantities, prices, dates, parties and codes in their context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import text as tx
from tallymark.operators import parties as pa

# fixed values: token patterns
QUANTITY = r"(?i)\b(\d+(?:\.\d+)?)\s*(kg|kgs|g|gm|gms|mg|l|ltr|ltrs|ml|m1|cm|mm|m|pcs|pieces?|units?|tablets?|capsules?|count|pair|set)\b"
DIMENSION = r"(?i)\b(?:\d+(?:\.\d+)?\s*(?:cm|mm|m|in|inch)\s*[xX*]\s*)+\d+(?:\.\d+)?\s*(?:cm|mm|m|in|inch)\b"
NET_WORDS = r"(?i)\b(?:net\s+(?:quantity|qty|wt|volume|weight|mass))\b"
SERVING_WORDS = r"(?i)\b(?:serving\s+size)\b"
SIZE_WORDS = r"(?i)\b(?:dimensions?|size|chest|length|width|height|diameter|thickness)\b"
SPEC_WORDS = r"(?i)\b(?:drill|cable|wire|plug|adapter|thickness|dia|spec)\b"
PRICE = r"(?i)(?:₹|Rs\.?|INR)\s*(\d+(?:\.\d{1,2})?)"
MRP_WORDS = r"(?i)\b(?:m\.?r\.?p\.?|maximum\s+retail\s+price|incl\.?\s*of\s*all\s*taxes)\b"
USP_WORDS = r"(?i)\b(?:unit\s+sale\s+price|u\.?s\.?p\.?|per\s*(?:g|gm|ml|kg|l|piece|unit))\b"
DATE = (
    r"(?i)\b(?:(?:0?[1-9]|[12][0-9]|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:20\d{2}|\d{2})|(?:0?[1-9]|1[0-2])[/\-.](?:20\d{2}|\d{2})|"
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s.\-]+(?:20\d{2}|\d{2}))\b"
)
SHELF_LIFE = r"(?i)\b(?:best\s+before\s*(?:within\s*)?\d+\s*(?:months?|days?|years?)|shelf\s+life\s*(?:is\s*)?\d+\s*(?:months?|days?|years?))\b"
DATE_WORDS = {
    "MANUFACTURING_DATE": (0.98, r"(?i)\b(?:mfg|mfd|date\s+of\s+mfg|manufactured)\b"),
    "PACKING_DATE": (0.98, r"(?i)\b(?:pkd|packed|pkg|date\s+of\s+pkd)\b"),
    "EXPIRY_DATE": (0.98, r"(?i)\b(?:exp|expiry|use\s+by|use\s+before)\b"),
    "BEST_BEFORE_DATE": (0.95, r"(?i)\bbest\s+before\b"),
}
PARTY_WORDS = {
    "MARKETER_NAME": r"(?:marketed\s+by|mkt\s+by)",
    "PACKER_NAME": r"(?:packed\s+by|pkd\s+by)",
    "IMPORTER_NAME": r"(?:imported\s+by|imp\s+by)",
    "MANUFACTURER_NAME": r"(?:manufactured\s+by|mfd\s+by|produced\s+by)",
}
FIRM = (
    r"(?i)\b(?:pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|llp|inc\.?|corp\.?|corporation|industries|enterprises|laboratories|labs|foods|pharma|cosmetics|"
    r"confectionery|beverages|products)\b"
)
# fixed values: words of an address line
ADDRESS_WORDS = (
    r"(?i)\b(?:plot|survey|khasra|bldg|building|floor|industrial\s+area|ind\.\s*area|g\.?i\.?d\.?c\.?|m\.?i\.?d\.?c\.?|estate|sector|phase|nagar|marg|road|street|"
    r"lane|chowk|village|dist\.?|district|taluka|tehsil|near|opp\.?|opposite|post|p\.?o\.?|state)\b"
)
LETTERS = r"[a-zA-Z]{3,}"

RESULT = "struct<semantic_type:string,value:string,confidence:double,candidates:array<struct<confidence:double,type:string>>>"


def verdict(kind: str | Column, value: Column, conf: float, candidates: Sequence[tuple[str, float]] = ()) -> Column:
    """Interpretation struct with its ranked alternatives."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    alts = F.array(*[F.struct(F.lit(float(c)).alias("confidence"), F.lit(t).alias("type")) for t, c in candidates]) if candidates else F.array()
    return F.struct(name.alias("semantic_type"), value.alias("value"), F.lit(float(conf)).alias("confidence"), alts.alias("candidates")).cast(RESULT)


def none() -> Column:
    return F.lit(None).cast(RESULT)


def quantity(text: Column, section: Column, heading: Column) -> Column:
    """Quantity in context; an isolated number stays UNKNOWN."""
    inputs = F.struct(text.alias("text"), section.alias("section"), heading.alias("heading"))
    return tx.let(inputs, lambda s: _quantity(s["text"], s["section"], s["heading"]))


def _quantity(text: Column, section: Column, heading: Column) -> Column:
    dim = tx.grab(text, DIMENSION, 0)
    token = F.coalesce(dim, tx.grab(text, QUANTITY, 0))
    unit = F.lower(tx.grab(text, QUANTITY, 2))
    has = lambda p: tx.has(text, p)
    return (
        F.when(token.isNull(), none())
        .when(section == "INGREDIENTS", verdict("INGREDIENT_QUANTITY", token, 0.95, [("INGREDIENT_QUANTITY", 0.95), ("PRODUCT_SPECIFICATION", 0.05)]))
        .when((heading == "NET_QUANTITY") | has(NET_WORDS), verdict("NET_QUANTITY", token, 0.98, [("NET_QUANTITY", 0.98), ("SERVING_SIZE", 0.02)]))
        .when((heading == "SERVING_SIZE") | has(SERVING_WORDS), verdict("SERVING_SIZE", token, 0.98, [("SERVING_SIZE", 0.98), ("NET_QUANTITY", 0.02)]))
        .when(section == "NUTRITION", verdict("SERVING_SIZE", token, 0.90, [("SERVING_SIZE", 0.90), ("NUTRITION_SPECIFICATION", 0.85)]))
        .when(dim.isNotNull() | has(SIZE_WORDS), verdict("DIMENSION", token, 0.95, [("DIMENSION", 0.95), ("TECHNICAL_SPECIFICATION", 0.90)]))
        .when(unit.isin("mm", "cm", "m") & has(SPEC_WORDS), verdict("TECHNICAL_SPECIFICATION", token, 0.90, [("TECHNICAL_SPECIFICATION", 0.90), ("DIMENSION", 0.85)]))
        .when(unit.isin("mm", "cm", "m"), verdict("UNKNOWN", token, 0.45, [("DIMENSION", 0.45), ("TECHNICAL_SPECIFICATION", 0.40), ("PRODUCT_SPECIFICATION", 0.15)]))
        .when(F.lower(tx.strip(text)) == F.lower(token), verdict("UNKNOWN", token, 0.40, [("NET_QUANTITY", 0.45), ("SERVING_SIZE", 0.40), ("PRODUCT_WEIGHT_SPECIFICATION", 0.15)]))
        .otherwise(verdict("UNKNOWN", token, 0.35, [("NET_QUANTITY", 0.35), ("OTHER_QUANTITY", 0.35)]))
    )


def price(text: Column, heading: Column) -> Column:
    inputs = F.struct(text.alias("text"), heading.alias("heading"))
    return tx.let(inputs, lambda s: _price(s["text"], s["heading"]))


def _price(text: Column, heading: Column) -> Column:
    token = F.btrim(tx.grab(text, PRICE, 0))
    alone = (F.lower(tx.strip(text)) == F.lower(token)) | ~tx.has(text, LETTERS)
    return (
        F.when(token.isNull(), none())
        .when((heading == "SALE_PRICE") | tx.has(text, USP_WORDS), verdict("SALE_PRICE", token, 0.96, [("SALE_PRICE", 0.96), ("MRP", 0.04)]))
        .when((heading == "MRP") | tx.has(text, MRP_WORDS), verdict("MRP", token, 0.98, [("MRP", 0.98), ("SALE_PRICE", 0.02)]))
        .when(alone, verdict("UNKNOWN", token, 0.50, [("PRICE_CANDIDATE", 0.55), ("MRP", 0.45), ("SALE_PRICE", 0.35)]))
        .otherwise(verdict("UNKNOWN", token, 0.40, [("PRICE_CANDIDATE", 0.50), ("MRP", 0.40)]))
    )


def date(text: Column, heading: Column) -> Column:
    inputs = F.struct(text.alias("text"), heading.alias("heading"))
    return tx.let(inputs, lambda s: _date(s["text"], s["heading"]))


def _date(text: Column, heading: Column) -> Column:
    shelf, token = tx.grab(text, SHELF_LIFE, 0), tx.grab(text, DATE, 0)
    best = tx.has(text, r"(?i)\bbest\s+before\b") & tx.has(text, r"(?i)\b\d+\s*months?\b")
    out = (F.when(shelf.isNotNull(), verdict("BEST_BEFORE_DATE", shelf, 0.98, [("BEST_BEFORE_DATE", 0.98), ("EXPIRY_DATE", 0.02)]))
           .when(token.isNull() & best, verdict("BEST_BEFORE_DATE", tx.strip(text), 0.96, [("BEST_BEFORE_DATE", 0.96)])).when(token.isNull(), none()))
    for kind, (conf, words) in DATE_WORDS.items():
        out = out.when((heading == kind) | tx.has(text, words), verdict(kind, token, conf, [(kind, conf)]))
    alone = (F.lower(tx.strip(text)) == F.lower(token)) | ~tx.has(text, LETTERS)
    return out.when(alone, verdict("UNKNOWN", token, 0.40, [("MANUFACTURING_DATE", 0.45), ("EXPIRY_DATE", 0.45), ("PACKING_DATE", 0.10)])).otherwise(
        verdict("UNKNOWN", token, 0.35, [("DATE", 0.40)]))


def party(text: Column, section: Column, heading: Column) -> Column:
    """Organisation, address or PIN; an ingredient section never yields a party."""
    inputs = F.struct(text.alias("text"), section.alias("section"), heading.alias("heading"))
    return tx.let(inputs, lambda s: _party(s["text"], s["section"], s["heading"]))


def _party(text: Column, section: Column, heading: Column) -> Column:
    t = tx.strip(text)
    pin = tx.grab(text, lx.PIN)
    near = heading.isin("MANUFACTURER_ADDRESS", "PACKER_ADDRESS", "MARKETER_ADDRESS", "ADDRESS") | section.isin("MANUFACTURER_INFORMATION", "PACKER_INFORMATION", "MARKETER_INFORMATION")
    firm = tx.has(text, FIRM)
    out = (F.when(section == "INGREDIENTS", verdict("INGREDIENTS", t, 0.98, [("INGREDIENTS", 0.98)]))
           .when((t == pin) & F.coalesce(near, F.lit(False)), verdict("POSTAL_PIN", pin, 0.90, [("POSTAL_PIN", 0.90), ("BATCH_NUMBER", 0.10)]))
           .when(t == pin, verdict("UNKNOWN", pin, 0.40, [("POSTAL_PIN", 0.45), ("PRODUCT_CODE", 0.35), ("BATCH_NUMBER", 0.20)])))
    for kind, words in PARTY_WORDS.items():
        name = tx.strip(F.regexp_replace(text, "(?i)^" + words + r"[:\s\-]*", ""))
        out = out.when(firm & ((heading == kind) | tx.has(text, rf"(?i)\b{words}\b")), verdict(kind, name, 0.98, [(kind, 0.98)]))
    for kind in ("MARKETER", "PACKER", "MANUFACTURER"):
        out = out.when(firm & (section == f"{kind}_INFORMATION"), verdict(f"{kind}_NAME", t, 0.95, [(f"{kind}_NAME", 0.95)]))
    out = out.when(firm, verdict("MANUFACTURER_NAME", t, 0.80, [("MANUFACTURER_NAME", 0.50), ("MARKETER_NAME", 0.30), ("PACKER_NAME", 0.20)]))
    words = tx.has(text, ADDRESS_WORDS)
    low = F.lower(text)
    state = F.lit(False)
    for s in pa.PLACES:
        state = state | F.contains(low, F.lit(s))
    address = words | (state & pin.isNotNull()) | (state & F.contains(text, F.lit(",")))
    role = F.lit("MANUFACTURER_ADDRESS")
    for kind in ("IMPORTER", "PACKER", "MARKETER"):
        role = F.when((heading == f"{kind}_NAME") | (section == f"{kind}_INFORMATION"), F.lit(f"{kind}_ADDRESS")).otherwise(role)
    return out.when(address, verdict(role, t, 0.94, [("REGISTERED_ADDRESS", 0.80)])).otherwise(none())


def semantic_fields(lines: DataFrame) -> DataFrame:
    """Meaning of every line from the interpreters in priority order.

    Needs ``text``, ``section`` and ``heading``.  Prices come first, then dates,
    quantities and parties; a line nothing speaks for is UNKNOWN at 0.30.
    """
    text, section, heading = F.col("text"), F.col("section"), F.col("heading")
    contact = F.when(tx.has(text, lx.EMAIL), verdict("CONSUMER_CARE", tx.grab(text, lx.EMAIL, 0), 0.97)).when(
        (heading == "CONSUMER_CARE") | (tx.has(text, lx.PHONE) & tx.has(text, lx.CARE_WORDS)), verdict("CONSUMER_CARE", tx.strip(text), 0.95))
    code = F.when(heading.isin("BATCH_NUMBER", "LOT_NUMBER", "MODEL_NUMBER", "SERIAL_NUMBER", "COUNTRY_OF_ORIGIN"), verdict(heading, F.col("heading_value"), 0.98))
    shield = F.when(section == "INGREDIENTS", F.coalesce(quantity(text, section, heading), verdict("INGREDIENTS", tx.strip(text), 0.98, [("INGREDIENTS", 0.98)])))
    def choose(v: Column) -> Column:
        known = [F.when(v[k]["semantic_type"] != "UNKNOWN", v[k]) for k in ("price", "date", "quantity", "party")]
        return F.coalesce(v["fixed"], *known, v["price"], v["quantity"], v["date"], v["party"], v["open"])

    readings = F.struct(
        F.coalesce(shield, contact, code).alias("fixed"), price(text, heading).alias("price"), date(text, heading).alias("date"),
        quantity(text, section, heading).alias("quantity"), party(text, section, heading).alias("party"), verdict("UNKNOWN", tx.strip(text), 0.30).alias("open"))
    # The generator keeps later filters from repeating the interpretation.
    return lines.select(*lines.columns, F.inline(F.array(F.struct(tx.let(readings, choose).alias("field")))))


def ambiguous(field: Column) -> Column:
    """Open meanings: unknown kinds, low confidence, or two close alternatives."""
    ranked = F.sort_array(field["candidates"], asc=False)
    close = (F.size(ranked) >= 2) & (F.round(F.get(ranked, F.lit(0))["confidence"] - F.get(ranked, F.lit(1))["confidence"], 4) < 0.10)
    return field["semantic_type"].isin("UNKNOWN", "PRICE_CANDIDATE", "OTHER") | (field["confidence"] < 0.60) | ((field["confidence"] < 0.80) & F.coalesce(close, F.lit(False)))


def with_review_status(fields: DataFrame) -> DataFrame:
    """Add ``status``: NEEDS_REVIEW for open meanings, else CONFIRMED."""
    return fields.withColumn("status", F.when(ambiguous(F.col("field")), "NEEDS_REVIEW").otherwise("CONFIRMED"))


def split_ambiguous(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed and open rows as two views; read both from :func:`with_review_status` where both are needed."""
    marked = with_review_status(fields)
    return marked.filter("status = 'CONFIRMED'"), marked.filter("status = 'NEEDS_REVIEW'")


# --- open candidates ---------------------------------------------------------------------

CANDIDATES = {
    "QUANTITY": r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:gms|kgs|gm|g|kg|mg|ml|l|ltr|cm|mm|m|N|units?|pieces?)\b",
    "PRICE": r"(?i)(?:₹|Rs\.?|INR)\s*[0-9]+(?:\.[0-9]{1,2})?|[0-9]{2,5}(?:\.[0-9]{2})?\s*/-",
    "PIN": r"\b[1-9][0-9]{5}\b",
    "COMPANY": r"(?i)\b[A-Za-z0-9\s.,&'\-]+?(?:Pvt\.?\s*Ltd\.?|Private\s*Limited|Ltd\.?|Limited|LLP|Inc\.?|Corporation|Enterprises|Laboratories|Industries)\b",
    "DATE": r"(?i)\b(?:(?:[0-9]{1,2}[/\-.])?[0-9]{1,2}[/\-.][0-9]{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s*['\-]?[0-9]{2,4}|\d{1,2}\s*months?)\b",
}
MEANINGS = {
    "QUANTITY": ("NET_QUANTITY", "SERVING_SIZE", "INGREDIENT_QUANTITY", "OTHER_QUANTITY"), "PRICE": ("MRP", "PRICE_CANDIDATE", "UNIT_PRICE"),
    "PIN": ("POSTAL_PIN", "PRODUCT_CODE", "UNKNOWN"), "COMPANY": ("MANUFACTURER", "PACKER", "MARKETER", "IMPORTER", "BRAND_OWNER"),
    "DATE": ("DATE_OF_MANUFACTURE", "DATE_OF_PACKING", "EXPIRY", "BEST_BEFORE", "USE_BY", "OTHER_DATE"),
}


def open_candidates(lines: DataFrame) -> DataFrame:
    """One row per token and kind, with its context and possible meanings."""
    kinds = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _kind(k)) for k, p in CANDIDATES.items()]
    found = F.filter(F.flatten(F.array(*kinds)), lambda c: (c["entity_type"] != "COMPANY") | (F.length(c["raw_text"]) > 4))
    return lines.select(*lines.columns, F.inline(found))


def _kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("entity_type"), F.btrim(m).alias("raw_text"), F.array(*[F.lit(x) for x in MEANINGS[kind]]).alias("meanings"))


NET_CONTEXT = ("net qty", "net quantity", "net wt", "net weight", "net content", "net volume", "net mass")
SERVING_CONTEXT = ("serving size", "per serving", "per 100", "nutrition", "servings")


def _any(low: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w))
    return test


def quantity_meaning(context: Column, section: Column, surface: Column, category: Column, unit: Column, prominent: Column) -> Column:
    """Additive score over seven meanings: struct<meaning,confidence,status>.

    Below 0.45, or with less than 0.10 to the runner-up under 0.65, the meaning
    stays UNKNOWN.
    """
    low, u, cat = F.lower(context), F.lower(F.coalesce(unit, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    add = lambda test, v: F.when(F.coalesce(test, F.lit(False)), v).otherwise(0.0)
    near_net, near_serving = _any(low, NET_CONTEXT), _any(low, SERVING_CONTEXT)
    sized = _any(low, ("size:", "chest", "length", "width"))
    electronic, textile, toy = F.contains(cat, F.lit("electronic")), _any(cat, ("textile", "apparel", "garment")), F.contains(cat, F.lit("toy"))
    net = (0.20 + add(surface == "Front (PDP)", 0.35) - add(section.isin("INGREDIENTS", "DIRECTIONS"), 0.30) - add(section == "NUTRITION_INFORMATION", 0.20) + add(near_net, 0.55)
           - add(near_serving, 0.40) - add(sized, 0.20) + add(textile & u.isin("n", "unit", "piece"), 0.30) + add(toy & u.isin("pieces", "unit", "pcs"), 0.35) + add(prominent, 0.25))
    scores = {
        "NET_QUANTITY": net,
        "SERVING_SIZE": 0.10 + add(section == "NUTRITION_INFORMATION", 0.50) - add(near_net, 0.30) + add(near_serving, 0.70) - add(prominent, 0.15),
        "INGREDIENT_QUANTITY": 0.10 + add(section == "INGREDIENTS", 0.65) + add((u == "mg") & (net < 0.70), 0.35),
        "PRODUCT_DIMENSION": 0.05 + add(sized, 0.60) + add(electronic & u.isin("mm", "cm"), 0.40) + add(textile & u.isin("cm", "m"), 0.45),
        "WEIGHT_SPECIFICATION": 0.05 + add(_any(low, ("weight:", "device weight", "item weight")), 0.60) + add(electronic & F.contains(low, F.lit("weight")), 0.40),
        "QUANTITY_COUNT": 0.05 + add(toy & u.isin("pieces", "unit", "pcs"), 0.50),
        "OTHER_QUANTITY": 0.10 + add(surface == "Coding Area", 0.20) + add(section == "DIRECTIONS", 0.40),
    }
    ranked = F.sort_array(F.array(*[F.struct(F.round(s, 4).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())]), asc=False)

    def judge(r: Column) -> Column:
        top, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        weak = (top["s"] < 0.45) | ((F.round(top["s"] - second["s"], 4) < 0.10) & (top["s"] < 0.65))
        return F.struct(F.when(weak, "UNKNOWN").otherwise(top["n"]).alias("meaning"),
                        F.when(weak, 0.50).otherwise(F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.60), top["s"])), 2)).alias("confidence"),
                        F.when(weak, "NEEDS_REVIEW").otherwise("RESOLVED").alias("status"))

    return tx.let(ranked, judge)


def token_meaning(kind: Column, raw: Column, context: Column, bottom_stamp: Column) -> Column:
    """Meaning of price, PIN, company and date tokens: struct<meaning,confidence,status>."""
    inputs = F.struct(kind.alias("kind"), raw.alias("raw"), context.alias("context"), bottom_stamp.alias("bottom_stamp"))
    return tx.let(inputs, lambda s: _token_meaning(s["kind"], s["raw"], s["context"], s["bottom_stamp"]))


def _token_meaning(kind: Column, raw: Column, context: Column, bottom_stamp: Column) -> Column:
    low = F.lower(context)
    out = lambda m, c, s="RESOLVED": F.struct(F.lit(m).alias("meaning"), F.lit(c).alias("confidence"), F.lit(s).alias("status"))
    usp = _any(low, ("usp", "u.s.p", "unit sale price", "per g", "per kg", "per ml")) | F.contains(raw, F.lit("/"))
    mrp = _any(low, ("mrp", "m.r.p", "maximum retail price", "max retail price", "retail price"))
    tax = _any(low, ("incl", "tax"))
    place = tx.has(low, lx.ADDRESS_CUES) | _any(low, pa.PLACES)
    return (
        F.when((kind == "PRICE") & usp, out("UNIT_PRICE", 0.96)).when((kind == "PRICE") & mrp & tax, out("MRP", 0.98)).when((kind == "PRICE") & mrp, out("MRP", 0.94))
        .when((kind == "PRICE") & (tax | bottom_stamp), out("MRP", 0.91)).when(kind == "PRICE", out("PRICE_CANDIDATE", 0.72, "NEEDS_REVIEW"))
        .when((kind == "PIN") & place, out("POSTAL_PIN", 0.95)).when(kind == "PIN", out("UNKNOWN", 0.50, "NEEDS_REVIEW"))
        .when((kind == "COMPANY") & _any(low, ("imported by", "importer")), out("IMPORTER", 0.95)).when((kind == "COMPANY") & _any(low, ("packed by", "pkd by")), out("PACKER", 0.95))
        .when((kind == "COMPANY") & _any(low, ("marketed by", "mkt by", "mktd by")), out("MARKETER", 0.95)).when((kind == "COMPANY") & _any(low, ("manufactured by", "mfd by", "mfg by")), out("MANUFACTURER", 0.96))
        .when(kind == "COMPANY", out("BRAND_OWNER", 0.60, "NEEDS_REVIEW"))
        .when((kind == "DATE") & _any(low, ("best before",)), out("BEST_BEFORE", 0.95)).when((kind == "DATE") & _any(low, ("use by",)), out("USE_BY", 0.95))
        .when((kind == "DATE") & _any(low, ("expiry", "exp ", "exp:", "exp.")), out("EXPIRY", 0.95)).when((kind == "DATE") & _any(low, ("packed", "pkd")), out("DATE_OF_PACKING", 0.95))
        .when((kind == "DATE") & _any(low, ("mfd", "mfg", "manufactur")), out("DATE_OF_MANUFACTURE", 0.95)).otherwise(out("OTHER_DATE", 0.50, "NEEDS_REVIEW"))
    )


VOLUME_UNITS = ("ml", "l", "ltr", "liter", "litres")


def differentiate(raw: Column, heading: Column, unit: Column, semantic_type: Column, category: Column) -> Column:
    """True field of a number by category: technical weight, dimension, serving, ..."""
    inputs = F.struct(raw.alias("raw"), heading.alias("heading"), unit.alias("unit"), semantic_type.alias("semantic_type"), category.alias("category"))
    return tx.let(inputs, lambda s: _differentiate(s["raw"], s["heading"], s["unit"], s["semantic_type"], s["category"]))


def _differentiate(raw: Column, heading: Column, unit: Column, semantic_type: Column, category: Column) -> Column:
    low, u = F.lower(F.concat_ws(" ", raw, heading)), F.lower(F.btrim(F.coalesce(unit, F.lit(""))))
    technical = category.isin("ELECTRONICS", "ELECTRICAL", "HARDWARE", "TOOLS")
    has = lambda *w: _any(low, w)
    volume = u.isin(*VOLUME_UNITS)
    net = F.when(volume, "NET_VOLUME").otherwise("NET_QUANTITY")
    kept = F.when(~semantic_type.isin("NET_QUANTITY", "NET_VOLUME", "QUANTITY", "WEIGHT", "UNKNOWN"), semantic_type)
    return (
        F.when(technical & has("weight", "mass") & ~has("net quantity", "net qty", "net vol", "net content"), "TECHNICAL_WEIGHT")
        .when(technical & u.isin("mm", "cm", "m", "inch", "inches", "mm²"), "DIMENSION")
        .when(has("serving", "per 100g", "per 100ml", "portion") & ~has("net quantity", "net qty", "net weight", "net volume", "net content", "net wt"), "SERVING_SIZE")
        .when(has("ingredients:", "contains:", "composition:", "active ingredients") & ~has("net quantity", "net qty"), F.when(semantic_type == "INGREDIENTS", "INGREDIENTS").otherwise("INGREDIENT_QUANTITY"))
        .when((u.isin("mm", "cm", "inches", "inch") | has("dimension", "size:", "length", "width", "height", "thickness")) & ~category.isin("TEXTILE", "GARMENT", "FOOTWEAR"), "TECHNICAL_SPECIFICATION")
        .when(volume & has("capacity:", "volume capacity", "tank capacity", "holding capacity"), "LIQUID_CAPACITY")
        .when(has("net quantity", "net qty", "net weight", "net volume", "net wt", "net content", "n.w.", "vol."), net)
        .otherwise(F.coalesce(kept, net))
    )


def evidence_map(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Field to evidence record, kept as long rows keyed by the field name."""
    return fields.select(*keys, F.col("field.semantic_type").alias("field_name"), F.struct(
        F.col("field.value").alias("value"), F.col("line_index"), F.col("text").alias("source_text"), F.col("field.confidence").alias("confidence")).alias("evidence"))
