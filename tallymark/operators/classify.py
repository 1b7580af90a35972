"""Line, product, panel and category classifiers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import normalise as nm
from tallymark.functions import text as tx


def _contains_word(low: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w))
    return test


# --- words of a text, found in one pass -------------------------------------

def word_grams(low: Column, vocabulary: Sequence[str]) -> Column:
    """Words and phrases of ``vocabulary`` that occur in the text as whole words.

    The text is split once at word borders.  Single words are looked up by
    hash; a phrase is only put together where its first word stands, and counts
    when its parts are joined exactly as in the vocabulary.
    """
    parts = {w: re.findall(r"\w+|\W+", w) for w in dict.fromkeys(vocabulary)}
    single = [w for w, p in parts.items() if len(p) == 1]
    phrases = [w for w, p in parts.items() if len(p) > 1]
    starts = list(dict.fromkeys(parts[w][0] for w in phrases))
    lengths = sorted({len(parts[w]) for w in phrases})

    def grams(tokens: Column) -> Column:
        found = [F.filter(tokens, lambda t: t.isin(*single))]
        for n in lengths:
            found.append(F.array_compact(F.transform(tokens, phrase(tokens, n))))
        return F.array_distinct(F.concat(*found))

    def phrase(tokens: Column, n: int):
        def gram(t: Column, i: Column) -> Column:
            joined = F.concat(t, *[F.get(tokens, i + k) for k in range(1, n)])
            return F.when(t.isin(*starts), F.when(joined.isin(*[w for w in phrases if len(parts[w]) == n]), joined))
        return gram

    return tx.let(F.split(low, r"\b"), grams)


def default_vocabulary() -> list[str]:
    words = [w for w, _ in lx.commodity_words()]
    for table in (lx.DOMAIN_WORDS, lx.SIGNAL_WORDS):
        words += [w for ws in table.values() for w in ws]
    return list(dict.fromkeys(words))


def with_grams(df: DataFrame, text_col: str = "text", out: str = "grams", vocabulary: Sequence[str] | None = None) -> DataFrame:
    """Add the known words as a column, so that several classifiers share one pass."""
    return df.withColumn(out, word_grams(F.lower(F.col(text_col)), vocabulary or default_vocabulary()))


def known_words(grams: Column, words: Sequence[str]) -> Column:
    """Those of ``words`` among the grams, in the order of ``words``."""
    return F.array_intersect(F.array(*[F.lit(w) for w in words]), grams)


def _steps(values: Sequence[float], n: Column) -> Column:
    """Value for ``n`` hits from a table; the last value holds beyond its end."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.least(n + 1, F.lit(len(values))))


# --- the 31 line classes ------------------------------------------------------

_WORDED = (lx.MARKETING, lx.DIRECTIONS_BODY, lx.INGREDIENT, lx.SUBSTANCE, lx.TAX_PHRASE, lx.ORIGIN, lx.ORIGIN_WORDS, lx.CARE_ADDRESS, lx.ADDRESS_STRONG)
_NEEDED = rf"{tx.any_text(n for p in _WORDED for n in tx.needles(p))}|\b{tx.any_text(w for w, _ in lx.commodity_words())}\b"


def line_class(text: Column, prev1: Column, prev2: Column) -> Column:
    """Class of a line by strict priority.  Returns struct<name,confidence>.

    Formulation, directions and marketing copy are tested first, so that they
    can never be taken for a party or an address.
    """
    # One search each for digits and for the words of all patterns tells which lines need no other.
    marked = lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), tx.has(t, "[0-9]").alias("digits"), tx.has(F.lower(t), _NEEDED).alias("words"))
    return tx.let(tx.let(tx.strip(text), marked), lambda m: _line_class(m["text"], m["low"], m["digits"], m["words"], F.concat_ws("\n", prev2, prev1)))


def _line_class(t: Column, low: Column, digits: Column, words: Column, before: Column) -> Column:
    has = lambda p: tx.has(t, p)
    verdict = lambda name, conf: F.struct(F.lit(name).alias("name"), F.lit(conf).alias("confidence"))
    linked = lambda p: tx.has(before, p)
    worded = lambda p: words & has(p)
    counted = lambda p: digits & has(p)
    parts = F.split(t, ",")
    listing = words & (F.size(parts) >= 3) & F.exists(parts, lambda p: p.rlike(lx.SUBSTANCE))
    address = (counted(lx.PIN) | worded(lx.ADDRESS_STRONG)) & has(lx.ADDRESS_CUES) & ~_contains_word(low, lx.FORMULATION_WORDS)
    vowels = F.length(F.regexp_replace(low, "[^aeiou]", ""))
    noise = has(lx.NOISE_TOKENS) & ~has(lx.NOISE_EXEMPT) & (vowels <= 1) & (F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 5)
    commodity = words & (F.size(word_grams(low, [w for w, _ in lx.commodity_words()])) > 0)
    # One branch for all addresses: a condition that stands in several branches is evaluated in each.
    owner = (
        F.when(linked(r"(?i)\b(?:marketed|mktg|distributed)\b"), verdict("MARKETER_ADDRESS", 0.93))
        .when(linked(r"(?i)\b(?:packed|pkd)\b"), verdict("PACKER_ADDRESS", 0.93))
        .when(linked(r"(?i)\b(?:imported|importer)\b"), verdict("IMPORTER_ADDRESS", 0.93))
        .otherwise(verdict("MANUFACTURER_ADDRESS", 0.93))
    )
    return (
        F.when(t == "", verdict("UNKNOWN", 0.0))
        .when(worded(lx.MARKETING) | has(lx.MARKETING_START), verdict("MARKETING_CLAIM", 0.95))
        .when(has(lx.DIRECTIONS_START) | worded(lx.DIRECTIONS_BODY), verdict("DIRECTIONS", 0.96))
        .when(has(lx.INGREDIENTS_START) | (words & (F.regexp_count(t, F.lit(lx.INGREDIENT)) >= 2)), verdict("INGREDIENTS", 0.96))
        .when(listing, verdict("POSSIBLE_INGREDIENTS", 0.90))
        .when(has(lx.WARNING_START), verdict("WARNING", 0.95))
        .when(has(lx.MARKETER_START), verdict("MARKETER", 0.95))
        .when(counted(lx.PIN_ONLY), verdict("POSTAL_PIN", 0.95))
        .when(counted(lx.MRP_NAMED) | counted(lx.MRP_CURRENCY) | counted(lx.MRP_SLASH), verdict("MRP", 0.96))
        .when(worded(lx.TAX_PHRASE), verdict("TAX_INCLUSIVE_WORDING", 0.96))
        .when(counted(lx.USP), verdict("UNIT_SALE_PRICE", 0.95))
        .when((counted(lx.NET_NAMED) | counted(lx.NET_NAMED_HINDI) | counted(lx.NET_BARE)) & ~has(lx.NUTRITION), verdict("NET_QUANTITY", 0.95))
        .when(has(lx.UNIT_ONLY), verdict("UNIT", 0.92))
        .when(counted(lx.MFD), verdict("MANUFACTURE_DATE", 0.95))
        .when(counted(lx.PKD), verdict("PACKING_DATE", 0.95))
        .when(counted(lx.BEST_BEFORE), verdict("BEST_BEFORE", 0.95))
        .when(counted(lx.EXP), verdict("EXPIRY_DATE", 0.95))
        .when(has(lx.BATCH), F.when(has(r"(?i)\blot\b"), verdict("LOT_NUMBER", 0.95)).otherwise(verdict("BATCH_NUMBER", 0.95)))
        .when(worded(lx.ORIGIN) | worded(lx.ORIGIN_WORDS), verdict("COUNTRY_OF_ORIGIN", 0.96))
        .when(F.contains(t, F.lit("@")) & has(lx.EMAIL), verdict("CONSUMER_CARE_EMAIL", 0.97))
        .when(counted(lx.PHONE) & has(lx.CARE_WORDS), verdict("CONSUMER_CARE_PHONE", 0.96))
        .when(worded(lx.CARE_ADDRESS), verdict("CONSUMER_CARE_ADDRESS", 0.93))
        .when(has(lx.MANUFACTURER_START), verdict("MANUFACTURER_NAME", 0.95))
        .when(has(lx.PACKER_START), verdict("PACKER_NAME", 0.95))
        .when(has(lx.IMPORTER_START), verdict("IMPORTER_NAME", 0.95))
        .when(address, owner)
        .when(commodity, verdict("GENERIC_NAME", 0.94))
        .when(noise, verdict("UNKNOWN", 0.40))
        .when(has(lx.LICENCE), verdict("OTHER_TEXT", 0.90))
        .otherwise(verdict("OTHER_TEXT", 0.60))
    )


# --- scored classifiers --------------------------------------------------------

def best_scored(scores: Sequence[tuple[str, Column]], fallback: str, fallback_score: float) -> Column:
    """Highest score above zero, the first class winning ties.

    struct<key,rank,name,score>; the fallback takes part as an entry that only
    classes with a score can beat.
    """
    entry = lambda key, rank, name, score: F.struct(
        key.alias("key"), F.lit(rank).alias("rank"), F.lit(name).alias("name"), score.alias("score"))
    entries = [entry(F.lit(1e-9), -10_000, fallback, F.lit(fallback_score))]
    entries += [entry(s, -i, name, s) for i, (name, s) in enumerate(scores)]
    return F.array_max(F.array(*entries))


def declaration_class(text: Column) -> Column:
    """Declaration type of a line from cue density (min(0.95, 0.60 + 0.15 per cue))."""
    low = F.lower(tx.strip(text))
    table = [0.0, *[round(min(0.95, 0.60 + 0.15 * k), 2) for k in range(1, 4)]]
    return best_scored([(name, _steps(table, tx.hit_count(low, cues))) for name, cues in lx.DECLARATION_CUES.items()], "OTHER", 0.30)


def product_domain(grams: Column) -> Column:
    """Coarse product domain from distinct keywords (min(0.98, 0.65 + 0.10 per word))."""
    table = [0.0, *[round(min(0.98, 0.65 + 0.10 * k), 2) for k in range(1, 5)]]
    scores = [(domain, _steps(table, F.size(known_words(grams, words)))) for domain, words in lx.DOMAIN_WORDS.items()]
    return best_scored(scores, "General Packaged Commodity", 0.70)


def category_letter(text: Column, grams: Column) -> Column:
    """Category A to R.  Longest commodity word first, then import wording, then context."""
    low = F.lower(text)
    by_length = {w: c for w, c in sorted(lx.commodity_words(), key=lambda p: -len(p[0]))}
    lookup = F.create_map(*[x for w, c in by_length.items() for x in (F.lit(w), F.lit(c))])
    longest = F.get(known_words(grams, list(by_length)), F.lit(0))
    origins = F.regexp_extract_all(low, F.lit(lx.IMPORT_ORIGIN), F.lit(1))
    foreign = F.exists(origins, lambda c: ~F.startswith(c, F.lit("india")))
    verdict = lambda code, conf: F.struct(F.lit(code).alias("code"), F.lit(conf).alias("confidence"))
    other = F.when(tx.has(low, lx.IMPORT_DECLARED) | foreign, verdict("P", 0.95))
    for code, conf, pattern in lx.CATEGORY_CONTEXT:
        other = other.when(tx.has(low, pattern), verdict(code, conf))
    by_word = F.transform(F.array(F.try_element_at(lookup, longest)), lambda c: F.when(c.isNotNull(), F.struct(c.alias("code"), F.lit(0.95).alias("confidence"))))
    return F.coalesce(F.get(by_word, F.lit(0)), other.otherwise(verdict("R", 0.40)))


def generic_name(grams: Column) -> Column:
    """Display name of the first commodity word in dictionary order (not the longest)."""
    names = lx.commodity_names()
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(lookup, F.get(known_words(grams, list(names)), F.lit(0)))


def category_signals(grams: Column) -> Column:
    """Ranked candidates: array<struct<hits,ord,category,confidence,evidence>>."""
    surely = lambda k: F.least(F.lit(0.98), F.round(k / (k + 2), 2))

    def entry(order: int, name: str):
        return lambda hits: F.struct(
            F.size(hits).alias("hits"), F.lit(-order).alias("ord"), F.lit(name).alias("category"),
            surely(F.size(hits)).alias("confidence"), F.slice(hits, 1, 6).alias("evidence"))

    entries = [F.transform(F.array(known_words(grams, words)), entry(i, name)) for i, (name, words) in enumerate(lx.SIGNAL_WORDS.items())]
    return F.sort_array(F.filter(F.concat(*entries), lambda e: e["hits"] > 0), asc=False)


def _signal_weight(signals: Column, wanted: str, weight: float, normalise: bool) -> Column:
    name = (lambda s: nm.category_name(s["category"])) if normalise else (lambda s: s["category"])
    kept = F.filter(signals, lambda s: name(s) == wanted)
    return F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["confidence"] * weight)


def fused_category(signals: Column, product_name: Column, text: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Weighted vote: 1.5 x signal, 1.2 per name hit, 0.4 per text hit.

    The caller turns the score into s/(s+1) with :func:`fused_verdict`.
    """
    name_low, text_low = F.lower(product_name), F.lower(text)
    scores = []
    for cat in dict.fromkeys([*lx.SIGNAL_WORDS, *vocabulary]):
        total = _signal_weight(signals, cat, 1.5, normalise=False)
        for w in vocabulary.get(cat, ()):
            total = total + F.contains(name_low, F.lit(w)).cast("int") * 1.2 + F.contains(text_low, F.lit(w)).cast("int") * 0.4
        scores.append((cat, total))
    return best_scored(scores, "UNKNOWN", 0.0)


def fused_verdict(top: Column) -> Column:
    conf = F.least(F.lit(0.98), top["score"] / (top["score"] + 1.0))
    return F.struct(F.when(conf >= 0.40, top["name"]).otherwise("UNKNOWN").alias("category"), F.round(conf, 2).alias("confidence"))


def gated_category(
    df: DataFrame, text_col: str, vocabulary: Mapping[str, Sequence[str]], stage_category: Column | None = None, signals: Column | None = None,
) -> DataFrame:
    """Multi-signal category with an ambiguity gate.

    Adds struct ``gate`` <category,confidence,status,runner_up>.  ``vocabulary``
    maps a category to its words; a word adds 0.15 per hit (0.08 if short), at
    most 0.40.  The top two closer than 0.12 below 0.70 leave the category open.
    The hits of single words are collected in one pass over the text.
    """
    low = F.lower(F.col(text_col))
    single = sorted({w for ws in vocabulary.values() for w in ws if w.isalnum()})
    df = df.withColumn("_hits", F.filter(F.split(low, r"\b"), lambda t: t.isin(*single)))

    def count(w: str) -> Column:
        if w.isalnum():
            return F.size(F.filter(F.col("_hits"), lambda t: t == w))
        return F.regexp_count(low, F.lit(tx.any_word([w])))

    entries = []
    for i, cat in enumerate(dict.fromkeys([*vocabulary, "IMPORTED_PRODUCT"])):
        total = F.lit(0.0)
        if stage_category is not None:
            total = total + F.when(nm.category_name(stage_category) == cat, 0.45).otherwise(0.0)
        if signals is not None:
            total = total + _signal_weight(signals, cat, 0.40, normalise=True)
        for w in vocabulary.get(cat, ()):
            total = total + F.least(F.lit(0.40), count(w) * (0.15 if len(w) > 3 else 0.08))
        if cat == "IMPORTED_PRODUCT":
            total = total + F.when(_contains_word(low, ("imported by", "importer", "country of origin", "made in", "product of")), 0.30).otherwise(0.0)
        entries.append(F.struct(total.alias("raw"), F.lit(-i).alias("ord"), F.lit(cat).alias("category")))
    kept = F.filter(F.array(*entries), lambda e: e["raw"] >= 0.15)
    ranked = F.sort_array(F.transform(kept, lambda e: F.struct(
        F.round(F.least(F.lit(0.99), e["raw"]), 2).alias("confidence"), e["ord"].alias("ord"), e["category"].alias("category"))), asc=False)
    df = df.withColumn("_ranked", ranked)
    first, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    close = F.coalesce((F.round(first["confidence"] - second["confidence"], 2) < 0.12) & (first["confidence"] < 0.70), F.lit(False))
    confidence = F.coalesce(first["confidence"], F.lit(0.0))
    gate = F.struct(
        F.when(close | (confidence < 0.35), "UNKNOWN").otherwise(first["category"]).alias("category"), confidence.alias("confidence"),
        F.when(~close & (confidence >= 0.55), "CONFIRMED").otherwise("NEEDS_REVIEW").alias("status"), second["category"].alias("runner_up"))
    return df.withColumn("gate", gate).drop("_hits", "_ranked")


# --- product attributes, panels, notices ----------------------------------------

# fixed values: product type cues in priority order, with the perishable flag
PRODUCT_TYPES = [
    ("Food", True, r"biscuit|cookie|bread|cake|flour|atta|maida|rice|pulse|dal|tea|coffee|baby\s*food|infant|edible\s*oil|mustard|sunflower|ghee|butter|cheese|paneer|milk|snack|chips|namkeen|noodle|pasta|sauce|jam|pickle|chocolate|candy|fssai"),
    ("Cosmetic/toiletry", True, r"sunscreen|lotion|shampoo|conditioner|cream|soap|perfume|deodorant|serum|lipstick|kajal|mascara|face\s*wash|cosmetic|toiletry|toothpaste|skin"),
    ("Household product", False, r"detergent|dishwash|cleaner|disinfectant|insecticide|mosquito|floor\s*cleaner|bleach|fabric\s*conditioner"),
    ("Clothing/textile", False, r"shirt|t-shirt|pant|trouser|jeans|saree|suit|bedsheet|pillow|towel|garment|clothing|textile|fabric|curtain|dress|socks"),
    ("Electrical/electronic packaged commodity", False, r"bulb|led|cable|charger|wire|battery|switch|fan|heater|iron|appliance|electronic|electrical|earphone|headphone"),
]
SCHEDULED = r"baby\s*food|biscuit|bread|tea|coffee|edible\s*oil|rice|wheat\s*flour|atta|pulses"
MULTIPACK = r"multi\s*pack|pack\s*of\s*[2-9]|combo\s*pack|twin\s*pack|group\s*pack"
LIQUID_UNIT = r"\b(?:ml|l|litre|litres|liter|liters|fluid|fl\.?\s*oz)\b"
LIQUID_WORD = r"liquid|oil|syrup|shampoo|lotion|gel|wash|water|juice|beverage|drink"
AREA = r"(\d+(?:\.\d+)?)\s*(?:x|\*)\s*(\d+(?:\.\d+)?)"
DEFAULT_PDP_AREA = 120.0


def product_attributes(name: Column, net: Column, origin: Column, importer: Column, dimensions: Column, text: Column) -> Column:
    """struct of product type, import, multipack, liquid, perishable, scheduled, panel area."""
    low = F.lower(F.concat_ws(" ", name, text))
    net_low, origin_low = F.lower(F.coalesce(net, F.lit(""))), F.lower(F.coalesce(origin, F.lit("")))
    foreign = F.exists(F.regexp_extract_all(low, F.lit(r"country\s*of\s*origin\s*:\s*([a-z]*)"), F.lit(1)), lambda c: ~F.startswith(c, F.lit("india")))
    imported = ((origin_low != "") & (origin_low != "india")) | (F.coalesce(importer, F.lit("")) != "") | tx.has(low, r"imported\s*by") | foreign
    liquid = tx.has(net_low, LIQUID_UNIT) | tx.has(low, LIQUID_WORD)
    kind, perishable = F.lit(None).cast("string"), F.lit(False)
    for label, spoils, pattern in reversed(PRODUCT_TYPES):
        kind = F.when(tx.has(low, pattern), F.lit(label)).otherwise(kind)
        perishable = F.when(tx.has(low, pattern), F.lit(spoils)).otherwise(perishable)
    kind = F.coalesce(
        kind, F.when(liquid, "Liquid product"), F.when(tx.has(net_low, r"\b(?:g|kg|gm|grams?)\b"), "Weight-based commodity"),
        F.when(F.length(F.coalesce(name, F.lit(""))) < 3, "NEEDS REVIEW"), F.lit("Other packaged commodity"))
    w, h = F.regexp_extract(dimensions, AREA, 1).try_cast("double"), F.regexp_extract(dimensions, AREA, 2).try_cast("double")
    return F.struct(
        kind.alias("product_type"), imported.alias("is_imported"), tx.has(low, MULTIPACK).alias("is_multipack"), liquid.alias("is_liquid"),
        perishable.alias("is_perishable"), ((kind == "Food") & tx.has(low, SCHEDULED)).alias("is_scheduled"),
        F.coalesce(w * h, F.lit(DEFAULT_PDP_AREA)).alias("pdp_area_cm2"),
    )


# fixed values: back-panel signals
BACK_SIGNALS = ("ingredients", "nutritional", "mfg by", "manufactured by", "packed by", "pkd by", "best before", "net qty", "mrp", "plot", "estate", "industrial area", "gidc", "midc")


def panel_from_text(text: Column) -> Column:
    low = F.lower(text)
    signals = F.lit(0)
    for w in BACK_SIGNALS:
        signals = signals + F.contains(low, F.lit(w)).cast("int")
    side = F.contains(low, F.lit("imported by")) & _contains_word(low, ("model", "country of origin"))
    front = _contains_word(low, ("deluxe", "serum", "tea", "biscuit", "shampoo"))
    return F.when(signals >= 2, "BACK").when(side, "SIDE").when(front, "FRONT").otherwise("UNKNOWN")


def panel_from_hint(hint: Column, text: Column, line_count: Column) -> Column:
    h, low = F.lower(F.coalesce(hint, F.lit(""))), F.lower(text)
    return (
        F.when(_contains_word(h, ("pdp", "front")), "Front (PDP)")
        .when(_contains_word(h, ("back",)), "Back Panel")
        .when(_contains_word(h, ("side",)), "Side Panel")
        .when(_contains_word(h, ("code", "stamp", "bottom", "crimp")), "Coding Area")
        .when(_contains_word(h, ("top",)), "Top/Bottom")
        .when(_contains_word(h, ("outer", "carton")), "Outer Carton")
        .when((line_count <= 6) & _contains_word(low, ("b.no", "mrp", "mfd")) & ~_contains_word(low, ("manufactured by",)), "Coding Area")
        .when(_contains_word(low, ("ingredient", "manufactured by", "directions")), "Back Panel")
        .otherwise("Front (PDP)")
    )


# fixed values: audit cascade of the line reader: rule, category, pattern
AUDIT_STEPS = [
    ("Rule 4 / Rule 9 — Directions for Use", "Usage & Directions", "Informational", r"(?i)(?:direction(?:s)?\s*(?:for|of)?\s*use|how\s*to\s*use|apply\s*(?:generously|evenly|liberally)|dosage|usage\s*instructions)"),
    ("Rule 4 / Rule 9 — Formulation / Ingredient Declaration", "Composition & Ingredients", "Informational", r"(?i)(?:ingredients?|composition|active\s*ingredients?|contains\s*:|aqua\b|glycerin|salicylic|titanium|zinc\s*oxide|octocrylene|phenoxyethanol|ethylhexyl|paraben|fragrance|parfum)"),
    ("Rule 4 / Rule 9 — Statutory Warning", "Safety & Warnings", "Informational", r"(?i)(?:warning|caution|for\s*external\s*use\s*only|keep\s*out\s*of\s*reach|avoid\s*contact\s*with\s*eyes|patch\s*test)"),
    ("Rule 6(1)(a) — Marketer Identification", "Commercial Entity", "Compliant", r"(?i)(?:marketed\s*(?:by|at)?|mkt\s*by|marketed\s*&\s*distributed\s*by|मार्क\s*बाय)"),
    ("Rule 6(1)(e) — Retail Sale Price (MRP)", "Pricing & Consumer Protection", "Compliant", r"(?i)mrp|m\.?r\.?p\.?|max(?:imum)?\s*retail\s*price|₹|rs\.?\s*\d+|\b\d+/-\b"),
    ("QUANTITY", "Measurement & Quantity", "Compliant", r"(?i)net\s*(?:qty|quantity|wt|weight|vol|volume|content)|(\d+\s*(?:g|kg|ml|l|count|pcs|n|u)\b)"),
    ("Rule 6(11) / Rule 6(2) — Unit Sale Price (USP)", "Pricing Transparency", "Compliant", r"(?i)u\.?s\.?p|unit\s*sale\s*price|(?:per\s*(?:g|gm|kg|ml|l|piece|unit))"),
    ("Rule 6(1)(d) — Date of Manufacture / Pre-packing / Import", "Temporal Traceability", "Compliant", r"(?i)mfd|mfg|packed|pkd|date\s*of\s*(?:mfg|mfd|packing)|manufactured\s*on"),
    ("Rule 6(1)(da) — Best-Before / Use-By Information", "Consumer Safety", "Compliant", r"(?i)exp(?:iry)?|best\s*before|use\s*before|shelf\s*life"),
    ("PARTY", "Identity & Origin", "Compliant", r"(?i)manufactured|imported\s*(?:by|at)?|विनिर्माता|पैकर|\bpvt\.?\s*ltd\b|\bmills\b|\blaboratories\b|\bfactory\b"),
    ("Rule 6(1)(f) — Consumer Care & Grievance Redressal", "Consumer Grievance Redressal", "Compliant", r"(?i)consumer|care|toll[\s-]free|help\s*desk|grievance|feedback|1800|care@|customer"),
    ("Rule 6(1)(a) — Country of Origin", "Identity & Origin", "Compliant", r"(?i)country\s*of\s*origin|made\s*in|product\s*of"),
    ("Rule 6(1)(g) — Batch or Lot Number", "Traceability & Quality", "Compliant", r"(?i)batch\s*(?:no\.?|number)?|b\.?\s*no\.?|lot\s*(?:no\.?|number)?"),
    ("Rule 14 / Rule 16 / Rule 17 — Dimensions & Usable Sheets", "Specialized Commodity Requirements", "Compliant", r"(?i)(\d+\s*(?:cm|mm|m)\s*[x×]\s*\d+\s*(?:cm|mm|m))|(\d+\s*(?:pulls|sheets|wipes|bags))"),
]


def audit_line(text: Column, line_number: Column) -> Column:
    """Rule, category and status of a line: struct<rule,category,status>."""
    verdict = lambda rule, cat, status: F.struct(F.lit(rule).alias("rule"), F.lit(cat).alias("category"), F.lit(status).alias("status"))
    out = None
    for rule, cat, status, pattern in AUDIT_STEPS:
        test, value = tx.has(text, pattern), verdict(rule, cat, status)
        if rule == "QUANTITY":
            value = (
                F.when(tx.has(text, r"(?i)when\s*packed"), verdict("Rule 11(1) — Net Quantity Qualification", cat, "Non-Compliant"))
                .when(tx.has(text, r"(?i)\b(?:gms|kgs|mls|dozen|gross|lbs|oz)\b"), verdict("Rule 13(1) — Statement of Units & Prohibited Symbols", cat, "Non-Compliant"))
                .otherwise(verdict("Rule 6(1)(c) — Net Quantity in Standard Metric Units", cat, "Compliant")))
        if rule == "PARTY":
            bad = ~tx.has(text, lx.PIN) & tx.has(text, r"(?i)address|road|street|nagar|plot|phase|industrial")
            value = F.when(bad, verdict("Rule 10(1) — Manufacturer Complete Address & PIN Code", cat, "Non-Compliant")).otherwise(
                verdict("Rule 6(1)(a) & Rule 10 — Manufacturer / Packer Identity", cat, "Compliant"))
        out = F.when(test, value) if out is None else out.when(test, value)
    title = (line_number <= 3) & (F.length(text) > 3) & ~tx.has(text, r"(?i)lic|fssai|regd|tm\b")
    return out.when(title, verdict("Rule 6(1)(b) — Common or Generic Name on PDP", "Product Identification", "Compliant")).otherwise(
        verdict("Rule 4 / Rule 9 — Packaging Label Specification", "Supporting Statutory Text", "Informational"))


def resolve_meaning(context: Column, candidates: Column) -> Column:
    """Tie-break between several meanings from cue words.  struct<meaning,confidence>."""
    low = F.lower(context)
    may = lambda name: F.array_contains(candidates, name)
    verdict = lambda name, conf: F.struct(F.lit(name).alias("meaning"), F.lit(conf).alias("confidence"))
    return (
        F.when(_contains_word(low, ("serving", "servings", "nutrition", "per 100", "portion")) & may("SERVING_SIZE"), verdict("SERVING_SIZE", 0.94))
        .when(_contains_word(low, ("ingredients", "contains", "aqua", "composition")) & may("INGREDIENT_QUANTITY"), verdict("INGREDIENT_QUANTITY", 0.94))
        .when(_contains_word(low, ("net", "weight", "qty", "volume", "mass")) & may("NET_QUANTITY"), verdict("NET_QUANTITY", 0.95))
        .otherwise(verdict("UNKNOWN", 0.50))
    )


# fixed values: field relevance by category letter
FIELD_RELEVANCE = {
    "A": {"net_quantity": 1.0, "ingredients": 0.95, "nutrition": 0.95, "serving_size": 0.90, "mrp": 1.0, "dates": 1.0, "batch": 0.95, "manufacturer": 1.0, "dimensions": 0.20},
    "C": {"net_quantity": 1.0, "ingredients": 0.95, "directions": 0.90, "warnings": 0.90, "mrp": 1.0, "dates": 0.95, "batch": 0.95, "manufacturer": 1.0, "serving_size": 0.05},
    "D": {"net_quantity": 1.0, "usage": 0.90, "warnings": 0.95, "manufacturer": 1.0, "mrp": 1.0, "dates": 0.85, "batch": 0.85},
    "F": {"net_quantity": 0.90, "model_number": 0.95, "product_code": 0.90, "dimensions": 0.90, "manufacturer": 1.0, "importer": 0.95, "mrp": 1.0, "ingredients": 0.05, "nutrition": 0.0},
    "I": {"net_quantity": 0.95, "size": 1.0, "dimensions": 0.95, "fabric": 0.90, "mrp": 1.0, "manufacturer": 1.0, "nutrition": 0.0},
    "H": {"net_quantity": 0.95, "count_pieces": 0.95, "age_suitability": 0.95, "warnings": 0.95, "manufacturer": 1.0, "mrp": 1.0, "nutrition": 0.0},
}


def field_relevance(letter: Column, field: Column) -> Column:
    table = F.create_map(*[x for c, ws in FIELD_RELEVANCE.items() for f, w in ws.items() for x in (F.lit(f"{c}:{f}"), F.lit(w))])
    return F.coalesce(F.try_element_at(table, F.concat_ws(":", letter, field)), F.lit(0.5))


# --- noise predicates --------------------------------------------------------------

def is_noise(text: Column) -> Column:
    """Punctuation spam, single signs and rulers."""
    t = tx.strip(F.coalesce(text, F.lit("")))
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}₹]", ""))
    return (
        (n == 0) | ((n == 1) & ~t.rlike(r"[\p{L}\p{N}₹$€]")) | ((n > 6) & ((n - letters) / n > 0.65))
        | t.rlike(r"^[\-_=.~|/\\:;,'\"`!@#$%^&*()+\[\]{} ]+$")
    )


def is_garbled(text: Column) -> Column:
    """Readings without a plausible word: symbols, mixed tokens, fragments, no vowels."""
    t = tx.strip(text)
    n = F.length(t)
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    mixed = F.size(F.filter(words, lambda w: w.rlike(r"[A-Za-z]\d|\d[A-Za-z]") & ~w.rlike(r"(?i)^\d+(?:g|kg|ml|l|cm|m|mm|mg|n)$")))
    letters = F.regexp_replace(F.lower(t), r"[^\p{L}]", "")
    return F.when(t == "", False).otherwise(
        ((n >= 3) & (alnum / n < 0.5))
        | ((mixed >= 1) & ((mixed >= F.size(words) / 2) | F.exists(words, lambda w: F.length(w) <= 4)))
        | ((F.size(words) >= 3) & F.forall(words, lambda w: F.length(w) <= 3))
        | ((F.length(letters) >= 4) & ~letters.rlike("[aeiou]"))
    )


# fixed values: unreadable company names
COMPANY_NOISE = [r"^[\W_]+$", r"(?i)^[a-z0-9_]{1,3}[@|#]{1,3}", r"[|\\/_~—–]{2,}", r"(?i)^(?:[a-z]\s+){3,}[a-z]$"]


def is_company_noise(text: Column) -> Column:
    """Noise test for company names: patterns, few letters, or symbol-ridden words."""
    t = tx.strip(F.coalesce(text, F.lit("")))
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    odd = F.size(F.filter(words, lambda w: w.rlike(r"[|_~@#$%^&*+=\\]")))
    test = (F.length(t) < 3) | (alnum / F.greatest(F.length(t), F.lit(1)) < 0.5) | ((F.size(words) >= 2) & (odd >= F.size(words) / 2))
    for p in COMPANY_NOISE:
        test = test | tx.has(t, p)
    return test


def is_partial_name(text: Column) -> Column:
    """Name that starts with an ellipsis, so its beginning was cut off."""
    return tx.has(tx.strip(text), r"^(?:\.{2,}|…)")
