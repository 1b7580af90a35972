"""Typed declarations from label lines.

All functions work on a row that holds the whole label (``text`` and its
``lines`` array), so extraction is a narrow job: no shuffle, no Python worker,
and labels of any number spread evenly over the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import normalise as nm
from tallymark.functions import text as tx
from tallymark.operators import classify as cl

# fixed values
NET_HEADING = r"(?i)\b(?:Net\s*(?:Qty|Quantity|Weight|Wt|Content|Vol)|वजन)\b"
USP_EXEMPT_LIMIT = 100.0
SLASH_SPAN = r"(?i)(.{0,10})\b([0-9]{2,5}(?:\.[0-9]{2})?)\s*/-(.{0,10})"
PRICE_CONFUSERS = r"(?i)\b(?:g|gm|kg|ml|l|kcal|spf|exp|mfd|pkt)\b"
DATE_SPLIT = r"[/\-.]"


def _first(lines: Column, probe: Callable[[Column], Column], field: str) -> Column:
    """First element of ``probe`` over the lines whose ``field`` is set."""
    return F.get(F.filter(F.transform(lines, probe), lambda h: h[field].isNotNull()), F.lit(0))


def with_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("lines", tx.line_array(F.col(text_col)))


# --- quantity -------------------------------------------------------------------

def _quantity_hit(text: Column, line_index: Column) -> Column:
    amount = F.coalesce(tx.grab(text, lx.NET_NAMED, 1), tx.grab(text, lx.NET_NAMED_HINDI, 1), tx.grab(text, lx.NET_BARE, 1))
    unit = F.coalesce(tx.grab(text, lx.NET_NAMED, 2), tx.grab(text, lx.NET_NAMED_HINDI, 2), tx.grab(text, lx.NET_BARE, 2))
    return F.struct(line_index.alias("line_index"), amount.alias("amount"), unit.alias("unit"))


def net_quantity(df: DataFrame) -> DataFrame:
    """Add ``net``: struct<value,unit,raw_unit,prohibited,line_index,status>.

    First a line outside the nutrition table, then a neighbour of a "Net"
    heading, then the whole text.
    """
    lines = F.col("lines")
    df = df.withColumn("_plain", F.filter(lines, lambda l: ~tx.has(l["text"], lx.NUTRITION)))
    near = F.flatten(F.transform(lines, lambda l, i: F.when(
        tx.has(l["text"], NET_HEADING),
        F.array(F.get(lines, i - 1), F.get(lines, i + 1), F.get(lines, i + 2))).otherwise(F.array(F.lit(None).cast("struct<line_index:int,text:string,raw_text:string>")))))
    df = df.withColumn("_a", _first(F.col("_plain"), lambda l: _quantity_hit(l["text"], l["line_index"]), "amount"))
    near_hit = _first(F.filter(near, lambda l: l.isNotNull()), lambda l: _quantity_hit(l["text"], l["line_index"]), "amount")
    whole = _first(F.array(F.array_join(F.transform("_plain", lambda l: l["text"]), "\n")), lambda t: _quantity_hit(t, F.lit(None).cast("int")), "amount")
    df = df.withColumn("_q", F.coalesce(F.col("_a"), near_hit, whole))
    raw = F.lower(F.col("_q.unit"))
    unit = (
        F.when(raw.isin("gms", "gm", "ग्राम"), "g").when(raw.isin("kgs", "किलो", "किलोग्राम"), "kg").when(raw == "मिली", "ml")
        .when(raw.isin("units", "pieces", "unit", "piece", "पैक"), "N").otherwise(F.col("_q.unit"))
    )
    bad = F.coalesce(raw.isin(*lx.PROHIBITED_UNITS), F.lit(False))
    net = F.struct(
        F.col("_q.amount").try_cast("double").alias("value"), unit.alias("unit"), F.col("_q.unit").alias("raw_unit"), bad.alias("prohibited"),
        F.col("_q.line_index").alias("line_index"),
        F.when(F.col("_q").isNull(), "Under Review").when(bad, "Defective").otherwise("Found").alias("status"))
    return df.withColumn("net", net).drop("_plain", "_a", "_q")


# fixed values: the reader with more unit words and its guards
EXPLICIT_NET = (
    r"(?i)(?:net\s*(?:quantity|qty\.?|weight|wt\.?|vol\.?|volume|content|contents|mass|amount|pack\s*size)?[:.\-\s]*)\s*(\d+(?:\.\d+)?)\s*"
    r"(kg|g|gm|gms|gram|grams|ml|mls|millilitre|milliliter|l|lt|ltr|litre|litres|liter|count|units?|pieces?|pcs|tabs?|caps?|n|u)\b"
)
LABEL_NUTRITION = (
    r"(?i)nutri|energy|kcal|fat\b|saturat|mufa|pufa|cholesterol|carbohydrate|sugar|protein|sodium|potassium|vitamin|mineral|"
    r"approx\.\s*per|per\s*100|serving\s*size|/100g|/100ml|100g\)|100ml\)|table\s*1"
)
NET_ALONE = r"(?i)^net\s*(?:quantity|qty\.?|weight|wt\.?|vol\.?|volume|content|contents|mass)?[:.\-\s]*$"
NEXT_QUANTITY = r"(?i)^(\d+(?:\.\d+)?)\s*(kg|g|gm|gms|gram|grams|ml|mls|millilitre|milliliter|l|lt|ltr|litre|litres|liter|count|units?|pieces?|pcs)\b"
DUAL_METRIC_FIRST = r"(?i)(\d+(?:\.\d+)?)\s*(g|gm|ml)\s*[/|(]\s*(?:\d+(?:\.\d+)?)\s*(?:oz|fl\s*oz)"
DUAL_METRIC_LAST = r"(?i)(?:\d+(?:\.\d+)?)\s*(?:oz|fl\s*oz)\s*[/|(]\s*(\d+(?:\.\d+)?)\s*(g|gm|ml)"
ESTIMATED = r"(?i)\b(\d+(?:\.\d+)?)\s*(g|gm|gms|ml|kg|l)\s*[℮e]\b"
NOT_A_QUANTITY = r"(?i)spf|pa\+|\bpa\b|%|ph\b|vitamin|mrp|rs\b|₹|price|m\.r\.p|lic|fssai|batch|lot|mfd|exp|use\s*before|bar\s*code"
STANDALONE = r"(?i)(?:^|[\s,;])(\d+(?:\.\d+)?)\s*(g|gm|gms|grams|ml|mls|kg|l|ltr|litre)\b"
WHEN_PACKED = r"(?i)when\s*packed|approx(?:imate)?\s*wt"
STANDARD_UNITS = ("g", "kg", "ml", "l", "n", "u")
PLURAL_UNITS = ("gms", "kgs", "mls", "grams", "litres", "ltr")


def label_quantity(df: DataFrame) -> DataFrame:
    """Add ``qty``: struct<numeric,unit,strategy,standard,when_packed,plural>.

    Strategies in order: keyword line or two-line form, keyword anywhere, dual
    unit, estimated sign, stand-alone quantity from the top.
    """
    df = df.withColumn("_clean", nm.quantity_typos(F.col("text")))
    lines, clean = F.col("lines"), F.col("_clean")
    hit = lambda tier, num, unit: F.struct(F.lit(tier).alias("strategy"), num.alias("numeric"), unit.alias("unit"))

    def keyword(l: Column, i: Column) -> Column:
        t, n = l["text"], F.get(lines, i + 1)["text"]

        def hit_of(own: Column) -> Column:
            two = F.when(tx.has(t, NET_ALONE) & ~tx.has(n, LABEL_NUTRITION), tx.grab(n, NEXT_QUANTITY, 1))
            unit = F.when(own.isNotNull(), tx.grab(t, EXPLICIT_NET, 2)).otherwise(tx.grab(n, NEXT_QUANTITY, 2))
            value = F.when(~tx.has(t, LABEL_NUTRITION), F.coalesce(own, two))
            return F.struct(F.when(own.isNotNull(), "keyword").otherwise("two-line").alias("strategy"), value.alias("numeric"), unit.alias("unit"))

        return tx.let(tx.grab(t, EXPLICIT_NET, 1), hit_of)

    def alone(l: Column) -> Column:
        t = l["text"]
        num = tx.grab(t, STANDALONE, 1)
        v = num.try_cast("double")
        fine = ~tx.has(t, LABEL_NUTRITION) & ~tx.has(t, NOT_A_QUANTITY) & (v > 0) & (v <= 50000)
        return hit("standalone", F.when(fine, num), tx.grab(t, STANDALONE, 2))

    first = lambda arr: F.get(F.filter(arr, lambda h: h["numeric"].isNotNull()), F.lit(0))
    lead = F.regexp_extract(clean, r"(?s)(.{0,30})" + EXPLICIT_NET.replace("(?i)", "(?i:") + ")", 1)
    anywhere = hit("global", F.when(~tx.has(lead, LABEL_NUTRITION), tx.grab(clean, EXPLICIT_NET, 1)), tx.grab(clean, EXPLICIT_NET, 2))
    dual = hit("dual unit", F.coalesce(tx.grab(clean, DUAL_METRIC_FIRST, 1), tx.grab(clean, DUAL_METRIC_LAST, 1)),
               F.coalesce(tx.grab(clean, DUAL_METRIC_FIRST, 2), tx.grab(clean, DUAL_METRIC_LAST, 2)))
    est = hit("estimated", tx.grab(clean, ESTIMATED, 1), tx.grab(clean, ESTIMATED, 2))
    df = df.withColumn("_h", F.coalesce(
        first(F.transform(lines, keyword)), first(F.array(anywhere, dual, est)), first(F.transform(lines, alone))))
    unit = F.lower(F.col("_h.unit"))
    return df.withColumn("qty", F.when(F.col("_h").isNotNull(), F.struct(
        F.col("_h.numeric").try_cast("double").alias("numeric"), unit.alias("unit"), F.col("_h.strategy").alias("strategy"),
        ((F.col("_h.strategy") == "dual unit") | unit.isin(*STANDARD_UNITS)).alias("standard"), tx.has(clean, WHEN_PACKED).alias("when_packed"),
        ((F.col("_h.strategy") != "dual unit") & unit.isin(*PLURAL_UNITS)).alias("plural")))).drop("_clean", "_h")


# --- price ------------------------------------------------------------------------

def retail_price(df: DataFrame) -> DataFrame:
    """Add ``mrp``: struct<amount,line_index,tax_phrase,status>.

    The unit sale price is cut out of a line before its price is read.  The tax
    phrase may stand on the line, next to it, or anywhere on the label.
    """
    def price(t: Column) -> Column:
        span = F.concat_ws(" ", F.regexp_extract(t, SLASH_SPAN, 1), F.regexp_extract(t, SLASH_SPAN, 3))
        guarded = F.when(tx.has(t, lx.MRP_SLASH) & ~(tx.has(span, PRICE_CONFUSERS) & ~tx.has(span, r"(?i)mrp|₹|rs")), tx.grab(t, lx.MRP_SLASH))
        return F.coalesce(tx.grab(t, lx.MRP_NAMED), tx.grab(t, lx.MRP_CURRENCY), guarded)

    def probe(l: Column) -> Column:
        # Every price pattern asks for a digit.
        open_ = l["text"].rlike("[0-9]") & ~tx.has(l["text"], lx.NUTRITION)
        return F.struct(l["line_index"].alias("line_index"), F.when(open_, tx.let(F.regexp_replace(l["text"], lx.USP, ""), price)).alias("amount"))

    df = df.withColumn("_m", _first(F.col("lines"), probe, "amount"))
    tax = tx.has(F.col("text"), lx.TAX_PHRASE)
    return df.withColumn("mrp", F.struct(
        F.col("_m.amount").try_cast("double").alias("amount"), F.col("_m.line_index").alias("line_index"), tax.alias("tax_phrase"),
        F.when(F.col("_m").isNull(), "Under Review").when(tax, "Found").otherwise("Defective").alias("status"))).drop("_m")


# fixed values: the six-strategy price reader
PRICE_TOKEN = r"(?:₹|rs\.?|inr)?[\s:]*([0-9]+(?:\.[0-9]{1,2})?|\b[0-9]{2,5}\b)"
PRICE_WITH_TAX = r"(?i)(?:m\.?r\.?p\.?|max(?:imum)?\s*retail\s*price|retail\s*price|m8p|nr\s*p)[\s:]*(?:\(?[^)]*taxes?[^)]*\)?[\s:]*)*" + PRICE_TOKEN
PRICE_PLAIN = r"(?i)(?:m\.?r\.?p\.?|max(?:imum)?\s*retail\s*price|retail\s*price|m8p|nr\s*p)[\s:]*" + PRICE_TOKEN
PRICE_CURRENCY = r"(?i)(?:₹|rs\.?|inr)[\s:]*([0-9]+(?:\.[0-9]{1,2})?|\b[0-9]{2,5}\b)"
PRICE_NEXT = r"(?i)" + PRICE_TOKEN
PRICE_SLASH = r"(?:^|[\s:₹])([0-9]{2,5}(?:\.[0-9]{2})?)\s*(?:/-|/=)"
PRICE_HEAD = r"(?i)^(?:m\.?r\.?p\.?|max(?:imum)?\s*retail\s*price|retail\s*price|m8p|nr\s*p|price)[\s:]*$|mrp\b"
PRICE_UNREADABLE = r"(?i)mrp|m\.r\.p|m8p|retail\s*price"
TAX_STATEMENT = r"(?i)inclusive\s*of\s*all\s*taxes|incl\.?\s*of\s*all\s*taxes|incl\.?\s*all\s*taxes|incl\.?\s*taxes|all\s*taxes\s*incl|inclusive\s*all\s*taxes|incl\.\s*of\s*taxes"
DISQUALIFIED = [
    r"(?i)\busp\b|unit\s*sale\s*price|/g\b|/ml\b|/piece\b|/kg\b|/l\b|/unit\b",
    r"(?i)nutri|energy|kcal|calorie|fat\b|carbohydrate|sugar|protein|sodium",
    r"(?i)\bspf\s*\d+\b|\bpa\+{1,4}",
    r"(?i)^(?:mfd|pkd|mfg|exp|use\s*before|best\s*before)[\s:]*[0-9]{2}[/-][0-9]{2,4}$",
]
NET_LINE = r"(?i)\bnet\s*(?:wt\.?|qty|quantity)\b|\b\d+\s*(?:g|gm|gms|ml|kg|l|ltr)\b"
PRICE_WORDS = r"(?i)mrp|price|₹|rs"


def disqualified(text: Column) -> Column:
    test = tx.has(text, NET_LINE) & ~tx.has(text, PRICE_WORDS)
    for p in DISQUALIFIED:
        test = test | tx.has(text, p)
    return test


def detect_price(df: DataFrame, words_col: str | None = None) -> DataFrame:
    """Add ``price``: struct<amount,strategy,confidence,status,tax,sticker>.

    Direct pattern .98, price on one of the next two lines .95, price word near
    a keyword word .94, currency .90, slash-dash .88, else an unreadable price
    goes to review at .60.
    """
    lines = F.col("lines")
    df = df.withColumn("_ok", F.transform(lines, lambda l: F.struct(l["text"].alias("text"), disqualified(l["text"]).alias("bad"))))
    ok = F.col("_ok")
    hit = lambda strategy, conf, value: F.struct(value.alias("amount"), F.lit(strategy).alias("strategy"), F.lit(conf).alias("confidence"))

    def direct(l: Column) -> Column:
        def value(t: Column) -> Column:
            amount = F.coalesce(*[nm.parse_price(tx.grab(t, p)) for p in (PRICE_WITH_TAX, PRICE_PLAIN, PRICE_CURRENCY)])
            return F.when(tx.has(t, r"(?i)mrp|price"), amount)
        return hit("direct", 0.98, F.when(~l["bad"], tx.let(nm.mrp_keyword(l["text"]), value)))

    def ahead(l: Column, i: Column) -> Column:
        def at(step: int) -> Column:
            n = F.get(ok, i + step)
            return F.when(~n["bad"], nm.parse_price(tx.grab(n["text"], PRICE_NEXT)))
        return hit("next line", 0.95, F.when(~l["bad"] & tx.has(l["text"], PRICE_HEAD), F.coalesce(at(1), at(2))))

    simple = lambda name, conf, pattern: lambda l: hit(name, conf, F.when(~l["bad"], nm.parse_price(tx.grab(l["text"], pattern))))
    first = lambda arr: F.get(F.filter(arr, lambda h: h["amount"].isNotNull()), F.lit(0))
    choices = [first(F.transform(ok, direct)), first(F.transform(ok, ahead))]
    if words_col is not None:
        choices.append(first(F.transform(F.array(near_price(F.col(words_col))), lambda v: hit("near word", 0.94, v))))
    choices += [first(F.transform(ok, simple("currency", 0.90, PRICE_CURRENCY))), first(F.transform(ok, simple("slash-dash", 0.88, PRICE_SLASH)))]
    df = df.withColumn("_p", F.coalesce(*choices))
    unreadable = F.exists(lines, lambda l: tx.has(l["text"], PRICE_UNREADABLE))
    found = F.col("_p").isNotNull()
    low = F.lower("text")
    sticker = F.contains(low, F.lit("revised mrp")) | F.contains(low, F.lit("new mrp")) | F.contains(low, F.lit("sticker"))
    return df.withColumn("price", F.struct(
        F.col("_p.amount").alias("amount"), F.coalesce(F.col("_p.strategy"), F.when(unreadable, "unreadable")).alias("strategy"),
        F.when(found, F.col("_p.confidence")).when(unreadable, 0.60).alias("confidence"),
        F.when(found, "DETECTED").when(unreadable, "REVIEW").otherwise("NOT DETECTED").alias("status"),
        tx.has(F.col("text"), TAX_STATEMENT).alias("tax"), sticker.alias("sticker"))).drop("_ok", "_p")


def near_price(words: Column, dx: float = 250.0, dy: float = 100.0) -> Column:
    """First price-like word close to a keyword word, words of one image in one array."""
    keys = F.filter(words, lambda w: w["text"].rlike(r"(?i)mrp|m\.r\.p|m8p|price"))
    numbers = F.filter(words, lambda w: w["text"].rlike(r"(?i)(?:₹|rs\.?)?[0-9]{2,5}(?:\.[0-9]{2})?(?:/-)?"))
    close = lambda k: F.filter(numbers, lambda n: (F.abs(n["x0"] - k["x1"]) < dx) & (F.abs(n["y0"] - k["y0"]) < dy))
    values = F.flatten(F.transform(keys, lambda k: F.transform(close(k), lambda n: nm.parse_price(F.regexp_extract(n["text"], r"([0-9]+(?:\.[0-9]{1,2})?)", 1)))))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def unit_sale_price(df: DataFrame) -> DataFrame:
    """Add ``usp``: struct<value,exempt,status>; small packs are exempt."""
    amount, unit = tx.grab(F.col("text"), lx.USP, 1), tx.grab(F.col("text"), lx.USP, 2)
    small = F.coalesce((F.col("net.value") > 0) & (F.col("net.value") <= USP_EXEMPT_LIMIT), F.lit(False))
    return df.withColumn("usp", F.struct(
        F.concat(F.lit("USP ₹ "), amount, F.lit("/"), unit).alias("value"), (amount.isNull() & small).alias("exempt"),
        F.when(amount.isNotNull() | small, "Found").otherwise("Under Review").alias("status")))


# --- dates, batch, contacts ---------------------------------------------------------

def first_or_whole(pattern: str, group: int = 1) -> Column:
    """Value on the first line that has it, else across line breaks."""
    return F.coalesce(tx.first_line_match(F.col("lines"), pattern, group), tx.grab(F.col("text"), pattern, group))


def dates(df: DataFrame) -> DataFrame:
    """Add ``mfd``, ``pkd``, ``best_before``, ``expiry`` and the parts of ``mfd``."""
    df = (df.withColumn("mfd", first_or_whole(lx.MFD)).withColumn("pkd", first_or_whole(lx.PKD))
          .withColumn("best_before", first_or_whole(lx.BEST_BEFORE)).withColumn("expiry", first_or_whole(lx.EXP)))
    parts = F.split("mfd", DATE_SPLIT)
    smudged = F.exists("lines", lambda l: tx.has(l["text"], r"(?i)\b(?:mfd|mfg|pkd|exp)\b.*\?"))
    return (df.withColumn("mfd_month", F.get(parts, F.lit(0))).withColumn("mfd_year", F.get(parts, F.lit(1)))
            .withColumn("packing_date", F.coalesce("pkd", "mfd")).withColumn("date_uncertain", smudged)
            .withColumn("shelf_life_months", F.regexp_extract("best_before", r"(\d{1,2})\s*months?", 1).try_cast("int")))


def contacts(df: DataFrame) -> DataFrame:
    text = F.col("text")
    origin = F.btrim(F.regexp_extract(text, lx.ORIGIN, 1))
    return (df.withColumn("batch", tx.first_line_match(F.col("lines"), lx.BATCH)).withColumn("phone", tx.grab(text, lx.PHONE, 0))
            .withColumn("email", tx.grab(text, lx.EMAIL, 0)).withColumn("pin", tx.grab(text, lx.PIN))
            .withColumn("country_of_origin", F.coalesce(F.nullif(origin, F.lit("")), F.lit("India"))))


# --- title and section texts ------------------------------------------------------------

def classified_lines(df: DataFrame) -> DataFrame:
    """Add ``classed``: array<struct<line_index,text,line_class>> of the label."""
    lines = F.col("lines")
    return df.withColumn("classed", F.transform(lines, lambda l, i: F.struct(
        l["line_index"].alias("line_index"), l["text"].alias("text"),
        cl.line_class(l["text"], F.get(lines, i - 1)["text"], F.get(lines, i - 2)["text"])["name"].alias("line_class"))))


SKIPPED_TITLES = ("MARKETING_CLAIM", "INGREDIENT", "INGREDIENTS", "POSSIBLE_INGREDIENTS", "WARNING", "DIRECTIONS", "MARKETER", "MANUFACTURER_NAME", "MANUFACTURER_ADDRESS")


def title_and_sections(df: DataFrame) -> DataFrame:
    """Add product name, brand and the joined section texts from ``classed``."""
    usable = F.filter("classed", lambda l: ~l["line_class"].isin(*SKIPPED_TITLES) & ~tx.has(l["text"], lx.MARKETING)
                      & ~tx.has(l["text"], lx.INGREDIENT) & ~tx.has(l["text"], lx.TITLE_SKIP) & (F.length(l["text"]) >= 3))
    df = df.withColumn("_title", F.coalesce(F.get(usable, F.lit(0))["text"], F.get("classed", F.lit(0))["text"], F.lit("Packaged Commodity")))
    df = df.withColumn("_garbled", cl.is_garbled(F.col("_title")))
    words = F.split("_title", r"\s+")
    head = F.get(words, F.lit(0))
    joined = lambda *names: F.nullif(F.array_join(F.transform(F.filter("classed", lambda l: l["line_class"].isin(*names)), lambda l: l["text"]), " | "), F.lit(""))
    return (
        df.withColumn("product_name", F.when(F.col("_garbled"), "Needs Review").otherwise(F.col("_title")))
        .withColumn("name_status", F.when(F.col("_garbled"), "Under Review").otherwise("Found"))
        .withColumn("brand", F.when(~F.col("_garbled"), F.when(F.size(words) == 1, F.col("_title")).when(~F.lower(head).isin(*lx.BRAND_STOP_WORDS), head)))
        .withColumn("directions_text", joined("DIRECTIONS")).withColumn("ingredients_text", joined("INGREDIENTS", "POSSIBLE_INGREDIENTS"))
        .withColumn("warnings_text", joined("WARNING")).drop("_title", "_garbled")
    )


def declarations(df: DataFrame) -> DataFrame:
    """One wide row per label: every typed declaration of the text."""
    df = with_lines(df)
    for step in (net_quantity, retail_price, unit_sale_price, dates, contacts, classified_lines, title_and_sections):
        df = step(df)
    return df


# fixed values: the deterministic extractor
NAME_SKIP = r"(?i)mrp|rs|₹|net|qty|mfd|exp|batch|lic|fssai|ingred|care"
SIMPLE_NUTRITION = r"(?i)nutri|energy|fat|carb|protein|sugar|approx|per\s*100"
SIMPLE_NET = r"(?i)(?:Net\s*(?:Qty\.?|Quantity|Weight|Wt\.?|Content|Contents|Vol\.?|Volume|Mass)?[:.\-\s]*)\s*([0-9]+(?:\.[0-9]+)?)\s*(gms|kgs|g|kg|ml|l|ltr|gm)\b"
SIMPLE_BARE = r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(gms|kgs|g|kg|ml|l|ltr|gm)\b"
SIMPLE_TAX = r"(?i)incl(?:usive)?\.?\s*(?:of)?\s*all\s*taxes|incl\.?\s*taxes"
SIMPLE_PARTY = r"(?i)mfd\s*by|manufactured\s*by|packed\s*by|pkd\s*by|marketed\s*by"
SIMPLE_PLACE = r"(?i)plot|sector|road|industrial|street|lane|nagar"
SIMPLE_PHONE = r"(?:1800(?:[-\s]?[0-9]{2,4}){2,3}|011[-\s]?[0-9]{8}|[0-9]{10})"


def simple_label(df: DataFrame) -> DataFrame:
    """Default extractor: one flat row per transcript (see ``run_extractor``)."""
    df = with_lines(df)
    lines, text = F.col("lines"), F.col("text")
    pick = lambda test: F.get(F.filter(lines, lambda l: test(l["text"])), F.lit(0))["text"]
    scope = F.array_join(F.transform(F.filter(lines, lambda l: ~tx.has(l["text"], SIMPLE_NUTRITION)), lambda l: l["text"]), "\n")
    df = df.withColumn("_scope", F.coalesce(F.nullif(scope, F.lit("")), text))
    party = pick(lambda t: tx.has(t, SIMPLE_PARTY))
    df = df.withColumn("_party", party).withColumn("address", F.coalesce(F.col("_party"), pick(lambda t: tx.has(t, SIMPLE_PLACE))))
    s = F.col("_scope")
    unit = F.coalesce(tx.grab(s, SIMPLE_NET, 2), tx.grab(s, SIMPLE_BARE, 2))
    name = pick(lambda t: (F.length(t) >= 4) & ~tx.has(t, NAME_SKIP))
    maker = F.when(F.col("_party").isNotNull(), F.btrim(F.element_at(F.split("_party", r"[,:\-]"), -1))).otherwise(F.btrim(F.get(F.split("address", ","), F.lit(0))))
    return df.select(
        *[c for c in df.columns if c not in ("lines", "_scope", "_party")],
        F.coalesce(name, F.get(lines, F.lit(0))["text"], F.lit("Packaged Commodity")).alias("product_name"),
        F.coalesce(tx.grab(s, SIMPLE_NET, 1), tx.grab(s, SIMPLE_BARE, 1)).try_cast("double").alias("net_value"), unit.alias("net_unit"),
        ~F.coalesce(F.lower(unit).isin(*lx.PROHIBITED_UNITS), F.lit(False)).alias("complies_units"),
        F.coalesce(tx.grab(text, lx.MRP_NAMED), tx.grab(text, lx.MRP_CURRENCY)).try_cast("double").alias("mrp_amount"), tx.has(text, SIMPLE_TAX).alias("tax_phrase"),
        F.coalesce(F.nullif(maker, F.lit("")), F.lit("Manufacturer Unspecified")).alias("manufacturer"),
        tx.grab(F.coalesce(F.col("address"), text), lx.PIN).alias("pin"), tx.grab(text, SIMPLE_PHONE, 0).alias("phone"), tx.grab(text, lx.EMAIL, 0).alias("email"),
    )


def run_extractor(df: DataFrame, extractor: Callable[[DataFrame], DataFrame] = simple_label) -> DataFrame:
    """Plug-in point: any frame-to-frame callable may replace the extractor."""
    return extractor(df)


# fixed values: canonical fields: name, value column, rule
CANONICAL_FIELDS = [
    ("brand", "Rule 6(1)"), ("product_name", "Rule 6(1)(b)"), ("net_quantity", "Rule 6(1)(c)"), ("unit", "Rule 13"), ("mrp", "Rule 6(1)(e)"),
    ("tax_inclusive_wording", "Rule 6(1)(e)"), ("unit_sale_price", "Rule 6(11)"), ("mfd", "Rule 6(1)(d)"), ("pkd", "Rule 6(1)(d)"),
    ("best_before", "Rule 6(1)(da)"), ("expiry", "Rule 6(1)(da)"), ("batch_number", "Rule 6(1)(g)"), ("consumer_care_phone", "Rule 6(1)(f)"),
    ("consumer_care_email", "Rule 6(1)(f)"), ("country_of_origin", "Rule 6(1)(n)"), ("postal_pin", "Rule 10(1)"), ("directions", "Rule 4"),
    ("ingredients", "Rule 4"), ("warnings", "Rule 4"),
]


def canonical_fields(wide: DataFrame, key: str) -> DataFrame:
    """Wide declarations to one row per (label, field) with value and status."""
    number = lambda c: F.format_number(c, 2)
    values = {
        "brand": F.col("brand"), "product_name": F.col("product_name"), "net_quantity": F.col("net.value").cast("string"), "unit": F.col("net.unit"),
        "mrp": F.replace(number(F.col("mrp.amount")), F.lit(","), F.lit("")), "tax_inclusive_wording": F.when(F.col("mrp.tax_phrase"), "inclusive of all taxes"),
        "unit_sale_price": F.col("usp.value"), "mfd": F.col("mfd"), "pkd": F.col("packing_date"), "best_before": F.col("best_before"), "expiry": F.col("expiry"),
        "batch_number": F.col("batch"), "consumer_care_phone": F.col("phone"), "consumer_care_email": F.col("email"), "country_of_origin": F.col("country_of_origin"),
        "postal_pin": F.col("pin"), "directions": F.col("directions_text"), "ingredients": F.col("ingredients_text"), "warnings": F.col("warnings_text"),
    }
    status = {"net_quantity": F.col("net.status"), "unit": F.col("net.status"), "mrp": F.col("mrp.status"), "unit_sale_price": F.col("usp.status"), "product_name": F.col("name_status"),
              "tax_inclusive_wording": F.when(F.col("mrp.amount").isNull(), "Under Review").when(F.col("mrp.tax_phrase"), "Found").otherwise("Missing")}
    rows = [F.struct(F.lit(n).alias("field_name"), values[n].alias("value"), F.lit(rule).alias("rule_reference"),
                     status.get(n, F.when(values[n].isNotNull(), "Found").otherwise("Under Review")).alias("status")) for n, rule in CANONICAL_FIELDS]
    return wide.select(key, F.inline(F.array(*rows)))


# --- confidences -----------------------------------------------------------------------

def weighted_confidence(ocr: Column, agreement: Column, semantic: Column, spatial: Column, pattern: Column, context: Column, ambiguous: Column) -> Column:
    """struct<score,level> of the weighted field confidence."""
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ocr * 0.20 + agreement * 0.15 + semantic * 0.25 + spatial * 0.15 + pattern * 0.15 + context * 0.10)), 2)
    final = F.when(ambiguous, 0.45).otherwise(score)
    level = F.when(ambiguous, "Needs Review").when(score >= 0.88, "High").when(score >= 0.65, "Medium").when(score >= 0.50, "Low").otherwise("Needs Review")
    return F.struct(final.alias("score"), level.alias("level"))


GEOMETRIC_WEIGHTS = {"ocr": 0.25, "detection": 0.15, "layout": 0.20, "semantic": 0.25, "category": 0.10, "rule": 0.05}
REVIEW_THRESHOLD = 0.65


def geometric_confidence(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in GEOMETRIC_WEIGHTS.items():
        value = parts.get(name, F.lit(0.95))
        total = total + F.log(F.greatest(F.lit(0.1), F.least(F.lit(1.0), value))) * weight
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.10), F.exp(total / sum(GEOMETRIC_WEIGHTS.values())))), 2)


def gate_status(status: Column, confidence: Column) -> Column:
    return F.when((confidence < REVIEW_THRESHOLD) & (status == "RESOLVED"), "NEEDS_REVIEW").otherwise(status)


def explain(fields: DataFrame) -> DataFrame:
    """Explanation row per field: value, meaning, confidence in per cent, reason."""
    return fields.withColumn("explanation", F.format_string(
        "'%s' read as %s at %d%%: %s", F.col("value"), F.col("meaning"), F.round(F.col("confidence") * 100).cast("int"), F.col("reason")))
