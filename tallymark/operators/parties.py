"""Commercial parties: roles, names, addresses, identifiers, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import text as tx
from tallymark.operators import classify as cl

# fixed values: explicit role wording by priority; composites stand for two roles
ROLE_WORDS = [
    ("MANUFACTURER,MARKETER", r"(?i)\b(?:manufactured\s+(?:and|&)\s+marketed\s+by|mfg\s*(?:and|&)\s*mkt\s*by)\b"),
    ("MANUFACTURER,PACKER", r"(?i)\b(?:manufactured\s*[/&]\s*packed\s+by|mfg\s*[/&]\s*pkd\s+by)\b"),
    ("IMPORTER,DISTRIBUTOR", r"(?i)\b(?:importer\s*[/&]\s*distributor|imported\s+(?:and|&)\s+distributed\s+by)\b"),
    ("MANUFACTURER", r"(?i)\b(?:manufactured\s+by|manufactured\s+at|manufactured\s+for|mfg\.?\s*by|mfd\.?\s*by|mfg\s+at|mfd\s+at|(?:[il1]+[a-z]*anu[a-z]*|mfg|mfd|ilg|mfc)[a-z]*\s*(?:by|at|for|e|:)?)\b"),
    ("PACKER", r"(?i)\b(?:packed\s+by|packed\s+at|packed\s+for|packer|pkd\.?\s*by|pkd\s+at|(?:pkd|pck)[a-z]*\s*(?:by|at)?)\b"),
    ("MARKETER", r"(?i)\b(?:marketed\s+by|marketed\s+for|mkt\.?\s*by|mktg\.?\s*by|(?:mkt|mktg)[a-z]*\s*(?:by|for)?)\b"),
    ("IMPORTER", r"(?i)\b(?:imported\s+by|imported\s+for|imp\.?\s*by|importer|(?:imp|impt)[a-z]*\s*(?:by|for)?)\b"),
    ("DISTRIBUTOR", r"(?i)\b(?:distributed\s+by|distributor)\b"),
    ("SELLER", r"(?i)\b(?:sold\s+by|seller)\b"),
    ("OWNER", r"(?i)\b(?:owned\s+by|trademark\s+owned\s+by|brand\s+owned\s+by)\b"),
    ("LICENSE_HOLDER", r"(?i)\b(?:license\s+holder|licensed\s+by|under\s+licen[sc]e\s+(?:from|of))\b"),
]
COMPANY = (
    r"(?i)\b(?:p[uvt]+[.\s]*ltd\.?|pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|llp|inc\.?|corp\.?|corporation|industries|enterprises|laboratories|labs|"
    r"foods|pharmaceuticals|pharma|cosmetics|confectionery|beverages|products|manufacturing|mfg|international|company|co\.)\b"
)
COMPANY_SUFFIX = r"(?i)\b(?:p[uvt]+[.\s]*ltd\.?|pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|llp|inc\.?|corp\.?|corporation)\b"
PLACE_WORDS = (
    r"(?i)\b(?:plot|survey|khasra|bldg|building|floor|industrial\s+area|ind\.\s*area|g\.?i\.?d\.?c\.?|m\.?i\.?d\.?c\.?|estate|sector|phase|nagar|marg|road|street|"
    r"lane|chowk|village|dist\.?|district|taluka|tehsil|near|opp\.?|opposite|post|p\.?o\.?|city|state)\b"
)
PLACES = (
    "maharashtra", "delhi", "karnataka", "tamil nadu", "gujarat", "uttar pradesh", "west bengal", "rajasthan", "telangana", "andhra pradesh", "kerala", "punjab",
    "haryana", "bihar", "odisha", "assam", "goa", "madhya pradesh", "jharkhand", "uttarakhand", "himachal pradesh", "mumbai", "bengaluru", "chennai", "kolkata",
    "hyderabad", "pune", "ahmedabad", "gurugram", "noida", "new delhi",
)
OTHER_PARTY = r"(?i)\b(?:manufactured|packed|marketed|imported|mfg|pkd|mkt|imp)\s+by\b"
BLOCK_END = r"(?i)\b(?:ingredients|nutritional\s+facts)\b"
ADDRESS_PREFIX = r"(?i)^(?:mfg|manufactured|packed|marketed|imported|pkd|mkt|imp)\s*(?:by|at|for)?[:\s\-]*"
IDENTIFIERS = {
    "model_number": r"(?i)\b(?:model\s*no\.?|model\s*number|model)[:\s\-]*([A-Za-z0-9\-_/]+)",
    "sku": r"(?i)\b(?:sku\s*no\.?|sku)[:\s\-]*([A-Za-z0-9\-_/]+)",
    "article_number": r"(?i)\b(?:article\s*no\.?|item\s*no\.?|art\.\s*no\.?)[:\s\-]*([A-Za-z0-9\-_/]+)",
    "product_code": r"(?i)\b(?:product\s*code|part\s*no\.?|p/n)[:\s\-]*([A-Za-z0-9\-_/]+)",
    "batch_number": r"(?i)\b(?:batch\s*no\.?|batch)[:\s\-]*([A-Za-z0-9\-_/]+)",
    "lot_number": r"(?i)\b(?:lot\s*no\.?|lot)[:\s\-]*([A-Za-z0-9\-_/]+)",
    "serial_number": r"(?i)\b(?:serial\s*no\.?|s/n)[:\s\-]*([A-Za-z0-9\-_/]+)",
}
ORIGIN_LINE = r"(?i)\b(?:country\s*o[fr]\s*origin|made\s+in|product\s+of|imported\s+from|mfd\s+in)\s*[:\s\-]*([A-Za-z\s]+)"
COUNTRIES = (
    "india", "china", "germany", "japan", "usa", "united states", "vietnam", "thailand", "bangladesh", "indonesia", "italy", "france", "united kingdom", "uk",
    "taiwan", "south korea", "korea", "malaysia", "switzerland", "netherlands",
)
STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala",
    "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura",
    "Uttar Pradesh", "Uttarakhand", "West Bengal", "Delhi",
)
CITIES = (
    "Mumbai", "Delhi", "Bengaluru", "Bangalore", "Kolkata", "Chennai", "Hyderabad", "Pune", "Ahmedabad", "Gurugram", "Gurgaon", "Noida", "Baddi", "Haridwar", "Solan",
    "Alwar", "Thane", "Nagpur", "Indore", "Surat", "Jaipur", "Lucknow", "Kanpur", "Bhiwandi", "Ratnagiri", "Khurja", "Morena", "Gwalior", "Dehradun", "Karnal", "Bidadi",
)
DECLARATION_LINE = r"(?i)\b(?:mrp|net\s+qty|mfg|packed|marketed|imported|ingredients|nutrition|best\s+before|batch|exp)\b"
BRAND_PREFIX = r"(?i)^(?:brand|brand\s*name|tm|trademark)[:\s\-]*"
DESCRIPTORS = (
    "biscuits", "cookies", "chips", "tea", "coffee", "oil", "flour", "atta", "rice", "salt", "sugar", "jam", "sauce", "shampoo", "soap", "face wash", "serum", "lotion",
    "cream", "detergent", "cleaner", "liquid", "sanitizer", "toothpaste", "mouse", "keyboard", "charger", "adapter", "bulb", "notebook", "shirt", "t-shirt", "towel",
    "battery", "cable", "juice", "water", "perfume", "deodorant", "gel",
)
VARIANTS = [
    r"(?i)\b(?:lemon|lime|mint|orange|strawberry|chocolate|vanilla|almond|neem|tulsi|aloe\s*vera)\b",
    r"(?i)\b(?:extra\s*strong|mild|classic|premium|deluxe|gold|silver|platinum|regular|diet|sugar\s*free|zero|ultra|pro)\b",
    r"(?i)\b(?:small|medium|large|xl|xxl|pack\s*of\s*\d+|\d+\s*pcs?|combo)\b",
    r"(?i)\b(?:red|blue|green|black|white|silver|matte|glossy)\b",
]


def _in_any(low: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w))
    return test


def is_place_text(text: Column) -> Column:
    named = tx.let(F.lower(text), lambda low: _in_any(low, PLACES))
    return F.coalesce(tx.has(text, PLACE_WORDS) | tx.has(text, lx.PIN) | named, F.lit(False))


def role_of(text: Column) -> Column:
    """Comma-joined role names of a line, null without role wording."""
    out = None
    for roles, pattern in ROLE_WORDS:
        out = F.when(tx.has(text, pattern), roles) if out is None else out.when(tx.has(text, pattern), roles)
    return out


def roles(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per role; a composite wording yields two rows."""
    return df.withColumn("role", F.explode(F.split(role_of(F.col(text_col)), ",")))


def company_candidate(text: Column) -> Column:
    """struct<name,partial,garbage,confidence>: a name needs a corporate word."""
    clean = tx.strip(text)
    partial = cl.is_partial_name(clean)
    name = tx.strip(F.regexp_replace(clean, r"^(?:\.{2,}|…)\s*", ""))
    noise = cl.is_company_noise(clean)
    has = tx.has(name, COMPANY) & ~noise
    conf = F.when(~has, 0.0).when(partial, 0.75).when(tx.has(name, COMPANY_SUFFIX), 0.95).otherwise(0.80)
    return F.struct(F.when(has, name).alias("name"), (has & partial).alias("partial"), noise.alias("garbage"), conf.alias("confidence"))


def _stop(t: Column) -> Column:
    test = tx.has(t, lx.CUTOFF) | tx.has(t, lx.MARKETING) | tx.has(t, lx.INGREDIENT)
    for p in lx.ROLE_TRIGGERS.values():
        test = test | tx.has(t, p)
    return test


def commercial_entities(df: DataFrame) -> DataFrame:
    """Rows (role, name, address, pin) for the four roles found on a label.

    Works on the ``lines`` array of the label: the trigger line, an inline or
    next-line name, a wrapped corporate suffix, then at most five address lines.
    """
    df = df.withColumn("_t", F.transform("lines", lambda l: F.struct(
        l["text"].alias("text"), _stop(l["text"]).alias("stop"), (tx.has(l["text"], lx.MARKETING) | tx.has(l["text"], lx.INGREDIENT)).alias("copy"))))
    t = F.col("_t")

    def trigger(role: str, pattern: str) -> Column:
        def test(l: Column) -> Column:
            hit = tx.has(l["text"], pattern)
            if role in ("MANUFACTURER", "PACKER"):
                hit = hit | tx.has(l["text"], lx.JOINT_PACKER)
            return hit & ~l["copy"]
        return F.array_position(F.transform(t, test), True)

    found = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), trigger(r, p).cast("int").alias("at")) for r, p in lx.ROLE_TRIGGERS.items()]), lambda r: r["at"] > 0)
    keys = [c for c in df.columns if c not in ("_t", "lines")]
    d = df.select(*keys, "_t", F.inline(found))
    at = F.col("at")
    copy = lambda c: tx.has(c, lx.MARKETING) | tx.has(c, lx.INGREDIENT)
    cue = lambda c: tx.has(F.get(F.split(c, ","), F.lit(0)), lx.ADDRESS_CUES)
    head = lambda c: F.btrim(F.get(F.split(c, ",", 2), F.lit(0)))
    tail = lambda c: F.nullif(F.btrim(F.get(F.split(c, ",", 2), F.lit(1))), F.lit(""))
    d = d.withColumn("_first", F.get(t, at - 1)["text"]).withColumn("_n1", F.get(t, at))
    d = d.withColumn("_after", F.btrim(F.regexp_replace("_first", lx.ROLE_PREFIX, ""), F.lit(" :.-")))
    after, n1 = F.col("_after"), F.col("_n1")
    d = d.withColumn("_inline", (F.length(after) >= 3) & ~cue(after) & ~copy(after))
    d = d.withColumn("_next", ~F.col("_inline") & F.coalesce(~n1["stop"], F.lit(False)))
    split_next = F.contains(n1["text"], F.lit(",")) & ~cue(n1["text"])
    d = d.withColumn("_name", F.when(F.col("_inline"), head(after)).when(F.col("_next"), F.when(split_next, head(n1["text"])).otherwise(n1["text"])))
    d = d.withColumn("_addr", F.array_compact(F.array(
        F.when(F.col("_inline"), tail(after)).when((F.length(after) >= 3) & ~copy(after), after),
        F.when(F.col("_next") & split_next, tail(n1["text"])))))
    d = d.withColumn("_used", F.when(F.col("_next"), 1).otherwise(0)).withColumn("_w", F.get(t, at + F.col("_used")))
    w = F.col("_w")
    wrap = (F.col("_name").isNotNull() & ~tx.has(F.col("_name"), lx.CORPORATE) & ~w["stop"]
            & (tx.has(w["text"], lx.CORPORATE) | (~tx.has(w["text"], lx.ADDRESS_CUES) & (F.length(w["text"]) < 40) & ~w["text"].rlike(r"\d"))))
    d = d.withColumn("_wrap", F.coalesce(wrap, F.lit(False)))
    d = d.withColumn("_name", F.when(F.col("_wrap"), F.concat_ws(" ", "_name", head(w["text"]))).otherwise(F.col("_name")))
    rest = F.slice(t, at + F.col("_used") + F.when(F.col("_wrap"), 1).otherwise(0) + 1, 5)
    d = d.withColumn("_rest", rest).withColumn("_cut", F.array_position(F.transform("_rest", lambda l: l["stop"]), True).cast("int"))
    taken = F.transform(F.when(F.col("_cut") > 0, F.slice("_rest", 1, F.greatest(F.col("_cut") - 1, F.lit(0)))).otherwise(F.col("_rest")), lambda l: l["text"])
    parts = F.concat(F.col("_addr"), F.when(F.col("_wrap"), F.array_compact(F.array(tail(w["text"])))).otherwise(F.array().cast("array<string>")), taken)
    d = d.withColumn("_parts", parts)
    trim = lambda c: F.btrim(c, F.lit(" ,.-"))
    d = d.withColumn("name", F.nullif(trim(F.regexp_replace(trim(F.coalesce("_name", F.lit(""))), r"(?i)^(?:by|at|for)\s+", "")), F.lit("")))
    d = d.withColumn("address", F.concat_ws(", ", F.col("name"), F.nullif(trim(F.array_join("_parts", ", ")), F.lit(""))))
    pin = tx.grab(F.concat_ws(" ", "address", "_first"), lx.PIN)
    return d.select(*keys, "role", "name", "address", pin.alias("pin"), pin.isNotNull().alias("has_valid_pin"))


def address_fallback(df: DataFrame) -> DataFrame:
    """Address of a label that names no party at all.

    The first line with an address cue, with its neighbours; a name is never
    invented.  Input rows must be labels without any commercial entity.
    """
    def judged(l: Column) -> Column:
        t = l["text"]
        copy = tx.has(t, lx.MARKETING) | tx.has(t, lx.INGREDIENT) | _in_any(F.lower(t), lx.FORMULATION_WORDS[:-3])
        return F.struct(t.alias("text"), copy.alias("copy"), tx.has(t, lx.CUTOFF).alias("cut"), tx.has(t, lx.ADDRESS_CUES).alias("cue"))

    keys = [c for c in df.columns if c != "lines"]
    d = df.select(*keys, F.transform("lines", judged).alias("_f"))
    lines = F.col("_f")

    def near(i: Column, step: int) -> Column:
        l = F.get(lines, i + step)
        return F.when(~l["cut"] & ~l["copy"], l["text"])

    spots = F.transform(lines, lambda l, i: F.struct(
        (l["cue"] & ~l["copy"]).alias("cue"), F.concat_ws(", ", l["text"], near(i, -1), near(i, 1), near(i, 2)).alias("address")))
    d = d.select(*keys, F.inline(F.slice(F.filter(spots, lambda h: h["cue"]), 1, 1)))
    return d.select(*keys, "address", F.coalesce(tx.grab(F.col("address"), lx.PIN), tx.grab(F.col("text"), lx.PIN)).alias("pin"))


def address_block(df: DataFrame, at: Column, lookahead: int = 4) -> DataFrame:
    """Add ``block``: struct<address,pin> from the lines after position ``at``."""
    ahead = F.slice(F.col("lines"), at + 1, lookahead)
    df = df.withColumn("_b", F.transform(ahead, lambda l: l["text"]))
    end = F.array_position(F.transform("_b", lambda t: tx.has(t, OTHER_PARTY) | tx.has(t, BLOCK_END)), True).cast("int")
    df = df.withColumn("_b", F.when(end > 0, F.slice("_b", 1, F.greatest(end - 1, F.lit(0)))).otherwise(F.col("_b")))
    kept = F.filter("_b", is_place_text)
    address = F.array_join(F.transform(kept, lambda t: tx.strip(F.regexp_replace(t, ADDRESS_PREFIX, ""))), ", ")
    pins = F.filter(F.transform(kept, lambda t: F.regexp_extract(t, lx.PIN, 1)), lambda p: p != "")
    return df.withColumn("block", F.struct(F.nullif(address, F.lit("")).alias("address"), F.get(pins, F.lit(0)).alias("pin"))).drop("_b")


def assembled_entities(df: DataFrame, key: str) -> DataFrame:
    """Role, company and address of every line that names a party.

    The confidence is the mean of the role's and the company's.
    """
    lines = F.col("lines")
    rows = F.transform(lines, lambda l, i: F.struct(
        (i + 1).cast("int").alias("at"), l["text"].alias("line"), F.get(lines, i + 1)["text"].alias("below"), role_of(l["text"]).alias("roles")))
    # A line without role wording is a party by a corporate word only: all others end here.
    rows = F.filter(rows, lambda r: (r["roles"].isNotNull() | tx.has(r["line"], COMPANY)) & ~cl.is_company_noise(r["line"]))
    d = df.select(key, "lines", F.inline(rows))
    stripped = F.col("line")
    for _, p in ROLE_WORDS:
        stripped = F.regexp_replace(stripped, p, "")
    d = d.withColumn("_s", tx.strip(F.regexp_replace(stripped, r"^[\s:\-–—]+", "")))
    d = d.withColumn("_own", company_candidate(F.when(F.col("roles").isNotNull(), F.col("_s")).otherwise(F.col("line"))))
    d = d.withColumn("_below", company_candidate(F.col("below")))
    own_name = F.when(F.col("roles").isNull(), F.when(~is_place_text(F.col("line")), F.col("_own.name"))).when(
        (F.length("_s") >= 3) & ~F.col("_own.garbage"), F.coalesce(F.col("_own.name"), F.col("_s")))
    below = F.when(F.col("roles").isNotNull(), F.coalesce(F.col("_below.name"), F.when((F.length("below") >= 3) & ~is_place_text(F.col("below")) & ~F.col("_below.garbage"), F.col("below"))))
    # Names are generated values: a filter on a plain column would be pushed down, with all that the name is made of, and evaluate it twice.
    d = d.withColumn("_name", own_name)
    d = d.select("*", F.explode(F.array(F.coalesce("_name", below))).alias("name")).filter("name is not null")
    lower = F.col("_name").isNull()
    company = F.when(lower, F.col("_below.confidence")).otherwise(F.col("_own.confidence"))
    d = d.withColumn("_conf", F.when(F.coalesce(company, F.lit(0.0)) == 0, 0.90).otherwise(company))
    d = d.withColumn("partial", F.coalesce(cl.is_partial_name(F.when(lower, F.col("below")).otherwise(F.col("_s"))), F.lit(False)))
    d = address_block(d, F.col("at") + F.when(lower, 1).otherwise(0))
    role_conf = F.when(F.col("roles").isNull(), 0.0).otherwise(0.98)
    return d.select(key, "at", F.explode(F.split(F.coalesce("roles", F.lit("OTHER_ORGANIZATION")), ",")).alias("role"), "name",
                    F.col("block.address").alias("address"), F.col("block.pin").alias("pin"), F.round((role_conf + F.col("_conf")) / 2, 2).alias("confidence"), "partial")


def add_missing_roles(entities: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """Parties known only from semantic fields, for roles the lines did not give."""
    named = fields.filter(F.col("semantic_type").isin("MANUFACTURER_NAME", "MARKETER_NAME", "PACKER_NAME", "IMPORTER_NAME"))
    extra = named.select(key, F.replace("semantic_type", F.lit("_NAME"), F.lit("")).alias("role"), F.col("value").alias("name"), "confidence")
    fresh = extra.join(entities.select(key, "role").distinct(), [key, "role"], "left_anti").dropDuplicates([key, "role"])
    return entities.unionByName(fresh, allowMissingColumns=True)


def decompose_address(lines: Column) -> Column:
    """struct<company,street,city,state,pin> from the lines of an address block."""
    full = F.array_join(lines, " ")

    def listed(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(tx.has(full, rf"(?i)\b{n}\b"), F.lit(n)) for n in names])

    first = tx.strip(F.regexp_replace(F.get(lines, F.lit(0)), (
        r"(?i)^(?:manufactured\s*(?:and\s*packaged\s*)?by|mfd\.?\s*by|packed\s*by|pkd\.?\s*by|imported\s*by|marketed\s*by|produced\s*by)[:.\-\s]*"), ""))
    second = tx.strip(F.get(lines, F.lit(1)))
    wrapped = tx.has(second, r"(?i)^(?:Limited|Ltd\.?|LLP|Inc\.?|Corporation)\b")
    rest = F.slice(lines, F.when(wrapped, 3).otherwise(2), F.greatest(F.size(lines), F.lit(0)))
    street = F.array_join(F.filter(F.transform(rest, tx.strip), lambda l: l != ""), ", ")
    return F.struct(F.when(wrapped, F.concat_ws(" ", first, second)).otherwise(first).alias("company"), street.alias("street"),
                    listed(CITIES).alias("city"), listed(STATES).alias("state"), tx.grab(full, lx.PIN).alias("pin"))


def identifiers(df: DataFrame) -> DataFrame:
    """Add the identifier columns; the first line that has one wins."""
    for name, pattern in IDENTIFIERS.items():
        df = df.withColumn(name, tx.first_line_match(F.col("lines"), pattern))
    words = F.split(F.lower(F.btrim(F.regexp_replace(tx.first_line_match(F.col("lines"), ORIGIN_LINE), r"[,.;].*$", ""))), r"\s+")
    df = df.withColumn("_c", words)
    one, two = F.get("_c", F.lit(0)), F.concat_ws(" ", F.get("_c", F.lit(0)), F.get("_c", F.lit(1)))
    whole = F.array_join("_c", " ")
    country = F.when(two.isin(*COUNTRIES), F.initcap(two)).when(one.isin(*COUNTRIES), F.initcap(one)).when(whole.rlike("^[a-z]{3,}$"), F.initcap(whole))
    return df.withColumn("origin", country).drop("_c")


def brand_product_variant(df: DataFrame, panel: Column) -> DataFrame:
    """Add ``brand``, ``product``, ``variant`` from the first two title lines."""
    skip = lambda t: (tx.has(t, DECLARATION_LINE) | tx.has(t, COMPANY_SUFFIX) | is_place_text(t) | tx.has(t, r"(?i)^(?:₹|rs\.?|\d+)")
                      | (F.length(t) < 3) | ~t.rlike("[A-Za-z]"))
    df = df.withColumn("_titles", F.filter(F.transform("lines", lambda l: l["text"]), lambda t: ~skip(t)))
    named = F.get(F.filter("_titles", lambda t: tx.has(t, BRAND_PREFIX)), F.lit(0))
    df = df.withColumn("_top", F.filter("_titles", lambda t: ~tx.has(t, BRAND_PREFIX)))
    t1, t2 = F.get("_top", F.lit(0)), F.get("_top", F.lit(1))
    d1, d2 = _in_any(F.lower(t1), DESCRIPTORS), _in_any(F.lower(t2), DESCRIPTORS)
    swap = t2.isNotNull() & d1 & ~d2
    product = F.when(t2.isNotNull(), F.when(swap, t1).otherwise(t2)).when(d1 | ~panel.isin("FRONT", "BACK"), t1)
    status = F.when(t2.isNotNull() | d1, "CONFIRMED").when(product.isNotNull(), "PARTIAL").otherwise("NOT_VISIBLE")
    brand = F.coalesce(tx.blank_to_null(F.regexp_replace(named, BRAND_PREFIX, "")), F.when(t2.isNotNull(), F.when(swap, t2).otherwise(t1)).when(~d1 & (panel == "FRONT"), t1))
    hits = F.filter(F.transform("lines", lambda l: F.coalesce(*[tx.grab(l["text"], p, 0) for p in VARIANTS])), lambda v: v.isNotNull())
    hidden = panel.isin("BACK", "SIDE", "BOTTOM") & (status != "CONFIRMED")
    df = df.withColumn("brand", brand).withColumn("product", F.when(~hidden, product)).withColumn("product_status", F.when(hidden, "NOT_VISIBLE").otherwise(status))
    return df.withColumn("variant", F.get(F.filter(hits, lambda v: F.lower(v) != F.lower(F.coalesce("product", F.lit("")))), F.lit(0))).drop("_titles", "_top")


def identity_status(name_status: Column, brand: Column, entities: Column, garbage: Column) -> Column:
    """Status of a product identity from its name, brand and parties."""
    sure = F.exists(entities, lambda e: e["confidence"] >= 0.75)
    partial = F.exists(entities, lambda e: e["partial"])
    known = sure | (name_status == "CONFIRMED") | brand.isNotNull()
    return (
        F.when(garbage, "NEEDS_REVIEW").when(known & partial & ~sure, "PARTIAL").when(known, "CONFIRMED")
        .when(partial | (name_status == "PARTIAL"), "PARTIAL").when(F.size(entities) == 0, "UNCERTAIN").otherwise("CONFIRMED")
    )
