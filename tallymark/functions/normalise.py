"""OCR clean-up as chains of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import text as tx

Rewrite = tuple[str, str]

# fixed values: rewrites of the token clean-up, in order
TOKEN_REWRITES: list[Rewrite] = [
    (r"(?i)\bM8P\b", "MRP"),
    (r"(?i)\bNRP\b", "MRP"),
    (r"(?i)\bM\.?R\.?P\.?\b", "MRP"),
    (r"\b(?:Rs|RS)\s*[.:\-]?\s*", "Rs. "),
    (r"₹\s*", "₹ "),
    (r"(?i)[1iI]nc[l1I](?:\.|\b)\s*(?:of)?\s*(?:al[l1I]\s*)?taxes", "inclusive of all taxes"),
    (r"(?i)incl(?:\.|\b)\s*(?:of)?\s*al[l1]\s*taxes", "inclusive of all taxes"),
    (r"(?i)inc[l1]\.?\s*taxes", "incl. of all taxes"),
    (r"सभी\s*करों\s*सहित", "inclusive of all taxes"),
    (r"(?i)(\d)\s*(?:gms|gm)\b", "$1 g"),
    (r"(?i)(\d)\s*(?:kgs)\b", "$1 kg"),
    (r"(\d)\s*m[1liI|]\b", "$1 ml"),
    (r"(?i)(\d)\s*(?:ltrs|ltr)\b", "$1 l"),
    (r"(?i)\bnel\s*qty\b", "Net Qty"),
    (r"(?i)\bnct\s*wt\b", "Net Wt"),
    (r"(?i)\bnet\s*w[tl][.:;]?\s*", "Net Wt: "),
    (r"(?i)\bmfg\s*[.:\-]?\s*(?:date|on)?\b", "Mfg Date: "),
    (r"(?i)\bmfd\s*[.:\-]?\s*(?:date|on)?\b", "Mfd Date: "),
    (r"(?i)\bpkd\s*[.:\-]?\s*(?:date|on)?\b", "Packed Date: "),
    (r"(?i)\bexp\s*[.:\-]?\s*(?:date|on)?\b", "Expiry Date: "),
    (r"(?i)\bb\.?\s*no\b", "Batch No"),
    (r"\s+([,.:;])", "$1"),
    (r"\s{2,}", " "),
]
UNIT_REWRITES: list[Rewrite] = [
    (r"([0-9])OO([0-9a-zA-Z])", "$100$2"),
    (r"([0-9])O([0-9a-zA-Z])", "$10$2"),
    (r"(\d+)\s*9\b", "$1g"),
    (r"(\d+)\s*m1\b", "$1ml"),
]
HEADER_REWRITES: list[Rewrite] = [
    (r"(?i)\bnel\s*qty\b", "Net Qty"),
    (r"(?i)\bnct\s*wt\b", "Net Wt"),
    (r"(?i)\bnet\s*w[tl][.:;]?\s*", "Net Wt: "),
    (r"(?i)\bnet\s*quantity[.:;]?\s*", "Net Quantity: "),
    (r"(?i)\bmfg\s*[.:\-]?\s*(?:date|on)?\b", "Mfg Date: "),
    (r"(?i)\bmfd\s*[.:\-]?\s*(?:date|on)?\b", "Mfd Date: "),
    (r"(?i)\bpkd\s*[.:\-]?\s*(?:date|on)?\b", "Packed Date: "),
    (r"(?i)\bexp\s*[.:\-]?\s*(?:date|on)?\b", "Expiry Date: "),
    (r"(?i)\bb\.?\s*no[.:\-]?\s*", "Batch No: "),
    (r"\s+([,.:;])", "$1"),
    (r"\s{2,}", " "),
]
CURRENCY_REWRITES: list[Rewrite] = [
    (r"(?i)\bM8P\b", "MRP"),
    (r"(?i)\bNRP\b", "MRP"),
    (r"(?i)\bM\.?R\.?P\.?\b", "MRP"),
    (r"₹\s*", "₹"),
    (r"\b(?:Rs|RS)\s*[.:\-]?\s*", "Rs. "),
]
QUANTITY_TYPOS: list[Rewrite] = [
    (r"(?i)\bnel\s*qty\b", "net qty"),
    (r"(?i)\bnet\s*oty\b", "net qty"),
    (r"(?i)\bnet\s*qly\b", "net qty"),
    (r"(?i)\bnel\s*wt\b", "net wt"),
    (r"(?i)\bnct\s*wt\b", "net wt"),
    (r"(?i)\bnct\s*qty\b", "net qty"),
    (r"(?i)\bnet\s*w[tl][.:;]?\s*", "net wt: "),
    (r"(?i)\bnet\s*(?:wt\.?|weight|qty\.?|quantity|vol\.?|volume|content|contents)?[:.\-\s]+(\d+(?:\.\d+)?)\s+(?:9|q)\b", "net qty: $1 g"),
    (r"(?i)\bnet\s*(?:wt\.?|weight|qty\.?|quantity|vol\.?|volume|content|contents)?[:.\-\s]+(\d+(?:\.\d+)?)\s*m[1liI|]\b", "net qty: $1 ml"),
]
DEVANAGARI, ARABIC = "०१२३४५६७८९", "0123456789"
PRICE_RUN = r"(?:₹\s*|[Rr][Ss]\.\s*)[0-9OoIlS\s.]+"
UNIT_RUN = r"(?i)[0-9OoIl]+\s*(?:m1|ml|gms|gm|g|kgs|kg|ltrs|ltr|l)\b"
DATE_RUN = r"\b[0-9OoIl]{1,2}[/\-.][0-9OoIl]{2,4}\b"
PIN_RUN = r"\b[1-9][0-9OoIl]{5}\b"
UNIT_TAIL = r"(?i)\s*(m1|ml|gms|gm|g|kgs|kg|ltrs|ltr|l)$"


def rewrite(col: Column, steps: list[Rewrite]) -> Column:
    out = col
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def clean_token(col: Column, mode: str | None = None) -> Column:
    """Token clean-up; ``mode`` is ``number``, ``unit``, ``date`` or None."""
    t = tx.strip(col)
    if mode == "number":
        return F.translate(t, "OoIl|SsB", "00111558")
    if mode == "unit":
        return rewrite(t, UNIT_REWRITES)
    if mode == "date":
        return F.translate(t, "Oo", "00")
    return rewrite(t, TOKEN_REWRITES)


def replace_matches(col: Column, pattern: str, fix: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``fix(match)``.

    The text between the matches comes from splitting on the same pattern, so
    the pieces and the rewritten matches interleave without a Python worker.
    """
    def rebuild(t: Column) -> Column:
        fixed = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), fix)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), fixed, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return tx.let(col, rebuild)


def _digits(col: Column, extra: bool = False) -> Column:
    return F.translate(col, "OoIlS", "00115") if extra else F.translate(col, "OoIl", "0011")


def _fix_price(m: Column) -> Column:
    lead = F.regexp_extract(m, r"^(₹\s*|[Rr][Ss]\.\s*)", 1)
    return F.concat(lead, _digits(F.substring(m, F.length(lead) + 1, F.length(m)), extra=True))


def _fix_letters(m: Column) -> Column:
    return _digits(m)


def _fix_unit(m: Column) -> Column:
    unit = F.lower(F.regexp_extract(m, UNIT_TAIL, 1))
    number = _digits(F.regexp_replace(m, UNIT_TAIL, ""))
    symbol = (
        F.when(unit.isin("m1", "ml"), "ml").when(unit.isin("g", "gm", "gms"), "g")
        .when(unit.isin("kg", "kgs"), "kg").otherwise("L")
    )
    return F.concat(number, F.lit(" "), symbol)


def contextual(col: Column) -> Column:
    """Context-aware normaliser: digits are repaired only where a number must stand."""
    t = F.translate(tx.strip(col), DEVANAGARI, ARABIC)
    t = rewrite(t, CURRENCY_REWRITES)
    t = replace_matches(t, PRICE_RUN, _fix_price)
    t = replace_matches(t, UNIT_RUN, _fix_unit)
    t = replace_matches(t, DATE_RUN, _fix_letters)
    t = replace_matches(t, PIN_RUN, _fix_letters)
    return tx.strip(rewrite(t, HEADER_REWRITES))


def quantity_typos(col: Column) -> Column:
    return rewrite(col, QUANTITY_TYPOS)


# fixed values: letter confusions inside prices, keyword variants
PRICE_DIGITS: list[Rewrite] = [
    (r"(\d)[Oo]", "$10"),
    (r"[Oo](\d)", "0$1"),
    (r"(\d)[Bb](\d)", "$18$2"),
    (r"(\d)[Ss]\b", "$15"),
    (r"(\d)[Il]", "$11"),
    (r"[Il](\d)", "1$1"),
]
MRP_KEYWORDS: list[Rewrite] = [
    (r"(?i)\b(?:m8p|nr\s*p|mbp|wrp|m\s*r\s*p)\b", "MRP"),
    (r"(?i)\bm\.r\.p\.?:?", "MRP"),
    (r"(?i)\bmax(?:imum)?\s*retail\s*price\b", "MRP"),
    (r"(?i)\bmax\s*price\b", "MRP"),
    (r"(?i)\bretail\s*price\b", "MRP"),
]
HIGHEST_PRICE = 500000


def price_digits(col: Column) -> Column:
    """Repair letters that were read for digits inside a number."""
    return rewrite(tx.strip(col), PRICE_DIGITS)


def parse_price(col: Column) -> Column:
    """Price above 0 and below the ceiling, else null."""
    number = F.regexp_extract(F.replace(price_digits(col), F.lit(","), F.lit("")), r"^([0-9]+(?:\.[0-9]+)?)", 1)
    value = number.try_cast("double")
    return F.when((value > 0) & (value < HIGHEST_PRICE), value)


def mrp_keyword(col: Column) -> Column:
    return rewrite(col, MRP_KEYWORDS)


def language(col: Column, floor: int = 20) -> Column:
    """Script by character counts: more than ``floor`` letters of a script count."""
    hindi = F.regexp_count(col, F.lit(r"[ऀ-ॿ]"))
    latin = F.regexp_count(col, F.lit(r"[A-Za-z]"))
    return (
        F.when((hindi > floor) & (latin > floor), "Bilingual").when(hindi > floor, "Hindi").otherwise("English")
    )


def strip_role(col: Column) -> Column:
    """Drop the role words in front of a company name."""
    return F.btrim(F.regexp_replace(tx.strip(col), lx.ROLE_PREFIX, ""), F.lit(" :.-"))


def category_name(col: Column) -> Column:
    """Primary category key; synonyms are mapped, anything else is UNKNOWN."""
    key = F.translate(F.upper(tx.strip(col)), " -", "__")
    out = F.lit("UNKNOWN")
    for word, target in lx.CATEGORY_SYNONYMS.items():
        out = F.when(key == word, F.lit(target)).otherwise(out)
    return F.when(key.isin(*lx.PRIMARY_CATEGORIES), key).otherwise(out)


def unit_info(unit: Column) -> Column:
    """struct<symbol,base,factor,prohibited> of a unit alias, null when unknown."""
    key = F.lower(unit)
    table = F.create_map(*[
        item
        for alias, symbol, base, factor, bad in lx.UNITS
        for item in (F.lit(alias), F.struct(F.lit(symbol).alias("symbol"), F.lit(base).alias("base"), F.lit(factor).alias("factor"), F.lit(bad).alias("prohibited")))
    ])
    return F.try_element_at(table, key)
