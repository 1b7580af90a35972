"""Line splitting, normalisation, classification and knowledge-base queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import normalise as nm
from tallymark.functions import text as tx
from tallymark.operators import analytics as an
from tallymark.operators import classify as cl
from tallymark.operators import filters as fl
from tallymark.plans import sqltext as q
from tallymark.plans.labels import SQL_LABELS, SQL_TEXTS, WITH_LABEL_LINES, WITH_TEXT_LINES, labels, sql_lines, texts
from tallymark.operators import vocabulary as vo
from tallymark.plans.registry import query, table
from tallymark.sources import notices as no
from tallymark.sources import transcripts as tr

# Lower-case text whose accented letters count as word characters in every engine.
TEXT_LOW = f"text_low as (select *, {q.fold('lower(text)')} as low from text_src)"

# A short vocabulary for the configurable category models.
VOCABULARY = {
    "FOOD": ["biscuits", "sugar", "masala", "ingredients", "best before"],
    "COSMETIC": ["shampoo", "serum", "skin", "apply", "aqua"],
    "ELECTRONICS": ["mouse", "charger", "usb", "led", "model"],
    "STATIONERY": ["pen", "notebook", "paper"],
    "TEXTILE": ["towel", "cotton fabric", "fabric"],
    "HOUSEHOLD_CLEANING": ["detergent", "cleaner", "acid"],
    "PET_PRODUCT": ["dog food", "cat food"],
}
NAME_WORDS = {"FOOD": ["biscuit", "masala", "sugar"], "PERSONAL_CARE": ["shampoo", "soap"], "ELECTRICAL": ["bulb", "led"], "STATIONERY": ["pen"], "PET_PRODUCT": ["dog food"]}


@query("transcript_lines", "S1", WITH_TEXT_LINES + " select doc_id, line_index, text from lines")
def transcript_lines(spark, d):
    return tr.explode_lines(texts(spark, d), ["doc_id"]).select("doc_id", "line_index", "text")


@query("line_context", "W6", WITH_TEXT_LINES + """
select doc_id, line_index, concat_ws(' | ', prev1, text, next1) as near, length(concat_ws(' | ', prev2, prev1, text, next1, next2)) as wide_length from ctx""")
def line_context(spark, d):
    ln = tr.explode_lines(texts(spark, d), ["doc_id"])
    return ln.select("doc_id", "line_index", tr.context_text(1, 1).alias("near"), F.length(tr.context_text(2, 2)).alias("wide_length"))


@query("surface_lines", "S14 S15", """
with s as (select p_partkey as doc_id, [p_name, p_brand || '?', p_type, 'batch [Unclear]', p_name || ' client'] as t from part),
u as (select doc_id, unnest(t) as text, generate_subscripts(t, 1) as line_index from s)
select doc_id, line_index, text, contains(text, '?') or contains(lower(text), '[unclear]') as is_uncertain,
  case when contains(text, '?') or contains(lower(text), '[unclear]') then 0.55::double else 0.94::double end as confidence from u""")
def surface_lines(spark, d):
    p = table(spark, d, "part")
    surface = lambda name, *ts: F.struct(F.lit(name).alias("surface"), F.array(*ts).alias("text_lines"))
    df = p.select(F.col("p_partkey").alias("doc_id"), F.array(
        surface("Front (PDP)", F.col("p_name"), F.concat("p_brand", F.lit("?"))),
        surface("Back Panel", F.col("p_type"), F.lit("batch [Unclear]"), F.concat("p_name", F.lit(" client")))).alias("surfaces"))
    return tr.surfaces_to_lines(df, ["doc_id"]).select("doc_id", "line_index", "text", "is_uncertain", "confidence")


@query("client_lines", "S15", WITH_LABEL_LINES + """
, n as (select doc_id, max(line_index) as last_index, count(*) as n from lines group by 1)
select doc_id, n + 1 as line_index, 'Extra ' || cast(doc_id as varchar) as text from n union all select doc_id, n + 2, 'Seen' from n""")
def client_lines(spark, d):
    df = labels(spark, d).select("doc_id", tx.line_array(F.col("text")).alias("lines"),
                                 F.array(F.concat(F.lit(" Extra "), F.col("doc_id").cast("string")), F.lit("  "), F.lit("Seen")).alias("extra"))
    out = tr.append_client_lines(df, ["doc_id"], "lines", "extra")
    return out.filter(F.startswith("text", F.lit("Extra ")) | (F.col("text") == "Seen")).select("doc_id", F.col("line_index").cast("bigint").alias("line_index"), "text")


@query("token_cleanup", "N1", WITH_LABEL_LINES + f"""
select doc_id, line_index, {q.rewrite('text', [(a.replace('(?i)', '(?i)'), b) for a, b in nm.TOKEN_REWRITES])} as cleaned,
  translate(text, 'OoIl|SsB', '00111558') as as_number, {q.rewrite('text', nm.UNIT_REWRITES)} as as_unit, translate(text, 'Oo', '00') as as_date from lines""")
def token_cleanup(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"])
    t = F.col("text")
    return ln.select("doc_id", "line_index", nm.clean_token(t).alias("cleaned"), nm.clean_token(t, "number").alias("as_number"),
                     nm.clean_token(t, "unit").alias("as_unit"), nm.clean_token(t, "date").alias("as_date"))


@query("contextual_text", "N2", f"""
with s as (select p_partkey as id, 'M8P Rs 2O9 net ' || cast(p_size as varchar) || 'Ogms on O8/2O' || cast(20 + p_size % 10 as varchar) || ' at 4OO0l' || cast(p_size % 10 as varchar) as raw from part)
select id, 'MRP Rs. 209 net ' || cast(p_size as varchar) || '0 g on 08/20' || cast(20 + p_size % 10 as varchar) || ' at 40001' || cast(p_size % 10 as varchar) as text
from s join part on p_partkey = id""")
def contextual_text(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit("M8P Rs 2O9 net "), F.col("p_size").cast("string"), F.lit("Ogms on O8/2O"), (20 + F.col("p_size") % 10).cast("string"),
                   F.lit(" at 4OO0l"), (F.col("p_size") % 10).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), nm.contextual(raw).alias("text"))


@query("quantity_typos", "N3", WITH_TEXT_LINES + f" select doc_id, line_index, {q.rewrite('text', nm.QUANTITY_TYPOS)} as text from lines where text <> {q.rewrite('text', nm.QUANTITY_TYPOS)}")
def quantity_typos(spark, d):
    ln = tr.explode_lines(texts(spark, d), ["doc_id"])
    return ln.select("doc_id", "line_index", "text", nm.quantity_typos(F.col("text")).alias("fixed")).filter("text <> fixed").select("doc_id", "line_index", F.col("fixed").alias("text"))


@query("price_repair", "N4 N5 N6", f"""
with s as (select p_partkey as id, replace(cast(cast(p_retailprice as decimal(12,2)) as varchar), '0', 'O') as raw, 'M.R.P.: Rs ' || cast(cast(p_retailprice as decimal(12,2)) as varchar) as line from part)
select id, {q.rewrite('raw', nm.PRICE_DIGITS)} as repaired,
  case when try_cast(regexp_extract({q.rewrite('raw', nm.PRICE_DIGITS)}, '^([0-9]+(?:\\.[0-9]+)?)', 1) as double) > 0 then try_cast(regexp_extract({q.rewrite('raw', nm.PRICE_DIGITS)}, '^([0-9]+(?:\\.[0-9]+)?)', 1) as double) end as price,
  {q.rewrite('line', nm.MRP_KEYWORDS)} as keyword from s""")
def price_repair(spark, d):
    p = table(spark, d, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = F.replace(price, F.lit("0"), F.lit("O"))
    return p.select(F.col("p_partkey").alias("id"), nm.price_digits(raw).alias("repaired"), nm.parse_price(raw).alias("price"),
                    nm.mrp_keyword(F.concat(F.lit("M.R.P.: Rs "), price)).alias("keyword"))


@query("unit_conversion", "N7", """
with u(alias, symbol, base, factor, bad) as (values ('g','g','g',1.0,false),('gms','g','g',1.0,true),('kg','kg','g',1000.0,false),('ltr','l','ml',1000.0,true),('ml','ml','ml',1.0,false))
select p_partkey as id, symbol, base, (p_size * factor)::double as amount, bad as prohibited from part
left join u on alias = case p_partkey % 6 when 0 then 'g' when 1 then 'gms' when 2 then 'kg' when 3 then 'ltr' when 4 then 'ml' else 'stone' end""")
def unit_conversion(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("g", "GMS", "kg", "Ltr", "ml", "stone")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    u = nm.unit_info(unit)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), u["symbol"].alias("symbol"), u["base"].alias("base"),
                                          (F.col("p_size") * u["factor"]).alias("amount"), u["prohibited"].alias("prohibited"))


@query("text_language", "N8", f"""
with {SQL_TEXTS} select doc_id, case when len(regexp_extract_all(text, '[\\x{{0900}}-\\x{{097F}}]')) > 20 and len(regexp_extract_all(text, '[A-Za-z]')) > 20 then 'Bilingual'
  when len(regexp_extract_all(text, '[\\x{{0900}}-\\x{{097F}}]')) > 20 then 'Hindi' else 'English' end as language, cast(len(regexp_extract_all(text, '[A-Za-z]')) as bigint) as letters from text_src""")
def text_language(spark, d):
    return texts(spark, d).select("doc_id", nm.language(F.col("text")).alias("language"), F.regexp_count("text", F.lit("[A-Za-z]")).cast("bigint").alias("letters"))


@query("category_names", "N10 P12", """
select p_partkey as id, case p_type when 'ECONOMY' then 'FOOD' when 'STANDARD' then 'HOUSEHOLD_CLEANING' when 'PROMO' then 'PERSONAL_CARE' else 'UNKNOWN' end as category,
  case when p_partkey % 3 = 0 then null else p_brand end as cleaned from part""")
def category_names(spark, d):
    name = F.when(F.col("p_type") == "ECONOMY", " foods").when(F.col("p_type") == "STANDARD", "household cleaning").when(F.col("p_type") == "PROMO", "Personal-Care").otherwise("misc")
    dirty = F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, " NOT_VISIBLE ").otherwise("None")).otherwise(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), nm.category_name(name).alias("category"), fl.clean_sentinel(dirty).alias("cleaned"))


def _class_sql() -> str:
    t, low, before = "text", "lower(text)", "concat_ws(chr(10), prev2, prev1)"
    m = lambda p: q.m(t, p)
    address = f"(not {q.any_contains(low, lx.FORMULATION_WORDS)} and {m(lx.ADDRESS_CUES)} and ({m(lx.PIN)} or {m(lx.ADDRESS_STRONG)}))"
    commodity = q.m(q.fold(low), tx.any_word([w for w, _ in lx.commodity_words()]))
    steps = [
        (f"{m(lx.MARKETING)} or {m(lx.MARKETING_START)}", "MARKETING_CLAIM"), (f"{m(lx.DIRECTIONS_START)} or {m(lx.DIRECTIONS_BODY)}", "DIRECTIONS"),
        (f"{m(lx.INGREDIENTS_START)} or {q.hits(t, lx.INGREDIENT)} >= 2", "INGREDIENTS"),
        (f"len(string_split(text, ',')) >= 3 and len(list_filter(string_split(text, ','), lambda x: {q.m('x', lx.SUBSTANCE)})) > 0", "POSSIBLE_INGREDIENTS"),
        (m(lx.WARNING_START), "WARNING"), (m(lx.MARKETER_START), "MARKETER"), (m(lx.PIN_ONLY), "POSTAL_PIN"),
        (f"{m(lx.MRP_NAMED)} or {m(lx.MRP_CURRENCY)} or {m(lx.MRP_SLASH)}", "MRP"), (m(lx.TAX_PHRASE), "TAX_INCLUSIVE_WORDING"), (m(lx.USP), "UNIT_SALE_PRICE"),
        (f"({m(lx.NET_NAMED)} or {m(lx.NET_BARE)}) and not {m(lx.NUTRITION)}", "NET_QUANTITY"), (m(lx.UNIT_ONLY), "UNIT"), (m(lx.MFD), "MANUFACTURE_DATE"),
        (m(lx.PKD), "PACKING_DATE"), (m(lx.BEST_BEFORE), "BEST_BEFORE"), (m(lx.EXP), "EXPIRY_DATE"), (f"{m(lx.BATCH)} and {m('(?i)' + chr(92) + 'blot' + chr(92) + 'b')}", "LOT_NUMBER"), (m(lx.BATCH), "BATCH_NUMBER"),
        (f"{m(lx.ORIGIN)} or {m(lx.ORIGIN_WORDS)}", "COUNTRY_OF_ORIGIN"), (m(lx.EMAIL), "CONSUMER_CARE_EMAIL"), (f"{m(lx.PHONE)} and {m(lx.CARE_WORDS)}", "CONSUMER_CARE_PHONE"),
        (m(lx.CARE_ADDRESS), "CONSUMER_CARE_ADDRESS"), (m(lx.MANUFACTURER_START), "MANUFACTURER_NAME"), (m(lx.PACKER_START), "PACKER_NAME"), (m(lx.IMPORTER_START), "IMPORTER_NAME"),
        (f"{address} and {q.m(before, '(?i)' + chr(92) + 'b(?:marketed|mktg|distributed)' + chr(92) + 'b')}", "MARKETER_ADDRESS"),
        (f"{address} and {q.m(before, '(?i)' + chr(92) + 'b(?:packed|pkd)' + chr(92) + 'b')}", "PACKER_ADDRESS"),
        (f"{address} and {q.m(before, '(?i)' + chr(92) + 'b(?:imported|importer)' + chr(92) + 'b')}", "IMPORTER_ADDRESS"), (address, "MANUFACTURER_ADDRESS"), (commodity, "GENERIC_NAME"),
        (f"{m(lx.NOISE_TOKENS)} and not {m(lx.NOISE_EXEMPT)} and length(regexp_replace({low}, '[^aeiou]', '', 'g')) <= 1 and length(replace(text, ' ', '')) >= 5", "UNKNOWN"),
    ]
    return "case " + " ".join(f"when {a} then '{b}'" for a, b in steps) + " else 'OTHER_TEXT' end"


@query("line_classes", "C1", WITH_TEXT_LINES + f" select doc_id, line_index, {_class_sql()} as line_class from ctx")
def line_classes(spark, d):
    ln = tr.explode_lines(texts(spark, d), ["doc_id"])
    return ln.select("doc_id", "line_index", cl.line_class(F.col("text"), F.col("prev1"), F.col("prev2"))["name"].alias("line_class"))


def _argmax_sql(scores: list[tuple[str, str]], fallback: str, value: str) -> str:
    """CASE that returns the first name with the greatest of the score expressions."""
    names = [f"s{i}" for i in range(len(scores))]
    top = f"greatest({', '.join(names)})"
    cases = " ".join(f"when {n} = {top} then {q.lit(name)}" for n, (name, _) in zip(names, scores, strict=True))
    return f"case when {top} = 0 then {q.lit(fallback)} {cases} end as name, case when {top} = 0 then {value}::double else {top} end as score"


_DECL = [(c, f"case when {' + '.join(q.m('lower(text)', p) + '::int' for p in cues)} > 0 then round(least(0.95::double, 0.6::double + ({' + '.join(q.m('lower(text)', p) + '::int' for p in cues)}) * 0.15::double), 2) else 0.0::double end")
         for c, cues in lx.DECLARATION_CUES.items()]


@query("declaration_classes", "C2", WITH_TEXT_LINES + f"""
, s as (select doc_id, line_index, {', '.join(f'{e} as s{i}' for i, (_, e) in enumerate(_DECL))} from lines)
select doc_id, line_index, {_argmax_sql(_DECL, 'OTHER', '0.3')} from s""")
def declaration_classes(spark, d):
    ln = tr.explode_lines(texts(spark, d), ["doc_id"])
    v = ln.select("doc_id", "line_index", cl.declaration_class(F.col("text")).alias("v"))
    return v.select("doc_id", "line_index", F.col("v.name").alias("name"), F.col("v.score").alias("score"))


_DOMAIN = [(c, f"case when {q.words('low', ws)} > 0 then round(least(0.98::double, 0.65::double + {q.words('low', ws)} * 0.1::double), 2) else 0.0::double end") for c, ws in lx.DOMAIN_WORDS.items()]


@query("product_domains", "C3", f"""
with {SQL_TEXTS}, {TEXT_LOW}, s as (select doc_id, {', '.join(f'{e} as s{i}' for i, (_, e) in enumerate(_DOMAIN))} from text_low)
select doc_id, {_argmax_sql(_DOMAIN, 'General Packaged Commodity', '0.7')} from s""")
def product_domains(spark, d):
    v = cl.with_grams(texts(spark, d)).select("doc_id", cl.product_domain(F.col("grams")).alias("v"))
    return v.select("doc_id", F.col("v.name").alias("name"), F.col("v.score").alias("score"))


_SORTED = sorted(lx.commodity_words(), key=lambda p: -len(p[0]))
_FOREIGN = f"len(list_filter(regexp_extract_all(lower(text), {q.lit(lx.IMPORT_ORIGIN)}, 1), lambda x: not starts_with(x, 'india'))) > 0"
_LETTER_SQL = ("case " + " ".join(f"when {q.m('low', chr(92) + 'b' + w + chr(92) + 'b')} then '{c}'" for w, c in _SORTED)
               + f" when {q.m('lower(text)', lx.IMPORT_DECLARED)} or {_FOREIGN} then 'P' "
               + " ".join(f"when {q.m('lower(text)', p)} then '{c}'" for c, _, p in lx.CATEGORY_CONTEXT) + " else 'R' end")
_GENERIC_SQL = "case " + " ".join(f"when {q.m('low', chr(92) + 'b' + w + chr(92) + 'b')} then {q.lit(name)}" for w, name in lx.commodity_names().items()) + " end"


@query("category_letters", "C4", f"with {SQL_TEXTS}, {TEXT_LOW} select doc_id, {_LETTER_SQL} as code, {_GENERIC_SQL} as generic_name from text_low")
def category_letters(spark, d):
    t = cl.with_grams(texts(spark, d))
    return t.select("doc_id", cl.category_letter(F.col("text"), F.col("grams"))["code"].alias("code"), cl.generic_name(F.col("grams")).alias("generic_name"))


def _signal_n(ws):
    return q.words("low", ws)


_SIG = [(c, f"case when {_signal_n(ws)} > 0 then round(least(0.98::double, {_signal_n(ws)} / ({_signal_n(ws)} + 2)::double), 2) else 0.0::double end") for c, ws in lx.SIGNAL_WORDS.items()]


@query("category_signals", "C5", f"""
with {SQL_TEXTS}, {TEXT_LOW}, s as (select doc_id, text, low, {', '.join(f'{e} as s{i}' for i, (_, e) in enumerate(_SIG))} from text_low),
n as (select *, {', '.join(f'{_signal_n(ws)} as n{i}' for i, ws in enumerate(lx.SIGNAL_WORDS.values()))} from s)
{' union all '.join(f"select doc_id, '{c}' as category, s{i} as confidence, cast(1 + {' + '.join(f'(n{j} > n{i} or (n{j} = n{i} and {j} < {i}))::int' for j in range(len(_SIG)))} as int) as rank from n where n{i} > 0" for i, (c, _) in enumerate(_SIG))}""")
def category_signals(spark, d):
    v = cl.with_grams(texts(spark, d)).select("doc_id", F.posexplode(cl.category_signals(F.col("grams"))).alias("p", "c"))
    return v.select("doc_id", F.col("c.category").alias("category"), F.col("c.confidence").alias("confidence"), (F.col("p") + 1).alias("rank"))


_FUSED = []
for _c in dict.fromkeys([*lx.SIGNAL_WORDS, *NAME_WORDS]):
    _own = dict(_SIG).get(_c, "0.0::double")
    _add = "".join(f" + contains(lower(title), {q.lit(w)})::int * 1.2::double + contains(lower(text), {q.lit(w)})::int * 0.4::double" for w in NAME_WORDS.get(_c, ()))
    _FUSED.append((_c, f"({_own}) * 1.5::double{_add}"))


@query("fused_categories", "C6", f"""
with {SQL_LABELS}, t as (select doc_id, text, lower(text) as low, string_split(text, chr(10))[1] as title from label_src),
s as (select doc_id, {', '.join(f'{e} as s{i}' for i, (_, e) in enumerate(_FUSED))} from t), v as (select doc_id, {_argmax_sql(_FUSED, 'UNKNOWN', '0.0')} from s)
select doc_id, case when score / (score + 1) >= 0.4 then name else 'UNKNOWN' end as category, round(least(0.98::double, score / (score + 1)), 2) as confidence from v""")
def fused_categories(spark, d):
    t = cl.with_grams(labels(spark, d)).select("doc_id", "text", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), cl.category_signals(F.col("grams")).alias("signals"))
    top = t.select("doc_id", cl.fused_category(F.col("signals"), F.col("title"), F.col("text"), NAME_WORDS).alias("top"))
    v = top.select("doc_id", cl.fused_verdict(F.col("top")).alias("v"))
    return v.select("doc_id", "v.category", "v.confidence")


_GATED = []
for _c in [*VOCABULARY, "IMPORTED_PRODUCT"]:
    _parts = [f"least(0.4::double, {q.hits('low', chr(92) + 'b' + w + chr(92) + 'b')} * {0.15 if len(w) > 3 else 0.08}::double)" for w in VOCABULARY.get(_c, ())]
    if _c == "IMPORTED_PRODUCT":
        _parts.append(f"case when {q.any_contains('lower(text)', ('imported by', 'importer', 'country of origin', 'made in', 'product of'))} then 0.3::double else 0.0::double end")
    _GATED.append((_c, " + ".join(["0.0::double", *_parts])))


@query("gated_categories", "C7", f"""
with {SQL_TEXTS}, {TEXT_LOW}, s as ({' union all '.join(f"select doc_id, '{c}' as category, {i} as ord, {e} as s from text_low" for i, (c, e) in enumerate(_GATED))}),
k as (select doc_id, category, round(least(0.99::double, s), 2) as c, row_number() over (partition by doc_id order by round(least(0.99::double, s), 2) desc, ord) as r from s where s >= 0.15),
t as (select doc_id, max(c) filter (r = 1) as c1, max(category) filter (r = 1) as k1, max(c) filter (r = 2) as c2, max(category) filter (r = 2) as k2 from k group by 1)
select x.doc_id, case when c1 is null or (round(c1 - c2, 2) < 0.12 and c1 < 0.7) or c1 < 0.35 then 'UNKNOWN' else k1 end as category, coalesce(c1, 0.0::double) as confidence,
  case when c1 >= 0.55 and not coalesce(round(c1 - c2, 2) < 0.12 and c1 < 0.7, false) then 'CONFIRMED' else 'NEEDS_REVIEW' end as status, k2 as runner_up
from text_src x left join t using (doc_id)""")
def gated_categories(spark, d):
    return cl.gated_category(texts(spark, d), "text", VOCABULARY).select("doc_id", "gate.*")


# Words of parts, and countries of regions, as a vocabulary; the words of a part also tell its brand.
_VOCABULARY = """select p_type as category, 'keyword' as kind, null as subcategory, p_name as phrase from part where p_partkey % 3 = 0
union all select p_type, 'keyword', null, split_part(p_name, ' ', 1) from part where p_partkey % 7 = 0
union all select r_name, 'keyword', null, n_name from nation join region on n_regionkey = r_regionkey
union all select 'PARTIES', 'keyword', null, p from (values ('mfd by'), ('pvt ltd'), ('net'), ('a')) as v(p)
union all select p_type, 'sub', p_brand, split_part(p_name, ' ', 2) from part where p_partkey % 5 = 0"""


@query("vocabulary_categories", "C7 C6 N10", f"""
with {SQL_TEXTS}, {TEXT_LOW}, voc as ({_VOCABULARY}), kw as (select distinct category, lower(phrase) as phrase from voc where kind = 'keyword'),
ph as (select distinct phrase from kw), h as (select doc_id, phrase, len(regexp_extract_all(low, '\\b' || phrase || '\\b')) as hits from text_low, ph where contains(low, phrase)),
pts as (select doc_id, category, least(40, hits * case when length(kw.phrase) > 3 then 15 else 8 end) as points from h join kw on kw.phrase = h.phrase where hits > 0
  union all select doc_id, 'IMPORTED_PRODUCT', 30 from text_src where {q.any_contains('lower(text)', vo.IMPORT_WORDS)}),
sc as (select doc_id, category, least(99, sum(points)) as score from pts group by 1, 2 having sum(points) >= 15),
rk as (select *, row_number() over (partition by doc_id order by score desc, category) as r from sc),
t as (select doc_id, max(category) filter (r = 1) as k1, max(score) filter (r = 1) as c1, max(category) filter (r = 2) as k2, max(score) filter (r = 2) as c2 from rk group by 1),
sub as (select t.doc_id, min(voc.subcategory) as s from t join text_src x on x.doc_id = t.doc_id join voc on voc.kind = 'sub' and voc.category = t.k1 where contains(lower(x.text), lower(voc.phrase)) group by 1),
g as (select x.doc_id, k1, k2, s, coalesce(c1, 0) as c1, coalesce(c1 - c2 < 12 and c1 < 70, false) as close from text_src x left join t using (doc_id) left join sub using (doc_id))
select doc_id, case when close or c1 < 35 then 'UNKNOWN' else k1 end as category, case when close or c1 >= 35 then s end as subcategory, c1::double / 100 as confidence,
  case when not close and c1 >= 55 then 'CONFIRMED' else 'NEEDS_REVIEW' end as status, k2 as runner_up from g""")
def vocabulary_categories(spark, d):
    for name in ("part", "nation", "region"):
        table(spark, d, name).createOrReplaceTempView(f"_vocabulary_{name}")
    sql = _VOCABULARY
    for name in ("part", "nation", "region"):
        sql = sql.replace(f"from {name}", f"from _vocabulary_{name} {name}").replace(f"join {name}", f"join _vocabulary_{name} {name}")
    return vo.vocabulary_categories(texts(spark, d), spark.sql(sql), "doc_id")


_TYPES = "case " + " ".join(f"when {q.m('low', p)} then '{n}'" for n, _, p in cl.PRODUCT_TYPES)
_SPOILS = "case " + " ".join(f"when {q.m('low', p)} then {str(s).lower()}" for _, s, p in cl.PRODUCT_TYPES) + " else false end"


@query("product_attributes", "C8", f"""
with {SQL_LABELS}, t as (select doc_id, lower(p_brand || ' ' || text) as low, cast(p_size as varchar) || case when p_size % 2 = 0 then ' ml' else ' g' end as net,
  case when p_size % 7 = 0 then 'China' else 'India' end as origin, case when p_size % 3 = 0 then cast(p_size as varchar) || ' x 2.5 cm' else '' end as dims, p_size from label_src)
select doc_id, {_TYPES} when {q.m('net', cl.LIQUID_UNIT)} or {q.m('low', cl.LIQUID_WORD)} then 'Liquid product' else 'Weight-based commodity' end as product_type,
  origin <> 'India' or {q.m('low', 'imported' + chr(92) + 's*by')} or {q.m('low', 'country of origin: (?:[a-hj-z]|i[a-mo-z])')} as is_imported, {q.m('low', cl.MULTIPACK)} as is_multipack,
  {q.m('net', cl.LIQUID_UNIT)} or {q.m('low', cl.LIQUID_WORD)} as is_liquid, {_SPOILS} as is_perishable,
  {q.m('low', cl.PRODUCT_TYPES[0][2])} and {q.m('low', cl.SCHEDULED)} as is_scheduled, case when p_size % 3 = 0 then p_size * 2.5::double else 120.0::double end as pdp_area_cm2 from t""")
def product_attributes(spark, d):
    t = labels(spark, d, "p_size", "p_brand")
    net = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " ml").otherwise(" g"))
    v = t.select("doc_id", cl.product_attributes(
        F.col("p_brand"), net, F.when(F.col("p_size") % 7 == 0, "China").otherwise("India"), F.lit(""),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" x 2.5 cm"))).otherwise(""), F.col("text")).alias("v"))
    return v.select("doc_id", "v.*")


_BACK = " + ".join(f"contains(lower(text), {q.lit(w)})::int" for w in cl.BACK_SIGNALS)


@query("panels", "C9", f"""
with {SQL_TEXTS} select doc_id, case when {_BACK} >= 2 then 'BACK' when contains(lower(text), 'imported by') and {q.any_contains('lower(text)', ('model', 'country of origin'))} then 'SIDE'
  when {q.any_contains('lower(text)', ('deluxe', 'serum', 'tea', 'biscuit', 'shampoo'))} then 'FRONT' else 'UNKNOWN' end as from_text,
  case when doc_id like '%7' then 'Back Panel' when doc_id like '%8' then 'Coding Area' when len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) <= 6 and {q.any_contains('lower(text)', ('b.no', 'mrp', 'mfd'))} and not contains(lower(text), 'manufactured by') then 'Coding Area'
    when {q.any_contains('lower(text)', ('ingredient', 'manufactured by', 'directions'))} then 'Back Panel' else 'Front (PDP)' end as from_hint from text_src""")
def panels(spark, d):
    t = texts(spark, d)
    hint = F.when(F.endswith("doc_id", F.lit("7")), "BACK side").when(F.endswith("doc_id", F.lit("8")), "crimp").otherwise("")
    return t.select("doc_id", cl.panel_from_text(F.col("text")).alias("from_text"),
                    cl.panel_from_hint(hint, F.col("text"), F.size(tx.line_array(F.col("text")))).alias("from_hint"))


def _audit_sql() -> str:
    out = []
    for rule, _, status, p in cl.AUDIT_STEPS:
        test = q.m("text", p)
        if rule == "QUANTITY":
            out += [(f"{test} and {q.m('text', '(?i)when' + chr(92) + 's*packed')}", "Non-Compliant"), (f"{test} and {q.m('text', '(?i)' + chr(92) + 'b(?:gms|kgs|mls|dozen|gross|lbs|oz)' + chr(92) + 'b')}", "Non-Compliant")]
        if rule == "PARTY":
            out.append((f"{test} and not {q.m('text', lx.PIN)} and {q.m('text', '(?i)address|road|street|nagar|plot|phase|industrial')}", "Non-Compliant"))
        out.append((test, status))
    out.append((f"position <= 3 and length(text) > 3 and not {q.m('text', '(?i)lic|fssai|regd|tm' + chr(92) + 'b')}", "Compliant"))
    return "case " + " ".join(f"when {a} then '{b}'" for a, b in out) + " else 'Informational' end"


@query("line_audit", "C10", WITH_TEXT_LINES + f" select doc_id, line_index, {_audit_sql()} as status from ctx")
def line_audit(spark, d):
    ln = tr.explode_lines(texts(spark, d), ["doc_id"])
    return ln.select("doc_id", "line_index", cl.audit_line(F.col("text"), F.col("position"))["status"].alias("status"))


@query("meaning_tiebreak", "C12 C13", WITH_LABEL_LINES + f"""
, t as (select doc_id, line_index, lower(concat_ws(' | ', prev1, text, next1)) as low, doc_id % 2 = 0 as may_net from ctx)
select doc_id, line_index, case when {q.any_contains('low', ('serving', 'nutrition', 'per 100', 'portion'))} then 'SERVING_SIZE'
  when may_net and {q.any_contains('low', ('net', 'weight', 'qty', 'volume', 'mass'))} then 'NET_QUANTITY' else 'UNKNOWN' end as meaning,
  case doc_id % 3 when 0 then 0.95::double when 1 then 0.05::double else 0.5::double end as relevance from t""")
def meaning_tiebreak(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"])
    may = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("SERVING_SIZE"), F.lit("NET_QUANTITY"))).otherwise(F.array(F.lit("SERVING_SIZE")))
    letter = F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "F").otherwise("Z")
    return ln.select("doc_id", "line_index", cl.resolve_meaning(tr.context_text(1, 1), may)["meaning"].alias("meaning"),
                     cl.field_relevance(letter, F.lit("ingredients")).alias("relevance"))


@query("noise_lines", "P13 P14", WITH_TEXT_LINES + r"""
, t as (select doc_id, line_index, text, length(regexp_replace(text, '[^\p{L}\p{N}₹]', '', 'g')) as a, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as b,
  list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w, regexp_replace(lower(text), '[^\p{L}]', '', 'g') as l from lines)
select doc_id, line_index, (length(text) = 1 and not regexp_matches(text, '[\p{L}\p{N}₹$€]')) or (length(text) > 6 and (length(text) - a) / length(text)::double > 0.65)
    or regexp_matches(text, '^[\-_=.~|/\\:;,''"`!@#$%^&*()+\[\]{} ]+$') as is_noise,
  (length(text) >= 3 and b / length(text)::double < 0.5) or (len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]\d|\d[A-Za-z]') and not regexp_matches(x, '(?i)^\d+(?:g|kg|ml|l|cm|m|mm|mg|n)$'))) as mx >= 1
     and (mx >= len(w) / 2.0::double or len(list_filter(w, lambda x: length(x) <= 4)) > 0)) or (len(w) >= 3 and len(list_filter(w, lambda x: length(x) > 3)) = 0)
     or (length(l) >= 4 and not regexp_matches(l, '[aeiou]')) as is_garbled,
  starts_with(text, '..') or starts_with(text, '…') as is_partial from t""".replace("len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]\\d|\\d[A-Za-z]') and not regexp_matches(x, '(?i)^\\d+(?:g|kg|ml|l|cm|m|mm|mg|n)$'))) as mx >= 1",
     "len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]\\d|\\d[A-Za-z]') and not regexp_matches(x, '(?i)^\\d+(?:g|kg|ml|l|cm|m|mm|mg|n)$'))) >= 1").replace("(mx >=", "(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]\\d|\\d[A-Za-z]') and not regexp_matches(x, '(?i)^\\d+(?:g|kg|ml|l|cm|m|mm|mg|n)$'))) >="))
def noise_lines(spark, d):
    ln = tr.explode_lines(texts(spark, d), ["doc_id"])
    t = F.col("text")
    return ln.select("doc_id", "line_index", cl.is_noise(t).alias("is_noise"), cl.is_garbled(t).alias("is_garbled"), cl.is_partial_name(t).alias("is_partial"))


@query("role_prefixes", "N9", WITH_LABEL_LINES + f"""
select doc_id, line_index, trim(regexp_replace(text, {q.lit(lx.ROLE_PREFIX)}, ''), ' :.-') as party from lines where {q.m('text', lx.ROLE_PREFIX)}""")
def role_prefixes(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"])
    return ln.filter(tx.has(F.col("text"), lx.ROLE_PREFIX)).select("doc_id", "line_index", nm.strip_role(F.col("text")).alias("party"))


@query("line_viewer", "P16", WITH_LABEL_LINES + " select doc_id, line_index, text from lines where contains(lower(text), 'date') and doc_id % 2 = 0")
def line_viewer(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"]).withColumn("surface", F.when(F.col("doc_id") % 2 == 0, "Front (PDP)").otherwise("Back Panel"))
    return fl.line_viewer(ln, "DATE", "Front (PDP)").select("doc_id", "line_index", "text")


_TAGS = "concat_ws(', ', " + ", ".join(f"case when {q.m('t', p)} then {q.lit(n)} end" for n, p in lx.NOTICE_TAGS.items()) + ")"
SQL_KB = f"""
par as (select doc_id, source, generate_subscripts(x, 1) - 1 as paragraph, unnest(x) as raw from (select doc_id, source, regexp_split_to_array(regexp_replace(text, '\\n([0-9]+\\.\\s)', chr(10) || chr(10) || '\\1', 'g'), '\\n\\s*\\n') as x from documents)),
p2 as (select *, {q.strip("regexp_replace(raw, '" + chr(92) + "s+', ' ', 'g')")} as t from par),
kb as (select doc_id, source, paragraph, t,
  coalesce('Rule ' || {q.g('t', no.RULE_MENTION)}, {q.g('t', no.SCHEDULE_MENTION)} || ' Schedule', 'Legal Metrology Rules General') as rule_number,
  coalesce('Sub-rule (' || {q.g('t', no.SUBRULE_MENTION)} || ')', 'Clause (' || {q.g('t', no.CLAUSE_MENTION)} || ')', 'General') as sub_rule_or_clause,
  coalesce(nullif({_TAGS}, ''), 'General Packaged Commodities') as product_category, coalesce({q.g('t', no.LOCAL_DATE)}, 'As per notification') as effective_date,
  {q.g('t', no.RULE_MENTION)} is not null or {q.g('t', no.SCHEDULE_MENTION)} is not null or {_TAGS} <> '' or contains(lower(t), 'amendment') as relevant from p2 where length(t) >= 30)"""


@query("knowledge_entries", "S3 C11", f"with {SQL_KB} select doc_id, paragraph, rule_number, sub_rule_or_clause, product_category, effective_date from kb where relevant")
def knowledge_entries(spark, d):
    kb = no.knowledge_entries(table(spark, d, "documents"), ["doc_id"])
    return kb.select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), "rule_number", "sub_rule_or_clause", "product_category", "effective_date")


@query("knowledge_search", "P7 S4", f"""
with {SQL_KB}, a as (select doc_id, source, 0 as paragraph, text as t, coalesce('Rule ' || {q.g('text', '[Rr]ule' + chr(92) + 's*([0-9]{1,2})')}, 'Legal Metrology Advisory / Guidelines') as rule_number,
 coalesce(nullif({_TAGS.replace('(t,', '(text,')}, ''), 'General Packaged Commodities') as product_category from documents)
select product_category, count(*) as n from (select product_category, rule_number, t, sub_rule_or_clause from kb where relevant union all select product_category, rule_number, t, 'Advisory / Direction / SOP' from a)
where contains(lower(rule_number || ' ' || sub_rule_or_clause || ' ' || t || ' ' || product_category), 'license') group by 1""")
def knowledge_search(spark, d):
    docs = table(spark, d, "documents")
    merged = no.merge_knowledge(no.knowledge_entries(docs, ["doc_id"]), no.advisory_entries(docs, ["doc_id"]))
    return no.search_text(merged, " License ").groupBy("product_category").agg(F.count(F.lit(1)).alias("n"))


@query("knowledge_statistics", "A15", f"""
with {SQL_KB} select count(*) as total_entries, count(*) filter (rule_number like 'Rule%') as with_rule_number, count(*) as with_category, count(*) as with_date, cast(count(distinct source) as bigint) as sources from kb where relevant""")
def knowledge_statistics(spark, d):
    kb = no.knowledge_entries(table(spark, d, "documents"), ["doc_id"]).withColumn("rule_number", F.when(F.startswith("rule_number", F.lit("Rule")), F.col("rule_number")))
    return an.kb_statistics(kb)


_RULE_NO = "case p_partkey % 4 when 0 then 'OIL & F' when 1 then ' farm PRODUCE' when 2 then 'rule' end"
_SUB_RULE = "case p_partkey % 3 when 0 then 'gen' when 1 then p_brand else '(a)' end"


@query("rule_citations", "J22", f"""
with {SQL_KB}, ids as (select doc_id, paragraph, 'KB-' || substr(sha256(cast(doc_id as varchar) || ':' || cast(paragraph as varchar)), 1, 12) as id, lower(product_category) as c, lower(sub_rule_or_clause) as s, source from kb where relevant),
asked as (select distinct lower(trim({_RULE_NO})) as k from part union select distinct lower(trim({_SUB_RULE})) from part),
f as (select k, arg_min(id, doc_id * 1000000 + paragraph) as id, arg_min(source, doc_id * 1000000 + paragraph) as source from asked join ids on contains(c, k) or contains(s, k) group by k)
select p_partkey, coalesce(a.id, b.id) as citation_id, coalesce(a.source, b.source, 'Legal Metrology (Packaged Commodities) Rules, 2011') as citation_source
from part left join f a on a.k = lower(trim({_RULE_NO})) left join f b on b.k = lower(trim({_SUB_RULE}))""")
def rule_citations(spark, d):
    """The driver's documents name products, hardly any rule, so their product tags stand for rule numbers."""
    kb = no.knowledge_entries(table(spark, d, "documents"), ["doc_id"]).withColumn("rule_number", F.col("product_category"))
    checks = table(spark, d, "part").selectExpr("p_partkey", f"{_RULE_NO} as rule_no", f"{_SUB_RULE} as sub_rule")
    return no.attach_citation(checks, kb, ["doc_id", "paragraph"]).select("p_partkey", "citation_id", "citation_source")
