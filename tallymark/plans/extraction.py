"""Declaration and party extraction over labels rendered from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import normalise as nm
from tallymark.operators import extract as ex
from tallymark.operators import parties as pa
from tallymark.plans import sqltext as q
from tallymark.plans.labels import SQL_LABELS, WITH_LABEL_LINES, labels
from tallymark.plans.registry import query, table
from tallymark.sources import transcripts as tr

B = chr(92)
T = "text"


def _lined(spark, d, *more):
    return ex.with_lines(labels(spark, d, *more))


_AMT = f"coalesce({q.g(T, lx.NET_NAMED)}, {q.g(T, lx.NET_BARE)})"
_UNIT = f"coalesce({q.g(T, lx.NET_NAMED, 2)}, {q.g(T, lx.NET_BARE, 2)})"
SQL_NET = f"""
nl as (select doc_id, line_index, {_AMT} as a, {_UNIT} as u from lines where not {q.m(T, lx.NUTRITION)}),
net as (select doc_id, try_cast(arg_min(a, line_index) as double) as net_value, arg_min(u, line_index) as raw_unit from nl where a is not null group by 1)"""


@query("net_quantity", "E1 N7", WITH_LABEL_LINES + f""", {SQL_NET}
select doc_id, net_value, case lower(raw_unit) when 'gms' then 'g' when 'gm' then 'g' when 'kgs' then 'kg' else raw_unit end as unit, coalesce(lower(raw_unit) in ('gms', 'kgs', 'gm'), false) as prohibited,
  case when raw_unit is null then 'Under Review' when lower(raw_unit) in ('gms', 'kgs', 'gm') then 'Defective' else 'Found' end as status from label_src left join net using (doc_id)""")
def net_quantity(spark, d):
    v = ex.net_quantity(_lined(spark, d))
    return v.select("doc_id", F.col("net.value").alias("net_value"), F.col("net.unit").alias("unit"), F.col("net.prohibited").alias("prohibited"), F.col("net.status").alias("status"))


_X1, _X2 = q.g(T, ex.EXPLICIT_NET), q.g(T, ex.EXPLICIT_NET, 2)


@query("label_quantity", "E2 N3", WITH_LABEL_LINES + f"""
, k as (select doc_id, line_index, {_X1} as own, {_X2} as own_u, case when {q.m(T, ex.NET_ALONE)} and not {q.m('next1', ex.LABEL_NUTRITION)} then {q.g('next1', ex.NEXT_QUANTITY)} end as two, {q.g('next1', ex.NEXT_QUANTITY, 2)} as two_u
  from ctx where not {q.m(T, ex.LABEL_NUTRITION)}),
k1 as (select doc_id, arg_min(coalesce(own, two), line_index) as n, arg_min(case when own is not null then own_u else two_u end, line_index) as u, arg_min(case when own is not null then 'keyword' else 'two-line' end, line_index) as s
  from k where coalesce(own, two) is not null group by 1),
a as (select doc_id, line_index, {q.g(T, ex.STANDALONE)} as n, {q.g(T, ex.STANDALONE, 2)} as u from lines where not {q.m(T, ex.LABEL_NUTRITION)} and not {q.m(T, ex.NOT_A_QUANTITY)}),
a1 as (select doc_id, arg_min(n, line_index) as n, arg_min(u, line_index) as u from a where try_cast(n as double) > 0 and try_cast(n as double) <= 50000 group by 1)
select doc_id, try_cast(coalesce(k1.n, a1.n) as double) as numeric, lower(coalesce(k1.u, a1.u)) as unit, coalesce(k1.s, case when a1.n is not null then 'standalone' end) as strategy
from label_src left join k1 using (doc_id) left join a1 using (doc_id)""")
def label_quantity(spark, d):
    v = ex.label_quantity(_lined(spark, d))
    return v.select("doc_id", F.col("qty.numeric").alias("numeric"), F.col("qty.unit").alias("unit"), F.col("qty.strategy").alias("strategy"))


_NOUSP = f"regexp_replace(text, {q.lit(lx.USP)}, '', 'g')"
_SPAN = f"(regexp_extract({_NOUSP}, {q.lit(ex.SLASH_SPAN)}, 1) || ' ' || regexp_extract({_NOUSP}, {q.lit(ex.SLASH_SPAN)}, 3))"
SQL_MRP = f"""
ml as (select doc_id, line_index, coalesce({q.g(_NOUSP, lx.MRP_NAMED)}, {q.g(_NOUSP, lx.MRP_CURRENCY)},
   case when not ({q.m(_SPAN, ex.PRICE_CONFUSERS)} and not {q.m(_SPAN, '(?i)mrp|₹|rs')}) then {q.g(_NOUSP, lx.MRP_SLASH)} end) as a from lines where not {q.m(T, lx.NUTRITION)}),
mrp as (select doc_id, try_cast(arg_min(a, line_index) as double) as amount from ml where a is not null group by 1)"""


@query("retail_price", "E3", WITH_LABEL_LINES + f""", {SQL_MRP}
select doc_id, amount, {q.m(T, lx.TAX_PHRASE)} as tax_phrase, case when amount is null then 'Under Review' when {q.m(T, lx.TAX_PHRASE)} then 'Found' else 'Defective' end as status from label_src left join mrp using (doc_id)""")
def retail_price(spark, d):
    v = ex.retail_price(_lined(spark, d))
    return v.select("doc_id", F.col("mrp.amount").alias("amount"), F.col("mrp.tax_phrase").alias("tax_phrase"), F.col("mrp.status").alias("status"))


_KW = q.rewrite(T, nm.MRP_KEYWORDS)
_BAD = f"(({q.m(T, ex.NET_LINE)} and not {q.m(T, ex.PRICE_WORDS)}) or {' or '.join(q.m(T, p) for p in ex.DISQUALIFIED)})"
_num = lambda e: f"case when try_cast({e} as double) > 0 and try_cast({e} as double) < 500000 then try_cast({e} as double) end"


@query("price_detection", "E4 E5 N4 N5", WITH_LABEL_LINES + f"""
, p as (select *, {_BAD} as bad from ctx),
p2 as (select *, lead(bad, 1) over w as bad1, lead(bad, 2) over w as bad2 from p window w as (partition by doc_id order by line_index)),
c as (select doc_id, line_index, case when not bad and {q.m(_KW, '(?i)mrp|price')} then coalesce({_num(q.g(_KW, ex.PRICE_WITH_TAX))}, {_num(q.g(_KW, ex.PRICE_PLAIN))}, {_num(q.g(_KW, ex.PRICE_CURRENCY))}) end as s1,
  case when not bad and {q.m(T, ex.PRICE_HEAD)} then coalesce(case when not bad1 then {_num(q.g('next1', ex.PRICE_NEXT))} end, case when not bad2 then {_num(q.g('next2', ex.PRICE_NEXT))} end) end as s2,
  case when not bad then {_num(q.g(T, ex.PRICE_CURRENCY))} end as s4, case when not bad then {_num(q.g(T, ex.PRICE_SLASH))} end as s5, {q.m(T, ex.PRICE_UNREADABLE)} as u from p2),
r as (select doc_id, arg_min(s1, line_index) filter (s1 is not null) as a1, arg_min(s2, line_index) filter (s2 is not null) as a2, arg_min(s4, line_index) filter (s4 is not null) as a4,
  arg_min(s5, line_index) filter (s5 is not null) as a5, bool_or(u) as u from c group by 1)
select doc_id, coalesce(a1, a2, a4, a5) as amount, case when a1 is not null then 'direct' when a2 is not null then 'next line' when a4 is not null then 'currency' when a5 is not null then 'slash-dash' when u then 'unreadable' end as strategy,
  case when coalesce(a1, a2, a4, a5) is not null then 'DETECTED' when u then 'REVIEW' else 'NOT DETECTED' end as status, {q.m(T, ex.TAX_STATEMENT)} as tax, contains(lower(text), 'sticker') as sticker
from label_src join r using (doc_id)""")
def price_detection(spark, d):
    v = ex.detect_price(_lined(spark, d))
    return v.select("doc_id", F.col("price.amount").alias("amount"), F.col("price.strategy").alias("strategy"), F.col("price.status").alias("status"),
                    F.col("price.tax").alias("tax"), F.col("price.sticker").alias("sticker"))


@query("price_near_word", "E4 J19", """
select p_partkey as id, case when p_size < 25 then round(p_retailprice, 2) end as price from part""")
def price_near_word(spark, d):
    p = table(spark, d, "part")
    word = lambda t, x0, x1, y0: F.struct(t.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), y0.cast("double").alias("y0"))
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    ws = F.array(word(F.lit("Brand"), F.lit(0), F.lit(40), F.lit(0)), word(F.lit("MRP"), F.lit(10), F.lit(50), F.lit(100)),
                 word(price, F.lit(60), F.lit(120), 100 + F.col("p_size") * 4), word(F.col("p_brand"), F.lit(900), F.lit(990), F.lit(900)))
    return p.select(F.col("p_partkey").alias("id"), ex.near_price(ws).alias("price"))


@query("unit_sale_price", "E6", WITH_LABEL_LINES + f""", {SQL_NET}
select doc_id, 'USP ₹ ' || {q.g(T, lx.USP)} || '/' || {q.g(T, lx.USP, 2)} as value, {q.g(T, lx.USP)} is null and coalesce(net_value > 0 and net_value <= 100, false) as exempt,
  case when {q.g(T, lx.USP)} is not null or coalesce(net_value > 0 and net_value <= 100, false) then 'Found' else 'Under Review' end as status from label_src left join net using (doc_id)""")
def unit_sale_price(spark, d):
    return ex.unit_sale_price(ex.net_quantity(_lined(spark, d))).select("doc_id", "usp.*")


def _line_or_text(p: str) -> str:
    return f"(select arg_min({q.g('l.text', p)}, l.line_index) from lines l where l.doc_id = s.doc_id and {q.g('l.text', p)} is not null)"


_DATES = {"mfd": lx.MFD, "pkd": lx.PKD, "best_before": lx.BEST_BEFORE, "expiry": lx.EXP}
SQL_DATES = "dt as (select doc_id, " + ", ".join(f"arg_min({q.g(T, p)}, line_index) filter ({q.g(T, p)} is not null) as {n}_l" for n, p in _DATES.items()) + " from lines group by 1)"


@query("label_dates", "E7", WITH_LABEL_LINES + f""", {SQL_DATES},
x as (select doc_id, text, {', '.join(f'coalesce({n}_l, {q.g(T, p)}) as {n}' for n, p in _DATES.items())} from label_src join dt using (doc_id))
select doc_id, mfd, pkd, best_before, expiry, regexp_split_to_array(mfd, '[/.-]')[1] as mfd_month, regexp_split_to_array(mfd, '[/.-]')[2] as mfd_year, coalesce(pkd, mfd) as packing_date,
  contains(text, '0?/2024') as date_uncertain, try_cast({q.g('best_before', '([0-9]{1,2})' + B + 's*months?')} as int) as shelf_life_months from x""")
def label_dates(spark, d):
    return ex.dates(_lined(spark, d)).select("doc_id", "mfd", "pkd", "best_before", "expiry", "mfd_month", "mfd_year", "packing_date", "date_uncertain", "shelf_life_months")


@query("label_contacts", "E9 E11 E12 E13", WITH_LABEL_LINES + f"""
, b as (select doc_id, arg_min({q.g(T, lx.BATCH)}, line_index) filter ({q.g(T, lx.BATCH)} is not null) as batch from lines group by 1)
select doc_id, batch, {q.g(T, lx.PHONE, 0)} as phone, {q.g(T, lx.EMAIL, 0)} as email, {q.g(T, lx.PIN)} as pin, coalesce(nullif(trim({q.g(T, lx.ORIGIN)}), ''), 'India') as country_of_origin from label_src join b using (doc_id)""")
def label_contacts(spark, d):
    return ex.contacts(_lined(spark, d)).select("doc_id", "batch", "phone", "email", "pin", "country_of_origin")


@query("titles_and_sections", "E21 E34 W6", """
with t as (select p_partkey as k, p_name || ' ' || (case p_partkey % 9 when 0 then 'Herbal Shampoo' when 1 then 'Masala Biscuits' when 2 then 'Toilet Soap'
   when 3 then 'LED Bulb' when 4 then 'Ball Pen' when 5 then 'Cotton Towel' when 6 then 'Dog Food' else 'Set' end) as n from part),
g as (select *, k % 37 = 0 or len(list_filter(string_split(n, ' '), lambda x: length(x) > 3)) = 0 as bad from t)
select k as doc_id, case when bad then 'Needs Review' else n end as product_name, case when not bad and string_split(n, ' ')[1] not in ('new', 'pure', 'fresh', 'the', 'premium', 'best', 'natural') then string_split(n, ' ')[1] end as brand,
  case when k % 9 = 0 then 'Directions: Apply evenly on skin' end as directions_text,
  case k % 4 when 0 then 'Ingredients: Aqua, Glycerin, Sugar' when 1 then 'Wheat Flour, Sugar, Palm Oil 12 g' end as ingredients_text, case when k % 8 = 1 then 'Keep out of reach of children' end as warnings_text from g""")
def titles_and_sections(spark, d):
    v = ex.title_and_sections(ex.classified_lines(_lined(spark, d)))
    return v.select("doc_id", "product_name", "brand", "directions_text", "ingredients_text", "warnings_text")


_SCOPE = f"coalesce(nullif(string_agg(text, chr(10) order by line_index) filter (not {q.m(T, ex.SIMPLE_NUTRITION)}), ''), '')"


@query("simple_labels", "E33", WITH_LABEL_LINES + f"""
, l1 as (select doc_id, {_SCOPE} as scope, arg_min(text, line_index) filter (length(text) >= 4 and not {q.m(T, ex.NAME_SKIP)}) as nm, arg_min(text, line_index) as fst,
  coalesce(arg_min(text, line_index) filter ({q.m(T, ex.SIMPLE_PARTY)}), arg_min(text, line_index) filter ({q.m(T, ex.SIMPLE_PLACE)})) as address from lines group by 1)
select doc_id, coalesce(nm, fst) as product_name, try_cast(coalesce({q.g('scope', ex.SIMPLE_NET)}, {q.g('scope', ex.SIMPLE_BARE)}) as double) as net_value, coalesce({q.g('scope', ex.SIMPLE_NET, 2)}, {q.g('scope', ex.SIMPLE_BARE, 2)}) as net_unit,
  try_cast(coalesce({q.g(T, lx.MRP_NAMED)}, {q.g(T, lx.MRP_CURRENCY)}) as double) as mrp_amount, {q.m(T, ex.SIMPLE_TAX)} as tax_phrase, {q.g('coalesce(address, text)', lx.PIN)} as pin,
  {q.g(T, ex.SIMPLE_PHONE, 0)} as phone, {q.g(T, lx.EMAIL, 0)} as email from label_src join l1 using (doc_id)""")
def simple_labels(spark, d):
    v = ex.run_extractor(labels(spark, d))
    return v.select("doc_id", "product_name", "net_value", "net_unit", "mrp_amount", "tax_phrase", "pin", "phone", "email")


@query("canonical_fields", "E30", WITH_LABEL_LINES + f""", {SQL_NET}, {SQL_MRP}, {SQL_DATES},
w as (select doc_id, text, net_value, raw_unit, amount, coalesce(mfd_l, {q.g(T, lx.MFD)}) as mfd, coalesce(expiry_l, {q.g(T, lx.EXP)}) as expiry, {q.m(T, lx.TAX_PHRASE)} as tax from label_src left join net using (doc_id) left join mrp using (doc_id) join dt using (doc_id)),
f as (select doc_id, 'net_quantity' as field_name, case when raw_unit is null then 'Under Review' when lower(raw_unit) in ('gms', 'kgs', 'gm') then 'Defective' else 'Found' end as status from w
union all select doc_id, 'mrp', case when amount is null then 'Under Review' when tax then 'Found' else 'Defective' end from w
union all select doc_id, 'tax_inclusive_wording', case when amount is null then 'Under Review' when tax then 'Found' else 'Missing' end from w
union all select doc_id, 'mfd', case when mfd is null then 'Under Review' else 'Found' end from w
union all select doc_id, 'expiry', case when expiry is null then 'Under Review' else 'Found' end from w
union all select doc_id, 'postal_pin', case when {q.g(T, lx.PIN)} is null then 'Under Review' else 'Found' end from w
union all select doc_id, 'consumer_care_email', case when {q.g(T, lx.EMAIL, 0)} is null then 'Under Review' else 'Found' end from w)
select field_name, status, count(*) as labels from f group by 1, 2""")
def canonical_fields(spark, d):
    rows = ex.canonical_fields(ex.declarations(labels(spark, d)), "doc_id")
    shown = ("net_quantity", "mrp", "tax_inclusive_wording", "mfd", "expiry", "postal_pin", "consumer_care_email")
    return rows.filter(F.col("field_name").isin(*shown)).groupBy("field_name", "status").agg(F.count(F.lit(1)).alias("labels"))


@query("label_entities", "E14", """
with k as (select p_partkey as doc_id, p_partkey % 6 as r, p_partkey % 4 <> 3 as plot, case p_partkey % 3 when 0 then 'Noida, Uttar Pradesh - 2013' || lpad(cast(p_partkey % 100 as varchar), 2, '0') when 1 then 'Gurugram, Haryana' else 'Fort, Mumbai 400001' end as city from part)
select doc_id, case r when 0 then 'MANUFACTURER' when 1 then 'MANUFACTURER' when 2 then 'MARKETER' when 3 then 'IMPORTER' when 5 then 'PACKER' end as role,
  case r when 0 then 'Acme Foods Pvt Ltd' when 1 then 'Bharat Mills Limited' when 2 then 'Zenith Traders' when 3 then 'Globex Imports LLP' when 5 then 'Sunrise Packers' end as name,
  case when r = 2 then '122015' else nullif(regexp_extract(city, '([1-9][0-9]{5})', 1), '') end as pin, plot, city from k where r <> 4""".replace(", plot, city from k", " from k"))
def label_entities(spark, d):
    v = pa.commercial_entities(_lined(spark, d))
    return v.select("doc_id", "role", "name", "pin")


def _copy(c: str) -> str:
    return f"({q.m(c, lx.MARKETING)} or {q.m(c, lx.INGREDIENT)} or {q.any_contains(f'lower({c})', lx.FORMULATION_WORDS[:-3])})"


def _near(c: str) -> str:
    return f"case when {c} is not null and not {q.m(c, lx.CUTOFF)} and not coalesce({_copy(c)}, false) then {c} end"


@query("address_fallbacks", "E14", WITH_LABEL_LINES + f"""
, h as (select doc_id, arg_min(concat_ws(', ', text, {_near('prev1')}, {_near('next1')}, {_near('next2')}), line_index) as address from ctx where doc_id % 6 = 4 and {q.m(T, lx.ADDRESS_CUES)} and not {_copy(T)} group by 1)
select doc_id, address, coalesce({q.g('address', lx.PIN)}, {q.g(T, lx.PIN)}) as pin from h join label_src using (doc_id)""")
def address_fallbacks(spark, d):
    lined = _lined(spark, d)
    named = pa.commercial_entities(lined).select("doc_id").distinct()
    return pa.address_fallback(lined.join(named, "doc_id", "left_anti")).select("doc_id", "address", "pin")


@query("line_roles", "E15 E16", WITH_LABEL_LINES + f"""
, r as (select doc_id, line_index, text, case {' '.join(f'when {q.m(T, p)} then {q.lit(n)}' for n, p in pa.ROLE_WORDS)} end as roles from lines)
select doc_id, line_index, unnest(string_split(roles, ',')) as role, {q.m(T, pa.COMPANY)} as is_company from r where roles is not null""")
def line_roles(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"])
    v = pa.roles(ln).withColumn("c", pa.company_candidate(F.col("text")))
    return v.select("doc_id", "line_index", "role", F.col("c.name").isNotNull().alias("is_company"))


@query("assembled_entities", "E18 W7")
def assembled_entities(spark, d):
    return pa.assembled_entities(_lined(spark, d), "doc_id")


@query("missing_roles", "E18", """
with e as (select p_partkey as k, case p_partkey % 3 when 0 then 'PACKER' else 'IMPORTER' end as role from part where p_partkey % 2 = 0)
select k, role, 'line' as name from e union all select p_partkey, 'PACKER', p_brand from part where not exists (select 1 from e where e.k = p_partkey and e.role = 'PACKER')""")
def missing_roles(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    ents = p.filter("p_partkey % 2 = 0").select("k", F.when(F.col("k") % 3 == 0, "PACKER").otherwise("IMPORTER").alias("role"), F.lit("line").alias("name"))
    fields = p.select("k", F.lit("PACKER_NAME").alias("semantic_type"), F.col("p_brand").alias("value"), F.lit(0.9).alias("confidence"))
    return pa.add_missing_roles(ents, fields, "k").select("k", "role", "name")


@query("decomposed_addresses", "E19", """
select p_partkey as id, case when p_partkey % 2 = 0 then p_brand || ' Limited' else p_brand end as company, case when p_partkey % 2 = 0 then 'Plot 4, Noida, Uttar Pradesh' else 'Plot 4, Pune, Maharashtra 4110' || lpad(cast(p_size as varchar), 2, '0') end as street,
 case when p_partkey % 2 = 0 then 'Noida' else 'Pune' end as city, case when p_partkey % 2 = 0 then 'Uttar Pradesh' else 'Maharashtra' end as state, case when p_partkey % 2 = 1 then '4110' || lpad(cast(p_size as varchar), 2, '0') end as pin from part""")
def decomposed_addresses(spark, d):
    p = table(spark, d, "part")
    even = F.col("p_partkey") % 2 == 0
    lines = F.when(even, F.array(F.concat(F.lit("Mfd by: "), F.col("p_brand")), F.lit("Limited"), F.lit("Plot 4"), F.lit("Noida, Uttar Pradesh"))).otherwise(
        F.array(F.concat(F.lit("Packed by "), F.col("p_brand")), F.lit("Plot 4"), F.concat(F.lit("Pune, Maharashtra 4110"), F.lpad(F.col("p_size").cast("string"), 2, "0"))))
    return p.select(F.col("p_partkey").alias("id"), lines.alias("l")).select("id", pa.decompose_address(F.col("l")).alias("a")).select("id", "a.*")


_IDS = ", ".join(f"arg_min({q.g(T, p)}, line_index) filter ({q.g(T, p)} is not null) as {n}" for n, p in pa.IDENTIFIERS.items())


@query("identifiers", "E10", WITH_LABEL_LINES + f"""
select doc_id, {_IDS}, case doc_id % 6 when 0 then 'India' when 3 then 'China' end as origin from lines group by 1""")
def identifiers(spark, d):
    return pa.identifiers(_lined(spark, d)).select("doc_id", *pa.IDENTIFIERS, "origin")


@query("brand_product_variant", "E20 R16")
def brand_product_variant(spark, d):
    v = pa.brand_product_variant(_lined(spark, d), F.when(F.col("doc_id") % 2 == 0, "FRONT").otherwise("BACK"))
    none = F.array().cast("array<struct<confidence:double,partial:boolean>>")
    ents = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit(0.7).alias("confidence"), F.lit(True).alias("partial")))).otherwise(none)
    return v.select("doc_id", "brand", "product", "product_status", "variant",
                    pa.identity_status(F.col("product_status"), F.col("brand"), ents, F.lit(False)).alias("identity_status"))


@query("identity_status", "R16", """
select p_partkey as id, case when p_partkey % 7 = 0 then 'NEEDS_REVIEW' when p_partkey % 3 = 0 then 'PARTIAL' when p_partkey % 2 = 0 then 'CONFIRMED' when p_partkey % 5 = 0 then 'PARTIAL' when p_size > 25 then 'CONFIRMED' else 'UNCERTAIN' end as status from part""")
def identity_status(spark, d):
    k = F.col("p_partkey")
    none = F.array().cast("array<struct<confidence:double,partial:boolean>>")
    ent = lambda c, p: F.array(F.struct(F.lit(c).alias("confidence"), F.lit(p).alias("partial")))
    ents = F.when(k % 3 == 0, ent(0.7, True)).when((k % 2 != 0) & (k % 5 != 0) & (F.col("p_size") > 25), ent(0.9, False)).otherwise(none)
    name = F.when(k % 2 == 0, "CONFIRMED").when(k % 5 == 0, "PARTIAL").otherwise("NOT_VISIBLE")
    return table(spark, d, "part").select(k.alias("id"), pa.identity_status(name, F.lit(None).cast("string"), ents, k % 7 == 0).alias("status"))


@query("field_confidence", "E31 E32 E35", """
with s as (select l_orderkey, l_linenumber, l_discount * 9.97::double as a, l_tax * 9.91::double as b, l_linenumber = 7 as amb from lineitem),
c as (select *, round(least(1.0::double, greatest(0.0::double, a * 0.2::double + b * 0.15::double + a * 0.25::double + 0.15::double + b * 0.15::double + 0.1::double)), 2) as sc from s)
select l_orderkey, l_linenumber, case when amb then 0.45::double else sc end as score, case when amb then 'Needs Review' when sc >= 0.88 then 'High' when sc >= 0.65 then 'Medium' when sc >= 0.5 then 'Low' else 'Needs Review' end as level,
 round(least(0.99::double, greatest(0.1::double, exp(0.25 * ln(greatest(0.1, least(1.0, a))) + 0.15 * ln(0.95) + 0.2 * ln(greatest(0.1, least(1.0, b))) + 0.4 * ln(0.95)))), 2) as overall from c""")
def field_confidence(spark, d):
    a, b, one = F.col("l_discount") * 9.97, F.col("l_tax") * 9.91, F.lit(1.0)
    li = table(spark, d, "lineitem")
    v = li.select("l_orderkey", "l_linenumber", ex.weighted_confidence(a, b, a, one, b, one, F.col("l_linenumber") == 7).alias("w"),
                  ex.geometric_confidence({"ocr": a, "layout": b}).alias("overall"))
    return v.select("l_orderkey", "l_linenumber", "w.score", "w.level", "overall")


FLAGSHIP_SQL = WITH_LABEL_LINES + f""", {SQL_NET}, {SQL_MRP},
f as (select doc_id, strftime(date '2024-01-01' + to_months(cast(doc_id % 12 as int)), '%Y-%m') as month, coalesce(lower(raw_unit) in ('gms', 'kgs', 'gm'), false) as bad_unit, net_value is null as no_net,
  amount is not null and not {q.m(T, lx.TAX_PHRASE)} as no_tax, amount is null as no_price from label_src left join net using (doc_id) left join mrp using (doc_id)),
s as (select *, case when bad_unit or no_tax then 'NON_COMPLIANT' when no_net or no_price then 'NEEDS_REVIEW' else 'COMPLIANT' end as st from f)
select month, count(*) as labels, count(*) filter (st = 'COMPLIANT') as compliant, count(*) filter (st = 'NON_COMPLIANT') as non_compliant, count(*) filter (st = 'NEEDS_REVIEW') as needs_review,
  count(*) filter (bad_unit) as prohibited_units, count(*) filter (no_tax) as missing_tax_phrase, round(count(*) filter (st = 'COMPLIANT') * 100.0::double / count(*), 1) as compliance_rate from s group by 1"""


@query("label_compliance_overview", "S1 E1 E3 R12 A3", FLAGSHIP_SQL)
def label_compliance_overview(spark, d):
    v = ex.retail_price(ex.net_quantity(_lined(spark, d)))
    bad_unit, no_tax = F.col("net.prohibited"), F.col("mrp.status") == "Defective"
    open_ = (F.col("net.status") == "Under Review") | (F.col("mrp.status") == "Under Review")
    month = F.date_format(F.add_months(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 12).cast("int")), "yyyy-MM")
    v = v.select(month.alias("month"), bad_unit.alias("bad_unit"), no_tax.alias("no_tax"),
                 F.when(bad_unit | no_tax, "NON_COMPLIANT").when(open_, "NEEDS_REVIEW").otherwise("COMPLIANT").alias("st"))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("bigint")
    out = v.groupBy("month").agg(
        F.count(F.lit(1)).alias("labels"), n(F.col("st") == "COMPLIANT").alias("compliant"), n(F.col("st") == "NON_COMPLIANT").alias("non_compliant"),
        n(F.col("st") == "NEEDS_REVIEW").alias("needs_review"), n(F.col("bad_unit")).alias("prohibited_units"), n(F.col("no_tax")).alias("missing_tax_phrase"))
    return out.withColumn("compliance_rate", F.round(F.col("compliant") * 100.0 / F.col("labels"), 1))
