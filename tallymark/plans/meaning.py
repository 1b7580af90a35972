"""Meaning of tokens and lines of rendered labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import text as tx
from tallymark.operators import extract as ex
from tallymark.operators import interpret as it
from tallymark.operators import layout as ly
from tallymark.plans import extraction  # noqa: F401  (its SQL is part of full_label_parse)
from tallymark.plans import sqltext as q
from tallymark.plans.labels import SQL_LABELS, WITH_LABEL_LINES, labels
from tallymark.plans.layout import _header_sql, _heading_sql
from tallymark.plans.registry import CATALOGUE, query, table
from tallymark.sources import transcripts as tr


def _lines(spark, d):
    """Label lines with section, heading and neighbours."""
    lined = labels(spark, d).select("doc_id", tx.line_array(F.col("text")).alias("lines"))
    sec = ly.sections_in_text(lined, ["doc_id"])
    return sec.withColumn("_h", ly.heading_of(F.col("text"))).select("doc_id", "line_index", "text", "section", F.col("_h.field").alias("heading"), F.col("_h.value").alias("heading_value"))


SQL_SECTIONED = f""", sm as (select doc_id, line_index, text, {_header_sql('text')} as mark, {_heading_sql('text', 'field')} as heading, prev1, prev2, next1, next2 from ctx),
sl as (select *, coalesce(last_value(mark ignore nulls) over (partition by doc_id order by line_index rows between unbounded preceding and current row), 'OTHER') as section from sm)"""


def _date_sql() -> str:
    tok, shelf = q.g("text", it.DATE, 0), q.g("text", it.SHELF_LIFE, 0)
    body = " ".join(f"when coalesce(heading = '{k}', false) or {q.m('text', p)} then '{k}'" for k, (_, p) in it.DATE_WORDS.items())
    return f"case when {shelf} is not null then 'BEST_BEFORE_DATE' when {tok} is null then case when {q.m('text', '(?i)best before')} and {q.m('text', '(?i)[0-9] *months?')} then 'BEST_BEFORE_DATE' end {body} else 'UNKNOWN' end"


@query("date_meanings", "E8", WITH_LABEL_LINES + SQL_SECTIONED + f" select * from (select doc_id, line_index, {_date_sql()} as semantic_type from sl) where semantic_type is not null")
def date_meanings(spark, d):
    v = _lines(spark, d).select("doc_id", "line_index", it.date(F.col("text"), F.col("heading")).alias("v")).filter("v is not null")
    return v.select("doc_id", "line_index", "v.semantic_type")


def _price_sql() -> str:
    tok = q.g("text", it.PRICE, 0)
    return f"case when {tok} is null then null when coalesce(heading = 'SALE_PRICE', false) or {q.m('text', it.USP_WORDS)} then 'SALE_PRICE' when coalesce(heading = 'MRP', false) or {q.m('text', it.MRP_WORDS)} then 'MRP' else 'UNKNOWN' end"


@query("price_meanings", "E26", WITH_LABEL_LINES + SQL_SECTIONED + f" select * from (select doc_id, line_index, {_price_sql()} as semantic_type, trim({q.g('text', it.PRICE, 0)}) as value from sl) where semantic_type is not null")
def price_meanings(spark, d):
    v = _lines(spark, d).select("doc_id", "line_index", it.price(F.col("text"), F.col("heading")).alias("v")).filter("v is not null")
    return v.select("doc_id", "line_index", "v.semantic_type", "v.value")


def _qty_sql() -> str:
    dim, tok, unit = q.g("text", it.DIMENSION, 0), q.g("text", it.QUANTITY, 0), f"lower({q.g('text', it.QUANTITY, 2)})"
    return f"""case when coalesce({dim}, {tok}) is null then null when section = 'INGREDIENTS' then 'INGREDIENT_QUANTITY' when coalesce(heading = 'NET_QUANTITY', false) or {q.m('text', it.NET_WORDS)} then 'NET_QUANTITY'
      when coalesce(heading = 'SERVING_SIZE', false) or {q.m('text', it.SERVING_WORDS)} then 'SERVING_SIZE' when section = 'NUTRITION' then 'SERVING_SIZE' when {dim} is not null or {q.m('text', it.SIZE_WORDS)} then 'DIMENSION'
      when {unit} in ('mm', 'cm', 'm') and {q.m('text', it.SPEC_WORDS)} then 'TECHNICAL_SPECIFICATION' else 'UNKNOWN' end"""


@query("quantity_meanings", "E25", WITH_LABEL_LINES + SQL_SECTIONED + f" select * from (select doc_id, line_index, {_qty_sql()} as semantic_type from sl) where semantic_type is not null")
def quantity_meanings(spark, d):
    v = _lines(spark, d).select("doc_id", "line_index", it.quantity(F.col("text"), F.col("section"), F.col("heading")).alias("v")).filter("v is not null")
    return v.select("doc_id", "line_index", "v.semantic_type")


def _party_steps() -> list[tuple[str, str, str, str]]:
    """Condition, type, value and confidence, in order."""
    pin, firm = q.g("text", lx.PIN), q.m("text", it.FIRM)
    named = lambda h: f"coalesce(heading = '{h}', false)"
    about = lambda k: f"section = '{k}_INFORMATION'"
    near = "(coalesce(heading in ('MANUFACTURER_ADDRESS', 'PACKER_ADDRESS', 'MARKETER_ADDRESS', 'ADDRESS'), false) or section in ('MANUFACTURER_INFORMATION', 'PACKER_INFORMATION', 'MARKETER_INFORMATION'))"
    steps = [("section = 'INGREDIENTS'", "'INGREDIENTS'", "text", "0.98"), (f"text = {pin} and {near}", "'POSTAL_PIN'", pin, "0.90"), (f"text = {pin}", "'UNKNOWN'", pin, "0.40")]
    for kind, words in it.PARTY_WORDS.items():
        name = q.strip(f"regexp_replace(text, {q.lit('(?i)^' + words + '[:' + chr(92) + 's' + chr(92) + '-]*')}, '')")
        heads = q.m("text", f"(?i){chr(92)}b{words}{chr(92)}b")
        steps.append((f"{firm} and ({named(kind)} or {heads})", f"'{kind}'", name, "0.98"))
    steps += [(f"{firm} and {about(kind)}", f"'{kind}_NAME'", "text", "0.95") for kind in ("MARKETER", "PACKER", "MANUFACTURER")]
    steps.append((firm, "'MANUFACTURER_NAME'", "text", "0.80"))
    state = q.any_contains("lower(text)", it.pa.PLACES)
    role = "case " + " ".join(f"when {named(k + '_NAME')} or {about(k)} then '{k}_ADDRESS'" for k in ("MARKETER", "PACKER", "IMPORTER")) + " else 'MANUFACTURER_ADDRESS' end"
    steps.append((f"{q.m('text', it.ADDRESS_WORDS)} or ({state} and ({pin} is not null or contains(text, ',')))", role, "text", "0.94"))
    return steps


def _party_sql(part: int) -> str:
    return "case " + " ".join(f"when {step[0]} then {step[part]}" for step in _party_steps()) + " end"


@query("party_meanings", "E17", WITH_LABEL_LINES + SQL_SECTIONED + f" select * from (select doc_id, line_index, {_party_sql(1)} as semantic_type, {_party_sql(2)} as value, ({_party_sql(3)})::double as confidence from sl) where semantic_type is not null")
def party_meanings(spark, d):
    v = _lines(spark, d).select("doc_id", "line_index", it.party(F.col("text"), F.col("section"), F.col("heading")).alias("v")).filter("v is not null")
    return v.select("doc_id", "line_index", "v.semantic_type", "v.value", "v.confidence")


def _field_sql() -> str:
    readings = ", ".join(f"nullif({r}, 'UNKNOWN')" for r in (_price_sql(), _date_sql(), _qty_sql(), _party_sql(1)))
    return f"""case when section = 'INGREDIENTS' then coalesce({_qty_sql()}, 'INGREDIENTS') when {q.m('text', lx.EMAIL)} or coalesce(heading = 'CONSUMER_CARE', false) or ({q.m('text', lx.PHONE)} and {q.m('text', lx.CARE_WORDS)}) then 'CONSUMER_CARE'
      when heading in ('BATCH_NUMBER', 'LOT_NUMBER', 'MODEL_NUMBER', 'SERIAL_NUMBER', 'COUNTRY_OF_ORIGIN') then heading else coalesce({readings}, 'UNKNOWN') end"""


# Every known meaning has a confidence of at least 0.80, so just the unknown ones are open.
@query("semantic_fields", "E28 E29 E36 A14", WITH_LABEL_LINES + SQL_SECTIONED + f""", f as (select doc_id, {_field_sql()} as field_name from sl)
select field_name, case when field_name = 'UNKNOWN' then 'NEEDS_REVIEW' else 'CONFIRMED' end as status, count(*) as lines, count(distinct doc_id) as labels from f group by 1, 2""")
def semantic_fields(spark, d):
    rows = it.evidence_map(it.with_review_status(it.semantic_fields(_lines(spark, d))), ["doc_id", "status"])
    return rows.groupBy("field_name", "status").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("labels"))


def _cand_sql() -> str:
    return " union all ".join(f"select doc_id, line_index, '{k}' as entity_type, trim(unnest(regexp_extract_all(text, {q.lit(p)}))) as raw_text from lines" for k, p in it.CANDIDATES.items())


@query("open_candidates", "E22", WITH_LABEL_LINES + f", c as ({_cand_sql()}) select doc_id, line_index, entity_type, raw_text from c where entity_type <> 'COMPANY' or length(raw_text) > 4")
def open_candidates(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"])
    return it.open_candidates(ln).select("doc_id", "line_index", "entity_type", "raw_text")


_CTX = "lower(concat_ws(' | ', prev2, prev1, text, next1, next2))"


@query("token_meanings", "E24", WITH_LABEL_LINES + f"""
, c as ({_cand_sql()}), k as (select c.*, {_CTX} as low from c join ctx using (doc_id, line_index) where entity_type in ('PRICE', 'PIN') and raw_text <> '')
select doc_id, line_index, entity_type, raw_text, case when entity_type = 'PIN' then case when {q.m('low', lx.ADDRESS_CUES)} or {q.any_contains('low', it.pa.PLACES)} then 'POSTAL_PIN' else 'UNKNOWN' end
  when {q.any_contains('low', ('usp', 'u.s.p', 'unit sale price', 'per g', 'per kg', 'per ml'))} or contains(raw_text, '/') then 'UNIT_PRICE'
  when {q.any_contains('low', ('mrp', 'm.r.p', 'maximum retail price', 'max retail price', 'retail price'))} or {q.any_contains('low', ('incl', 'tax'))} then 'MRP' else 'PRICE_CANDIDATE' end as meaning from k""")
def token_meanings(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"])
    c = it.open_candidates(ln).filter(F.col("entity_type").isin("PRICE", "PIN"))
    m = it.token_meaning(F.col("entity_type"), F.col("raw_text"), tr.context_text(2, 2), F.lit(False))
    return c.select("doc_id", "line_index", "entity_type", "raw_text", m["meaning"].alias("meaning"))


@query("quantity_scores", "E23 E32 E35", """
with b as (select p_partkey as id, p_size % 4 as s, p_partkey % 2 = 0 as front, p_partkey % 3 as c from part),
n as (select id, 0.2 + (case when front then 0.35 else 0 end) - (case when s = 1 then 0.3 when s = 2 then 0.2 else 0 end) + (case when c = 0 then 0.55 else 0 end) - (case when c = 1 then 0.4 else 0 end) as net,
  0.1 + (case when s = 2 then 0.5 else 0 end) - (case when c = 0 then 0.3 else 0 end) + (case when c = 1 then 0.7 else 0 end) as srv, 0.1 + (case when s = 1 then 0.65 else 0 end) as ing, 0.1 as oth from b),
r as (select id, net, srv, ing, oth, list_reverse_sort([net, srv, ing, oth]) as l from n)
select id, case when l[1] < 0.45 or (round(l[1] - l[2], 4) < 0.1 and l[1] < 0.65) then 'UNKNOWN' when net = l[1] then 'NET_QUANTITY' when srv = l[1] then 'SERVING_SIZE' else 'INGREDIENT_QUANTITY' end as meaning,
 (case when l[1] < 0.45 or (round(l[1] - l[2], 4) < 0.1 and l[1] < 0.65) then 0.5 else round(least(0.99, greatest(0.6, l[1])), 2) end)::double as confidence from r""")
def quantity_scores(spark, d):
    s, c = F.col("p_size") % 4, F.col("p_partkey") % 3
    section = F.when(s == 1, "INGREDIENTS").when(s == 2, "NUTRITION_INFORMATION").otherwise("OTHER")
    context = F.when(c == 0, "Net Qty 5 g").when(c == 1, "per serving 5 g").otherwise("5 g")
    m = it.quantity_meaning(context, section, F.when(F.col("p_partkey") % 2 == 0, "Front (PDP)").otherwise("Back Panel"), F.lit("Food"), F.lit("g"), F.lit(False))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), m.alias("m"))
    e = ex.explain(v.select("id", F.lit("5 g").alias("value"), F.col("m.meaning").alias("meaning"), F.col("m.confidence").alias("confidence"), F.lit("context").alias("reason")))
    return e.select("id", "meaning", "confidence")


@query("differentiated_quantities", "E27", """
select p_partkey as id, case p_partkey % 6 when 0 then 'TECHNICAL_WEIGHT' when 1 then 'DIMENSION' when 2 then 'SERVING_SIZE' when 3 then 'INGREDIENT_QUANTITY' when 4 then 'LIQUID_CAPACITY' else case when p_size % 2 = 0 then 'NET_VOLUME' else 'NET_QUANTITY' end end as field from part""")
def differentiated_quantities(spark, d):
    k = F.col("p_partkey") % 6
    pick = lambda *v: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]), (k + 1).cast("int"))
    unit = F.when(F.col("p_size") % 2 == 0, "ml").otherwise("g")
    f = it.differentiate(pick("Weight: 450 g", "10 mm drill", "Per serving 5 g", "Contains: salt 5 g", "Tank capacity 5 l", "Net Qty 5"), F.lit(""), pick("g", "mm", "g", "g", "l", unit), F.lit("QUANTITY"),
                         pick("ELECTRONICS", "TOOLS", "FOOD", "FOOD", "FOOD", "FOOD"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), f.alias("field"))


_UNITS = ", ".join(q.lit(u) for u in ex.STANDARD_UNITS)
_PARTS_OF_LABEL = ", ".join(f"{short} as ({CATALOGUE[name].sql})" for short, name in (("t", "titles_and_sections"), ("n", "label_quantity"), ("p", "price_detection"), ("d", "label_dates"), ("c", "label_contacts")))


@query("full_label_parse", "E37 E2 E4 E34", f"""
with {_PARTS_OF_LABEL}, s as (with {SQL_LABELS} select doc_id, {q.m('text', ex.WHEN_PACKED)} as when_packed from label_src)
select doc_id, t.product_name, n.numeric as quantity, n.unit, p.amount as price, d.mfd, d.expiry, c.batch, c.phone, c.email, t.ingredients_text,
  coalesce(n.strategy is not null and (n.unit not in ({_UNITS}) or s.when_packed), false) as unit_violation, p.status = 'DETECTED' and not p.tax as tax_violation
from s join t using (doc_id) join n using (doc_id) join p using (doc_id) join d using (doc_id) join c using (doc_id)""")
def full_label_parse(spark, d):
    """Every declaration of every label with its violations flags."""
    v = ex.detect_price(ex.label_quantity(ex.declarations(labels(spark, d))))
    bad_qty = F.coalesce(~F.col("qty.standard") | F.col("qty.plural") | F.col("qty.when_packed"), F.lit(False))
    no_tax = (F.col("price.status") == "DETECTED") & ~F.col("price.tax")
    return v.select("doc_id", "product_name", F.col("qty.numeric").alias("quantity"), F.col("qty.unit").alias("unit"), F.col("price.amount").alias("price"), "mfd", "expiry", "batch", "phone", "email",
                    "ingredients_text", bad_qty.alias("unit_violation"), no_tax.alias("tax_violation"))
