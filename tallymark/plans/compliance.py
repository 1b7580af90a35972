"""Rules by products, violations and review queues over parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import filters as fl
from tallymark.operators import rules as ru
from tallymark.operators import violations as vi
from tallymark.plans.registry import query, table
from tallymark.sources import rules_library as lib

# A part as a product whose panels have been merged: (field, value, status).
PRODUCT = {
    "product_id": "concat('P', cast(p_partkey as string))",
    "session_id": "p_brand",
    "category": "case when p_size % 17 = 0 then 'UNKNOWN' else p_type end",
    "category_status": "case when p_size % 19 = 0 then 'NEEDS_REVIEW' else 'CONFIRMED' end",
    "target_day": "case when p_partkey % 4 = 0 then '2010-06-01' else '2024-06-01' end",
}
FIELDS = {
    "PRODUCT_NAME": ("p_name", "case when p_partkey % 31 = 0 then 'UNKNOWN' else 'CONFIRMED' end"),
    "NET_QUANTITY": (
        "case when p_partkey % 13 = 0 then '' else concat(cast(p_size as string), case when p_partkey % 3 = 0 then ' g' when p_partkey % 3 = 1 then ' kg' else ' ml' end) end",
        "case p_partkey % 7 when 0 then 'CONFLICT' when 1 then 'NEEDS_REVIEW' when 2 then 'NOT_VISIBLE' else 'CONFIRMED' end"),
    "MRP": (
        "concat(case when p_partkey % 5 = 0 then 'Price ' when p_partkey % 5 = 1 then 'MRP ' else 'Rs. ' end, cast(cast(p_retailprice as decimal(12,2)) as string))",
        "case when p_partkey % 11 = 0 then 'CONFLICT' else 'CONFIRMED' end"),
    "MANUFACTURER_NAME": ("case when p_partkey % 6 = 0 then '' else 'Acme Foods Ltd' end", "case when p_partkey % 9 = 0 then 'NEEDS_REVIEW' else 'CONFIRMED' end"),
    "MANUFACTURER_ADDRESS": ("case when p_partkey % 8 = 0 then 'Ingredients: sugar, salt' else 'Plot 12, Phase II, Noida 201301' end", "'CONFIRMED'"),
    "MANUFACTURING_DATE": ("case when p_partkey % 10 = 0 then '' else '05/2024' end", "'CONFIRMED'"),
    "COUNTRY_OF_ORIGIN": ("case when p_partkey % 12 = 0 then 'China' else '' end", "'CONFIRMED'"),
    "ENTITY_MANUFACTURER_NAME": ("case when p_partkey % 18 = 0 then 'Beta Mills' else '' end", "'CONFIRMED'"),
}
# Rules beside the standard ones: unverified, expired, for one category, wholesale.
EXTRA_RULES = [
    ("RULE_X_DRAFT", "Rule X", "X(1)", "Batch number marking", "DECLARATION", "BATCH_NUMBER", "ALL", "RETAIL", "2011-03-07", None, "UNVERIFIED"),
    ("RULE_X_EXPIRED", "Rule Y", "Y(1)", "Common or generic name", "DECLARATION", "PRODUCT_NAME", "ALL", "ALL", "2001-01-01", "2012-12-31", "VERIFIED"),
    ("RULE_X_PROMO", "Rule Z", "Z(1)", "Promotional pack name", "DECLARATION", "PRODUCT_NAME", "PROMO", "RETAIL", "2011-03-07", None, "VERIFIED"),
    ("RULE_X_WHOLESALE", "Rule 24", "24(1)", "Wholesale package marking", "DECLARATION", "PRODUCT_NAME", "ALL", "WHOLESALE", "2011-03-07", None, "VERIFIED"),
]


def rule_table(spark):
    extra = spark.createDataFrame(
        EXTRA_RULES, "rule_id string, rule_number string, sub_rule string, title string, requirement_type string, f string, c string, "
        "market_context string, a string, b string, verification_status string")
    extra = extra.select(
        "rule_id", "rule_number", "sub_rule", "title", "requirement_type", F.array("f").alias("required_fields"), F.array("c").alias("categories"),
        "market_context", F.col("a").cast("date").alias("effective_from"), F.col("b").cast("date").alias("effective_until"), "verification_status",
        F.lit("Gazette of India").alias("source_name"), F.lit("2024.1").alias("source_version"))
    return lib.standard_rules(spark).unionByName(extra)


def products(spark, d):
    """Products with their facts map; built inside the row, nothing is shuffled."""
    fact = lambda v, s: F.struct(F.expr(v).alias("value"), F.expr(s).alias("status"), F.lit(0.9).alias("confidence"))
    facts = F.map_from_arrays(F.array(*[F.lit(n) for n in FIELDS]), F.array(*[fact(v, s) for v, s in FIELDS.values()]))
    return table(spark, d, "part").select(
        *[F.expr(e).alias(n) for n, e in PRODUCT.items()], facts.alias("facts"), F.lit(False).alias("imported"))


def evaluations(spark, d):
    pairs = ru.rules_for_products(products(spark, d), rule_table(spark), F.to_date("target_day"))
    return ru.evaluate(ru.applicability(pairs))


def _sql_rules() -> str:
    rows = []
    for rid, number, _, title in lib.STANDARD_RULES:
        kind = {"RULE_06_NET_QUANTITY": "NET_QUANTITY", "RULE_06_MRP": "MRP", "RULE_06_CONSUMER_CARE": "CONSUMER_CARE", "RULE_06_COUNTRY_ORIGIN": "IMPORTER"}.get(rid, "DECLARATION")
        field = {"RULE_06_NAME_ADDRESS": "MANUFACTURER", "RULE_06_NET_QUANTITY": "NET_QUANTITY", "RULE_06_DATE": "MANUFACTURING_DATE", "RULE_06_MRP": "MRP",
                 "RULE_06_CONSUMER_CARE": "CONSUMER_CARE", "RULE_06_COUNTRY_ORIGIN": "COUNTRY_OF_ORIGIN"}.get(rid, "PRODUCT_NAME")
        rows.append((rid, number, title, kind, field, "ALL", "RETAIL", "2011-03-07", "9999-12-31", "VERIFIED"))
    for rid, number, _, title, kind, field, cat, market, a, b, v in EXTRA_RULES:
        rows.append((rid, number, title, kind, field, cat, market, a, b or "9999-12-31", v))
    body = ",\n".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    return f"rules(rule_id, rule_number, title, kind, field, cat, market, a, b, verification) as (values {body})"


_SQL_FIELDS = ", ".join(f"({v}) as {n}_v, ({s}) as {n}_s" for n, (v, s) in FIELDS.items())
_SQL_PRODUCT = ", ".join(f"{e} as {n}" for n, e in PRODUCT.items())

WITH_EVALUATIONS = f"""with {_sql_rules()},
prod as (select {_SQL_PRODUCT}, {_SQL_FIELDS},
   regexp_extract(lower(NET_QUANTITY_v), '([0-9.]+)\\s*(g|kg|ml|l|ltr|mg)', 1) as qn, regexp_extract(lower(NET_QUANTITY_v), '([0-9.]+)\\s*(g|kg|ml|l|ltr|mg)', 2) as qu from part),
pairs as (select p.*, r.*,
   case when category = 'UNKNOWN' or category_status = 'NEEDS_REVIEW' then 'NEEDS_REVIEW'
     when market not in ('ALL', 'RETAIL') then 'NOT_APPLICABLE'
     when rule_id in ('RULE_06_NET_QUANTITY', 'RULE_06_MRP', 'RULE_06_DATE') and qn <> '' and
        try_cast(qn as double) * (case when qu in ('kg', 'l', 'ltr') then 1000 else 1 end) <= 10 and qu in ('g', 'kg', 'ml', 'l', 'ltr') then 'NOT_APPLICABLE'
     when field = 'COUNTRY_OF_ORIGIN' and COUNTRY_OF_ORIGIN_v = '' then 'NOT_APPLICABLE'
     else 'APPLICABLE' end as applicability_status
   from prod p join rules r on (r.cat = 'ALL' or r.cat = upper(p.category)) and target_day between a and b),
ev0 as (select *, case field
   when 'NET_QUANTITY' then case when NET_QUANTITY_s = 'CONFIRMED' and NET_QUANTITY_v <> '' then 'COMPLIANT' when NET_QUANTITY_s <> 'CONFIRMED' then NET_QUANTITY_s else 'NON_COMPLIANT' end
   when 'MRP' then case when MRP_s = 'CONFLICT' then 'CONFLICT' when MRP_v like 'Price%' then 'NON_COMPLIANT' else 'COMPLIANT' end
   when 'PRODUCT_NAME' then case when PRODUCT_NAME_s = 'UNKNOWN' then 'NEEDS_REVIEW' else 'COMPLIANT' end
   when 'MANUFACTURING_DATE' then case when MANUFACTURING_DATE_v = '' then 'NON_COMPLIANT' else 'COMPLIANT' end
   when 'COUNTRY_OF_ORIGIN' then case when COUNTRY_OF_ORIGIN_v = '' then 'NON_COMPLIANT' else 'COMPLIANT' end
   when 'MANUFACTURER' then case
      when MANUFACTURER_ADDRESS_v like 'Ingredients%' then 'NON_COMPLIANT'
      when MANUFACTURER_NAME_v = '' and ENTITY_MANUFACTURER_NAME_v = '' then 'NON_COMPLIANT'
      when MANUFACTURER_NAME_v <> '' and MANUFACTURER_NAME_s <> 'CONFIRMED' then 'NEEDS_REVIEW' else 'COMPLIANT' end
   else 'NON_COMPLIANT' end as checked,
   case field when 'NET_QUANTITY' then NET_QUANTITY_v
     when 'MRP' then case when MRP_v like 'Price%' then MRP_v else '₹' || regexp_extract(MRP_v, '([0-9.]+)$', 1) end
     when 'PRODUCT_NAME' then PRODUCT_NAME_v when 'MANUFACTURING_DATE' then MANUFACTURING_DATE_v when 'COUNTRY_OF_ORIGIN' then COUNTRY_OF_ORIGIN_v
     when 'MANUFACTURER' then coalesce(nullif(MANUFACTURER_NAME_v, ''), MANUFACTURER_ADDRESS_v) else '' end as obs from pairs),
ev as (select *, case when verification <> 'VERIFIED' then 'NEEDS_REVIEW' when applicability_status = 'NOT_APPLICABLE' then 'NOT_APPLICABLE'
     when applicability_status = 'NEEDS_REVIEW' then 'NEEDS_REVIEW' else checked end as evaluation_status,
   case when verification = 'VERIFIED' and applicability_status = 'APPLICABLE' then nullif(obs, '') end as observed_value,
   case when verification <> 'VERIFIED' then 0.5::double when applicability_status = 'NOT_APPLICABLE' then 1.0::double
     when applicability_status = 'NEEDS_REVIEW' then 0.5::double else 0.95::double end as confidence from ev0),
routed as (select *, case when applicability_status = 'NOT_APPLICABLE' or evaluation_status = 'NOT_APPLICABLE' then 'skip' when evaluation_status = 'COMPLIANT' then 'compliant'
     when evaluation_status = 'NON_COMPLIANT' and applicability_status = 'APPLICABLE' then 'violation' else 'review' end as route,
   case when rule_id like '%NET_QUANTITY%' or lower(title) like '%quantity%' then 'QUANTITY_NON_COMPLIANCE'
     when rule_id like '%MRP%' or lower(title) like '%price%' then 'PRICE_DECLARATION_ISSUE'
     when rule_id like '%DATE%' or lower(title) like '%month%' then 'DATE_DECLARATION_ISSUE'
     when rule_id like '%NAME_ADDRESS%' or lower(title) like '%manufacturer%' or lower(title) like '%packer%' then 'ENTITY_INFORMATION_ISSUE'
     when rule_id like '%CONSUMER_CARE%' or lower(title) like '%consumer%' then 'CONSUMER_INFORMATION_ISSUE'
     when rule_id like '%PRODUCT_NAME%' or lower(title) like '%generic name%' then 'MISSING_REQUIRED_DECLARATION'
     else 'OTHER_VERIFIED_NON_COMPLIANCE' end as violation_type from ev)
"""


@query("rule_evaluations", "J21 R1 R3 R4 R5 R6 N6 P15", WITH_EVALUATIONS + """
select product_id, rule_id, applicability_status, evaluation_status, confidence, observed_value from ev""")
def rule_evaluations(spark, d):
    return evaluations(spark, d).select("product_id", "rule_id", "applicability_status", "evaluation_status", "confidence", "observed_value")


@query("rule_traces", "R7", WITH_EVALUATIONS + """
select product_id, rule_id, applicability_status = 'APPLICABLE' as applicable,
  3 + (case when verification <> 'VERIFIED' then 1 else 0 end) + (case when applicability_status = 'NOT_APPLICABLE' then 1 else 0 end) as n_steps,
  'Evaluation: ' || evaluation_status as last_step from ev""")
def rule_traces(spark, d):
    t = ru.trace(evaluations(spark, d))
    return t.select("product_id", "rule_id", "applicable", F.size("trace_steps").alias("n_steps"), F.element_at("trace_steps", -1).alias("last_step"))


@query("session_compliance", "R21", WITH_EVALUATIONS + """
, p as (select session_id, product_id, max(case evaluation_status when 'NON_COMPLIANT' then 2 when 'NEEDS_REVIEW' then 1 when 'CONFLICT' then 1 else 0 end) as w from ev group by 1, 2)
select session_id, count(*) as products, case max(w) when 2 then 'NON_COMPLIANT' when 1 then 'NEEDS_REVIEW' else 'COMPLIANT' end as overall_status from p group by 1""")
def session_compliance(spark, d):
    per_product = ru.roll_up(evaluations(spark, d), "session_id", "product_id")
    return ru.roll_up(per_product, "session_id", status_col="overall_status").withColumnRenamed("evaluated", "products")


@query("violation_list", "V1 V2 V3", WITH_EVALUATIONS + """
select product_id, rule_id, violation_type, observed_value,
 case when observed_value is not null then 'Declaration for ' || rule_number || ' (' || title || ') was observed as ''' || observed_value || ''' and evaluated as non-compliant under statutory rule verification.'
   else 'Mandatory declaration for ' || rule_number || ' (' || title || ') was not found on available product package panels.' end as description,
 substr(sha256(product_id || ':' || rule_id || ':' || violation_type || ':' || lower(trim(coalesce(observed_value, 'missing_declaration')))), 1, 32) as fingerprint
from routed where route = 'violation'""")
def violation_list(spark, d):
    rows = vi.violation_rows(vi.route(evaluations(spark, d)))
    return rows.select("product_id", "rule_id", "violation_type", "observed_value", "description", "fingerprint")


@query("review_queue", "V5", WITH_EVALUATIONS + """
select product_id, rule_id, case when applicability_status = 'NEEDS_REVIEW' then 'AMBIGUOUS_APPLICABILITY' when evaluation_status = 'CONFLICT' then 'CONFLICTING_DECLARATIONS'
  when evaluation_status = 'NOT_VISIBLE' then 'NOT_VISIBLE' else 'INSUFFICIENT_EVIDENCE' end as reason from routed where route = 'review'""")
def review_queue(spark, d):
    return vi.review_rows(vi.route(evaluations(spark, d))).select("product_id", "rule_id", "reason")


@query("violation_summary", "V6", WITH_EVALUATIONS + """
, s as (select session_id, product_id, count(*) as t, count(*) filter (route = 'violation') as v, count(*) filter (route = 'review') as r,
  count(*) filter (evaluation_status = 'COMPLIANT') as c, count(*) filter (route = 'skip') as n from routed group by 1, 2)
select session_id, count(*) as products, cast(sum(t) as bigint) as total_evaluations, cast(sum(v) as bigint) as confirmed_violations, cast(sum(r) as bigint) as needs_review_items,
  cast(sum(c) as bigint) as compliant_rules, cast(sum(n) as bigint) as not_applicable_rules,
  case when sum(v) > 0 then 'NON_COMPLIANT' when sum(r) > 0 then 'NEEDS_REVIEW' else 'COMPLIANT' end as overall_status from s group by 1""")
def violation_summary(spark, d):
    return vi.session_summary(vi.summary(vi.route(evaluations(spark, d)), "session_id", "product_id"))


@query("final_results", "J23", WITH_EVALUATIONS + """
select product_id, session_id, count(*) as rules_evaluated, count(*) filter (evaluation_status = 'COMPLIANT') as compliant,
  count(*) filter (route = 'violation') as non_compliant, count(*) filter (route = 'review') as needs_review, count(*) filter (route = 'skip') as not_applicable,
  case when count(*) filter (route = 'violation') > 0 then 'NON_COMPLIANT' when count(*) filter (route = 'review') > 0 then 'NEEDS_REVIEW' else 'COMPLIANT' end as overall_status
from routed group by 1, 2""")
def final_results(spark, d):
    counts = vi.summary(vi.route(evaluations(spark, d)), "product_id")
    return vi.assemble_results(products(spark, d).select("product_id", "session_id"), counts)


@query("rules_in_force", "R1 R2", """
select o_orderkey, case when o_orderdate between '2001-01-01' and '2012-12-31' then 1 else 0 end as n_rules from orders""")
def rules_in_force(spark, d):
    expired = lib.find_rule(rule_table(spark), "y(1)")
    days = table(spark, d, "orders").select("o_orderkey", F.lit("X").alias("category"), F.to_date("o_orderdate").alias("day"))
    hits = ru.rules_for_products(days, expired, F.col("day")).groupBy("o_orderkey").count()
    return days.join(hits, "o_orderkey", "left").select("o_orderkey", F.coalesce("count", F.lit(0)).cast("int").alias("n_rules"))


@query("rule_library_search", "P6", """
select p_partkey as id, p_name as title, p_brand as category from part where contains(lower(concat_ws(' | ', 'Rule ' || p_size, p_name, p_type)), 'econ') and p_brand = 'Brand#17'
union all select p_partkey, p_name, 'all' from part where contains(lower(concat_ws(' | ', 'Rule ' || p_size, p_name, p_type)), 'rule 1')""")
def rule_library_search(spark, d):
    """One rule for each part, searched by a word within a category and by a rule number over all."""
    rules = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Rule "), F.col("p_size").cast("string")).alias("rule_number"), F.col("p_name").alias("title"),
        F.col("p_type").alias("applicable_declaration"), F.col("p_name").alias("requirement"), F.col("p_brand").alias("category"))
    within = fl.rule_library_filter(rules, "Econ", "Brand#17").select("id", "title", "category")
    return within.unionByName(fl.rule_library_filter(rules, "Rule 1").select("id", "title", F.lit("all").alias("category")))


TITLES = ["Name and complete address", "Common or generic name", "Net quantity in units", "Month and year of packing", "Maximum retail price", "Consumer care details", "Country of origin", "Batch marking", "Sale price of packs", "Short title"]


@query("derived_rules", "S2 R2 R3", f"""
with t as (select p_partkey as k, ({'[' + ', '.join("'" + x + "'" for x in TITLES) + ']'})[1 + p_partkey % 10] as title, p_partkey % 10 as i from part)
select case when k % 20 = 4 then 'RULE_06_MRP' else 'RULE_' || cast(k as varchar) end as rule_id, k as rule_key, title, case i when 6 then 'IMPORTER' when 2 then 'NET_QUANTITY' when 4 then 'MRP' when 8 then 'MRP' when 5 then 'CONSUMER_CARE' else 'DECLARATION' end as requirement_type,
 case i when 0 then 'MANUFACTURER_NAME,MANUFACTURER_ADDRESS' when 2 then 'NET_QUANTITY' when 3 then 'MANUFACTURING_DATE' when 4 then 'MRP' when 5 then 'CONSUMER_CARE' when 6 then 'IMPORTER_NAME,IMPORTER_ADDRESS,COUNTRY_OF_ORIGIN' when 7 then 'BATCH_NUMBER' else 'PRODUCT_NAME' end as required_fields,
 case k % 3 when 0 then 'VERIFIED' when 1 then 'UNVERIFIED' else 'SUPERSEDED' end as verification_status from t""")
def derived_rules(spark, d):
    k = F.col("p_partkey")
    entry = F.struct(*[F.lit(None).cast("string").alias(f.name) for f in lib.LIBRARY_ENTRY.fields if f.name not in ("rule_id", "rule_no", "rule_title", "verification_status")],
                     F.when(k % 20 == 4, "rule_06_1_e").otherwise(F.concat(F.lit("rule_"), k.cast("string"))).alias("rule_id"), k.cast("string").alias("rule_no"),
                     F.element_at(F.array(*[F.lit(t) for t in TITLES]), (1 + k % 10).cast("int")).alias("rule_title"),
                     F.when(k % 3 == 0, "MANDATORY").when(k % 3 == 1, "draft").otherwise("expired").alias("verification_status"))
    docs = table(spark, d, "part").select(F.lit("v1").alias("version"), F.array(entry).alias("rules"))
    r = lib.derive_rules(docs)
    return r.select("rule_id", F.col("rule_number").cast("bigint").alias("rule_key"), "title", "requirement_type", F.array_join("required_fields", ",").alias("required_fields"), "verification_status")


DEDUP_SQL = """with v as (select 'P' || cast(l_partkey as varchar) as product_id, case l_linenumber % 3 when 0 then 'RULE_06_MRP' when 1 then 'RULE_06_NET_QUANTITY' else 'RULE_06_DATE' end as rule_id,
  l_shipdate, l_orderkey, l_linenumber, 0.5 + l_discount as confidence from lineitem),
f as (select *, substr(sha256(product_id || ':' || rule_id || ':' || rule_id || ':missing_declaration'), 1, 32) as fingerprint from v)
"""


def _reports(spark, d):
    rule = F.when(F.col("l_linenumber") % 3 == 0, "RULE_06_MRP").when(F.col("l_linenumber") % 3 == 1, "RULE_06_NET_QUANTITY").otherwise("RULE_06_DATE")
    li = table(spark, d, "lineitem")
    v = li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"), rule.alias("rule_id"), "l_orderkey", "l_linenumber",
                  (F.lit(0.5) + F.col("l_discount")).alias("confidence"))
    return v.withColumn("fingerprint", vi.fingerprint(F.col("product_id"), F.col("rule_id"), F.col("rule_id"), F.lit(" Missing_Declaration ")))


@query("violation_dedup", "V4", DEDUP_SQL + """
select fingerprint, product_id, rule_id, round(max(confidence), 4) as confidence, count(*) as reports, min(l_orderkey * 10 + l_linenumber) as first_report from f group by 1, 2, 3""")
def violation_dedup(spark, d):
    v = _reports(spark, d).withColumn("first_report", F.col("l_orderkey") * 10 + F.col("l_linenumber")).drop("l_orderkey", "l_linenumber").withColumn("ord", F.col("first_report"))
    return vi.deduplicate(v, "ord").withColumn("confidence", F.round("confidence", 4))


@query("violation_evidence", "V4", DEDUP_SQL + """
select fingerprint, cast(count(distinct (l_orderkey % 50, l_linenumber)) as bigint) as evidence from f group by 1""")
def violation_evidence(spark, d):
    ev = _reports(spark, d).select("fingerprint", (F.col("l_orderkey") % 50).alias("image_id"), F.lit("FRONT").alias("panel"), F.col("l_linenumber").alias("region_id"), F.lit("").alias("bbox"))
    return vi.merge_evidence(ev).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("evidence"))


@query("officer_decisions", "V7", """
with v as (select l_orderkey as case_id, l_orderkey * 10 + l_linenumber as violation_id, l_partkey, l_linenumber from lineitem),
d as (select o_orderkey * 10 + (o_orderkey % 7) + 1 as violation_id, arg_max(case when o_orderstatus = 'F' then 'Dismissed' else 'Accepted' end, o_orderkey) as s from orders group by 1)
select case_id, count(*) as violations, count(*) filter (coalesce(s, 'Needs Review') <> 'Dismissed') as active_violations,
  case when count(*) filter (coalesce(s, 'Needs Review') <> 'Dismissed') > 0 then 'Non-Compliant' else 'Compliant' end as status
from v left join d using (violation_id) group by 1""")
def officer_decisions(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("violation_id"))
    dec = table(spark, d, "orders").select((F.col("o_orderkey") * 10 + F.col("o_orderkey") % 7 + 1).alias("violation_id"),
                                           F.when(F.col("o_orderstatus") == "F", "Dismissed").otherwise("Accepted").alias("officer_status"),
                                           F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    return vi.apply_decisions(v, dec)


@query("tax_edit_cure", "V7", """
with v as (select l_orderkey as case_id, case when l_discount > 0.05 then 'Missing Tax phrase' else 'Prohibited unit' end as violation_type from lineitem)
select violation_type, count(*) as n from v where violation_type not like '%Tax%' or case_id not in (select o_orderkey from orders where o_orderpriority = '5-LOW') group by 1""")
def tax_edit_cure(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_discount") > 0.05, "Missing Tax phrase").otherwise("Prohibited unit").alias("violation_type"))
    edits = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderpriority") == "5-LOW", "Rs 10 (Inclusive of all taxes)").otherwise("Rs 10").alias("value"))
    return vi.drop_tax_violations(v, edits).groupBy("violation_type").agg(F.count(F.lit(1)).alias("n"))


@query("violation_set_merge", "V8", """
with a as (select distinct l_orderkey as scan_id, l_shipmode as violation_type from (select l_orderkey, l_returnflag || l_linestatus as l_shipmode, l_discount from lineitem) where l_discount > 0.07),
b as (select distinct l_orderkey as scan_id, l_returnflag || l_linestatus as violation_type from lineitem where l_discount <= 0.07)
select scan_id, violation_type, 'parser' as origin from a union all select scan_id, violation_type, 'engine' from b where not exists (select 1 from a where a.scan_id = b.scan_id and a.violation_type = b.violation_type)""")
def violation_set_merge(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.concat("l_returnflag", "l_linestatus").alias("violation_type"), "l_discount", F.col("l_linenumber").alias("ord"))
    parser = li.filter("l_discount > 0.07").select("scan_id", "violation_type").distinct().withColumn("origin", F.lit("parser"))
    engine = li.filter("l_discount <= 0.07").select("scan_id", "violation_type", "ord", F.lit("engine").alias("origin"))
    return vi.merge_violation_sets(parser, engine).drop("ord")


@query("cited_violations", "V9 J22", """
with v as (select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'RULE_06_MRP' when 1 then 'RULE_06_NAME_ADDRESS' else 'RULE_99' end as rule_id,
  case when l_linenumber % 2 = 0 then 'Missing PIN' else 'Incomplete address' end as violation_type,
  case when l_quantity > 30 then 'Noida 2013' || cast(cast(l_quantity as int) as varchar) when l_quantity < 10 then 'Aqua, Glycerin' else 'Noida' end as evidence_text from lineitem)
select l_orderkey, l_linenumber, violation_type, case rule_id when 'RULE_06_MRP' then 'Rule 6(1)(e)' when 'RULE_06_NAME_ADDRESS' then 'Rule 6(1)(a)' end as cited_rule from v
where evidence_text <> 'Aqua, Glycerin' and not (violation_type = 'Missing PIN' and evidence_text like 'Noida 2%')""")
def cited_violations(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    v = li.select("l_orderkey", "l_linenumber",
                  F.when(n % 3 == 0, "RULE_06_MRP").when(n % 3 == 1, "RULE_06_NAME_ADDRESS").otherwise("RULE_99").alias("rule_id"),
                  F.when(n % 2 == 0, "Missing PIN").otherwise("Incomplete address").alias("violation_type"),
                  F.when(F.col("l_quantity") > 30, F.concat(F.lit("Noida 2013"), F.col("l_quantity").cast("int").cast("string")))
                  .when(F.col("l_quantity") < 10, "Aqua, Glycerin").otherwise("Noida").alias("evidence_text"))
    return vi.vet_and_cite(v, lib.standard_rules(spark)).select("l_orderkey", "l_linenumber", "violation_type", "cited_rule")
