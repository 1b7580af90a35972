"""Statutory checks, scores, schema, quality and jurisdiction over parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import checks as ck
from tallymark.operators import classify as cl
from tallymark.operators import filters as fl
from tallymark.plans import sqltext as q
from tallymark.plans.registry import query, table

FACT = {
    "id": "p_partkey", "product_name": "case when p_partkey % 29 = 0 then '' else p_name end",
    "commodity_name": "case p_partkey % 10 when 0 then 'Cotton shirt' when 1 then 'LED bulb' when 2 then 'Pan Masala' when 3 then 'Mustard Oil' when 4 then 'Bandage' when 5 then '' else 'Biscuits' end",
    "net_value": "case when p_partkey % 17 = 0 then 0.0 else p_size * 1.0 end", "net_unit": "case p_partkey % 3 when 0 then 'g' when 1 then 'kg' else 'ml' end",
    "net_prohibited": "p_partkey % 7 = 0", "net_conflict": "p_partkey % 23 = 0", "mfd": "case when p_partkey % 5 = 0 then '' else '05/2024' end", "mfd_uncertain": "p_partkey % 19 = 0",
    "pkd": "case when p_partkey % 6 = 0 then '04/2024' else '' end", "expiry": "case when p_partkey % 2 = 0 then '05/2026' else '' end",
    "mrp_amount": "case when p_partkey % 13 = 0 then 0.0 else p_retailprice end", "tax_phrase": "p_partkey % 4 <> 0", "mrp_conflict": "p_partkey % 31 = 0", "mrp_uncertain": "p_partkey % 37 = 0",
    "phone": "case when p_partkey % 3 = 0 then '' else '1800' end", "email": "case when p_partkey % 9 = 0 then 'a@b.in' else '' end",
    "maker_name": "case when p_partkey % 8 < 3 then '' else 'Acme Ltd' end", "maker_address": "case when p_partkey % 8 = 1 then '' when p_partkey % 8 = 5 then 'Aqua, Glycerin' else 'Plot 4' end",
    "maker_pin": "case when p_partkey % 4 = 3 then '201301' else '' end", "marketer_name": "case when p_partkey % 11 < 5 then 'Zen' else '' end", "marketer_pin": "case when p_partkey % 11 < 3 then '122015' else '' end",
    "degraded": "p_partkey % 41 = 0", "front_only": "p_partkey % 14 = 1", "height_calibrated": "p_partkey % 12 <> 0", "height_ok": "p_partkey % 15 <> 0",
}
_FACT_SQL = ", ".join(f"{e} as {n}" for n, e in FACT.items())


def facts(spark, d):
    return table(spark, d, "part").selectExpr(*[f"{e} as {n}" for n, e in FACT.items()])


def _w(words):
    return q.any_contains("low", words)


_MATRIX = {
    "RULE 3": "case when net_value > 25 and net_unit in ('kg', 'l') then 'NOT APPLICABLE' else 'PASS' end",
    "RULE 4": "case when product_name <> '' then 'PASS' when degraded then 'NEEDS REVIEW' else 'FAIL' end",
    "RULE 6(1)(a)": "case when maker_name <> '' then (case when maker_pin <> '' then 'PASS' else 'FAIL' end) when marketer_name <> '' then (case when marketer_pin <> '' then 'NEEDS REVIEW' else 'FAIL' end) when maker_address = '' and (degraded or front_only) then 'NEEDS REVIEW' else 'FAIL' end",
    "RULE 6(1)(b)": "case when commodity_name <> '' then 'PASS' else 'FAIL' end",
    "RULE 6(1)(c)": "case when net_conflict then 'NEEDS REVIEW' when net_value = 0 then (case when degraded then 'NEEDS REVIEW' else 'FAIL' end) when net_prohibited then 'FAIL' else 'PASS' end",
    "RULE 6(1)(d)": "case when micro and not pan then 'NOT APPLICABLE' when mfd_uncertain then 'NEEDS REVIEW' when pkd <> '' or mfd <> '' then 'PASS' when degraded or front_only then 'NEEDS REVIEW' else 'FAIL' end",
    "RULE 6(1)(da)": "case when expiry <> '' then 'PASS' else 'NOT APPLICABLE' end",
    "RULE 6(1)(e)": "case when mrp_conflict or mrp_uncertain then 'NEEDS REVIEW' when mrp_amount = 0 then (case when degraded then 'NEEDS REVIEW' else 'FAIL' end) when tax_phrase then 'PASS' else 'FAIL' end",
    "RULE 6(1)(f)": "case when micro and not pan then 'NOT APPLICABLE' when phone <> '' or email <> '' then 'PASS' when degraded or front_only then 'NEEDS REVIEW' else 'FAIL' end",
    "RULE 7": f"case when {_w(ck.MEDICAL)} then 'PASS' when not height_calibrated then 'NEEDS REVIEW' when height_ok then 'PASS' else 'FAIL' end",
    "RULE 10": "case when maker_address = '' then (case when (marketer_name <> '' and marketer_pin <> '') or degraded or front_only then 'NEEDS REVIEW' else 'FAIL' end) when maker_pin <> '' then 'PASS' else 'FAIL' end",
    "RULE 13": "case when net_value > 0 and not net_prohibited then 'PASS' else 'FAIL' end", "RULE 33": "'NOT APPLICABLE'",
    "RULE 26(a)": "case when micro then 'PASS' else 'NOT APPLICABLE' end", "RULE 26(e)": f"case when {_w(ck.GARMENT)} then 'PASS' else 'NOT APPLICABLE' end",
    "RULE 6(1) PROVISO": f"case when {_w(ck.ELECTRONIC)} then 'PASS' else 'NOT APPLICABLE' end", "RULE PAN MASALA": "case when pan then 'PASS' else 'NOT APPLICABLE' end",
    "SOP EDIBLE OIL": f"case when {_w(ck.EDIBLE_OIL)} then 'PASS' else 'NOT APPLICABLE' end", "RULE GSR 226(E)": f"case when {_w(ck.MEDICAL)} then 'PASS' else 'NOT APPLICABLE' end",
    **{r: "'PASS'" for r in ck.ALWAYS_PASS},
}
WITH_CHECKS = f"""with f0 as (select {_FACT_SQL} from part),
f1 as (select *, lower(concat_ws(' ', commodity_name, product_name)) as low, net_value > 0 and net_value <= 10 and net_unit in ('g', 'ml') as micro from f0), f as (select *, {_w(ck.PAN_MASALA)} as pan from f1),
raw as ({' union all '.join(f"select id, '{r}' as rule_no, {e} as status, degraded, marketer_name, marketer_pin, maker_address from f" for r, e in _MATRIX.items())}),
own as (select id, rule_no, case when status = 'FAIL' and degraded then 'NEEDS REVIEW' when status = 'FAIL' and rule_no in ('RULE 6(1)(a)', 'RULE 10') and ((marketer_name <> '' and marketer_pin <> '') or maker_address like 'Aqua%') then 'NEEDS REVIEW' else status end as status from raw),
n as (select id, count(*) filter (status = 'FAIL') as fails from own group by 1),
checks as (select * from own union all select id, 'RULE 32', case when fails > 0 then 'FAIL' else 'PASS' end from n union all select id, 'RULE 32A', case when fails > 0 then 'FAIL' else 'PASS' end from n),
s as (select id, count(*) filter (status = 'PASS') as passed, count(*) filter (status = 'FAIL') as failed, count(*) filter (status = 'NEEDS REVIEW') as reviews from checks group by 1)
"""


def checks(spark, d):
    return ck.settle(ck.statutory_checks(facts(spark, d), "id"), "id")


@query("statutory_checks", "R8 R9 R10 R11", WITH_CHECKS + "select id, rule_no, status from checks")
def statutory_checks(spark, d):
    return checks(spark, d)


@query("compliance_scores", "R12", WITH_CHECKS + """
select id, passed, failed, reviews, cast(round_even(passed * 100.0::double / greatest(1, passed + failed), 0) as int) as score, case when failed > 0 then 'NON_COMPLIANT' when reviews > 0 then 'NEEDS_REVIEW' else 'COMPLIANT' end as overall_status,
 cast(case when failed > 0 then greatest(20, 100 - failed * 12) when reviews > 0 then 80 else 100 end as int) as penalty_score,
 cast(case when failed = 0 and reviews > 0 then least(85, round_even(passed * 100.0::double / greatest(1, passed + failed), 0)) else round_even(passed * 100.0::double / greatest(1, passed + failed), 0) end as int) as capped_score from s""")
def compliance_scores(spark, d):
    g = ck.check_counts(checks(spark, d), "id")
    return g.select("id", "passed", "failed", "reviews", "overall_status", ck.score().alias("score"),
                    ck.score("penalty").alias("penalty_score"), ck.score("capped").alias("capped_score"))


@query("dossiers", "R20", WITH_CHECKS + """
select id, coalesce(string_agg(rule_no, '; ' order by rule_no) filter (status = 'FAIL'), '') as violated_rules, coalesce(string_agg(rule_no, '; ' order by rule_no) filter (status = 'NEEDS REVIEW'), '') as review_rules,
  case when count(*) filter (status = 'FAIL') > 0 then 'NON_COMPLIANT' when count(*) filter (status = 'NEEDS REVIEW') > 0 then 'NEEDS_REVIEW' else 'COMPLIANT' end as overall_status from checks group by 1""")
def dossiers(spark, d):
    return ck.dossier(checks(spark, d), "id").drop("compliant_rules")


@query("check_filter", "P17", WITH_CHECKS + "select id, rule_no from checks where status = 'NEEDS REVIEW' and contains(lower(rule_no), '6(1)')")
def check_filter(spark, d):
    c = checks(spark, d).withColumn("sub_rule", F.lit("")).withColumn("title", F.lit(""))
    return fl.check_list(c, "6(1)", status="NEEDS_REVIEW").select("id", "rule_no")


@query("client_applicability", "R13", r"""
with p as (select p_partkey as id, p_size, case p_size % 3 when 0 then cast(p_size as varchar) || ' kg' when 1 then cast(p_size * 100 as varchar) || ' g' else cast(p_size as varchar) || ' ml' end as net,
  case p_partkey % 4 when 0 then 'Tea biscuit' when 1 then 'Towel' when 2 then 'Pack of 3 soap' else 'Cable' end as nm from part)
select id, 'RULE-3' as rule_id, not (p_size % 3 <> 1 and p_size > 25) as applicable from p
union all select id, 'RULE-5', nm = 'Tea biscuit' from p union all select id, 'RULE-6-1-DA', nm in ('Tea biscuit', 'Pack of 3 soap') from p
union all select id, 'RULE-6-11', nm = 'Pack of 3 soap' or not ((p_size % 3 = 1 and p_size * 100 < 1000) or (p_size % 3 = 2 and p_size < 1000) or (p_size % 3 = 2 and p_size <= 1) or (p_size % 3 = 0 and p_size <= 1)) from p
union all select id, 'RULE-6-1-G', nm in ('Towel', 'Cable') from p union all select id, unnest(['RULE-14', 'RULE-15']), nm = 'Pack of 3 soap' from p
union all select id, 'RULE-6-1-A', true from p union all select id, unnest(['RULE-7', 'RULE-16', 'RULE-24']), false from p
union all select id, 'RULE-26', p_size % 3 <> 1 and p_size % 3 = 2 and p_size <= 10 or (p_size % 3 = 0 and p_size <= 10) or (p_size % 3 = 1 and p_size * 100 <= 10) from p""")
def client_applicability(spark, d):
    size = F.col("p_size")
    net = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(" kg"))).when(size % 3 == 1, F.concat((size * 100).cast("string"), F.lit(" g"))).otherwise(F.concat(size.cast("string"), F.lit(" ml")))
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Tea biscuit").when(k == 1, "Towel").when(k == 2, "Pack of 3 soap").otherwise("Cable")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), net.alias("net"), name.alias("nm"))
    p = p.withColumn("a", cl.product_attributes(F.col("nm"), F.col("net"), F.lit("India"), F.lit(""), F.lit(""), F.lit("")))
    return p.select("id", F.inline(ck.client_applicability(F.col("a"), F.col("net"), F.col("nm"))))


@query("client_checks", "R14", """
with p as (select p_partkey as id, p_size, p_partkey as k from part)
select id, 'RULE-5' as rule_id, case when p_size in (25, 50) then 'PASS' else 'NEEDS REVIEW' end as status from p
union all select id, 'RULE-6-1-A', case when k % 3 = 0 then 'PASS' when k % 3 = 1 then 'NEEDS REVIEW' else 'FAIL' end from p
union all select id, 'RULE-6-1-B', 'PASS' from p union all select id, 'RULE-6-1-C', case when k % 2 = 0 then 'PASS' else 'FAIL' end from p
union all select id, 'RULE-6-1-D', case when k % 4 = 0 then 'NEEDS REVIEW' else 'PASS' end from p union all select id, 'RULE-6-1-DA', 'NEEDS REVIEW' from p
union all select id, 'RULE-6-1-E', case k % 3 when 0 then 'PASS' when 1 then 'NEEDS REVIEW' else 'FAIL' end from p union all select id, 'RULE-6-11', 'FAIL' from p
union all select id, 'RULE-6-1-F', 'PASS' from p union all select id, 'RULE-6-1-G', 'FAIL' from p union all select id, 'RULE-10', case when k % 3 = 0 then 'PASS' when k % 3 = 1 then 'NEEDS REVIEW' else 'FAIL' end from p""")
def client_checks(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    none = F.lit("")
    m3 = k % 3
    arr = ck.client_checks(
        net=F.when(k % 2 == 0, F.concat(size, F.lit(" g"))).otherwise(F.concat(size, F.lit(" gms when packed"))),
        mrp_text=F.when(m3 == 0, "MRP Rs 10 inclusive of all taxes").when(m3 == 1, "Rs 10 Rs 20 Rs 30").otherwise("MRP Rs 10"), tax_text=none,
        maker=F.when(m3 == 1, "").otherwise("Acme"), address=F.when(m3 == 0, "Plot 4 Noida 201301").when(m3 == 1, "").otherwise("Plot 4 Noida"), marketer=F.lit("Zen"), marketer_pin=F.lit("122015"),
        packer=none, packer_address=none, mfd=F.when(k % 4 == 0, "0?/2024").otherwise("05/2024"), expiry=none, usp=none, phone=F.lit("1800"), dims=none, generic=F.lit("Tea"))
    return table(spark, d, "part").select(k.alias("id"), F.inline(arr))


@query("adaptive_schema", "R15", f"""
with t(category, field_name, relevance) as (values ('ECONOMY', 'INGREDIENTS', 0.95), ('ECONOMY', 'MODEL_NUMBER', 0.05), ('PROMO', 'MODEL_NUMBER', 0.9), ('PROMO', 'BRAND', 0.4)),
c as (select p_partkey as product_id, p_type as category, unnest({q.array(ck.CORE_FIELDS)}) as field_name from part),
x as (select product_id, field_name, coalesce(t.relevance, 0.95)::double as relevance from c left join t using (category, field_name)
  union select p_partkey, t.field_name, t.relevance::double from part join t on t.category = p_type where t.field_name not in {ck.CORE_FIELDS}),
e as (select p_partkey as product_id, 'BRAND' as field_name, p_brand as value, case p_size % 3 when 0 then 'CONFIRMED' when 1 then 'AMBIGUOUS' else 'OTHER' end as st, 0.9::double as confidence from part
  union all select p_partkey, 'EXTRA_FIELD', 'x', 'CONFIRMED', 0.8::double from part where p_size % 5 = 0)
select product_id, field_name, value, coalesce(case st when 'CONFIRMED' then 'PRESENT' when 'AMBIGUOUS' then 'NEEDS_REVIEW' when 'OTHER' then 'UNKNOWN' end, case when relevance >= 0.15 then 'NOT_VISIBLE' else 'NOT_APPLICABLE' end) as status,
  coalesce(relevance, 0.5::double) as relevance, coalesce(confidence, 0.0::double) as confidence, x.product_id is not null as expected from x full join e using (product_id, field_name)""")
def adaptive_schema(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    t = spark.createDataFrame([("ECONOMY", "INGREDIENTS", 0.95), ("ECONOMY", "MODEL_NUMBER", 0.05), ("PROMO", "MODEL_NUMBER", 0.9), ("PROMO", "BRAND", 0.4)], "category string, field_name string, relevance double")
    e = p.select(F.col("p_partkey").alias("product_id"), F.lit("BRAND").alias("field_name"), F.col("p_brand").alias("value"),
                 F.when(size % 3 == 0, "CONFIRMED").when(size % 3 == 1, "AMBIGUOUS").otherwise("OTHER").alias("status"), F.lit(0.9).alias("confidence"))
    extra = p.filter("p_size % 5 = 0").select(F.col("p_partkey").alias("product_id"), F.lit("EXTRA_FIELD").alias("field_name"), F.lit("x").alias("value"), F.lit("CONFIRMED").alias("status"), F.lit(0.8).alias("confidence"))
    return ck.adaptive_schema(p.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category")), e.unionByName(extra), t)


@query("risk_scores", "R17", """
with s as (select event_id, value % 100 / 100 as o, event_id % 3 <> 0 as u, event_id % 5 <> 0 as t, event_id % 7 = 0 as v, event_id % 11 = 0 as b from events),
r as (select *, least(1.0::double, round((case when b then 0.4::double else 0 end) + (case when o < 0.7 then 0.3::double else 0 end) + (case when u then 0 else 0.35::double end) + (case when t then 0 else 0.3::double end) + (case when v then 0.3::double else 0 end), 2)) as score from s)
select event_id, score, case when score >= 0.6 then 'HIGH' when score >= 0.35 then 'MEDIUM' else 'LOW' end as rating, score >= 0.4 or o < 0.75 or b as review, cast(b::int + (o < 0.7)::int + (not u)::int + (not t)::int as int) as reasons from r""")
def risk_scores(spark, d):
    k = F.col("event_id")
    v = table(spark, d, "events").select("event_id", ck.risk(F.col("value") % 100 / 100, k % 3 != 0, k % 5 != 0, k % 7 == 0, k % 11 == 0).alias("r"))
    return v.select("event_id", "r.score", "r.rating", "r.review", F.size("r.reasons").alias("reasons"))


@query("image_quality", "R19", """
with m as (select event_id, value, (event_id % 97) * 1.0123::double as a, (event_id % 89) * 1.0071::double as b, (event_id % 53)::double as c from events),
s as (select *, round(a * 0.3::double + b * 0.2::double + c * 0.15::double + 90 * 0.15::double + 80 * 0.1::double + a * 0.1::double, 1) as score from m)
select event_id, score, case when a < 20 or c > 45 or score < 30 then 'INSUFFICIENT' when score < 70 then 'DEGRADED' else 'GOOD' end as status,
 cast(greatest(15, least(99, round_even(least(30.0::double, a / 150.0 * 30.0) + greatest(0.0::double, 20.0 - abs(b - 140.0) / 140.0 * 20.0) + least(20.0::double, c / 50.0 * 20.0) + 15.0 + greatest(0.0::double, 15.0 - 1.5 - b / 30.0), 0))) as int) as points from s""")
def image_quality(spark, d):
    k = F.col("event_id")
    m = table(spark, d, "events").select("event_id", ((k % 97) * F.lit(1.0123)).alias("a"), ((k % 89) * F.lit(1.0071)).alias("b"), (k % 53).cast("double").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    g = ck.quality_gate(a, b, c, F.lit(90.0), F.lit(80.0), a, a, F.lit(0.0), F.lit(500), c, F.lit(0))
    v = m.select("event_id", g.alias("g"), ck.quality_points(a, b, c, F.lit(1.5), F.lit(1.0), b, F.lit(False)).alias("points"))
    return v.select("event_id", "g.score", "g.status", "points")


@query("numeral_heights", "R18", """
with r as (select l_orderkey as image_id, min(case when l_linenumber = 1 then l_quantity * 5 + 20 end) as bar, min(case when l_linenumber = 2 then l_quantity end) as net from lineitem group by 1),
h as (select image_id, case when bar > 40 and net is not null then greatest(1.0::double, least(12.0::double, round(net * 0.5::double / (bar / 37.29::double), 2))) end as height_mm from r)
select image_id, height_mm is not null as calibrated, height_mm, coalesce(height_mm >= 2.0, true) as complies from h""")
def numeral_heights(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("qn"))
    n = F.col("l_linenumber")
    r = li.select(F.col("l_orderkey").alias("image_id"), n.alias("ord"), F.when(n == 1, "Barcode").when(n == 2, "Net Quantity panel").otherwise("Text").alias("category"), (F.col("qn") * 5 + 20).alias("w"), F.col("qn").alias("h"))
    return ck.numeral_height(r)


@query("pin_validation", "J24 P19", """
with s as (select n_name as state, n_nationkey as k from nation),
p as (select c_custkey as id, n_name as state, c_nationkey as k, case c_custkey % 7 when 0 then '' when 1 then '12a456' when 2 then '12345' when 3 then '012345' else cast(10 + (c_nationkey + case when c_custkey % 7 = 5 then 1 else 0 end) % 25 as varchar) || lpad(cast(c_custkey % 10000 as varchar), 4, '0') end as pin from customer join nation on n_nationkey = c_nationkey)
select id, pin, case c_m when 0 then 'PIN Code is required.' when 1 then 'Only numbers are accepted.' when 2 then 'PIN Code must contain exactly 6 digits.' when 3 then 'Invalid Indian PIN code prefix.'
  when 5 then 'PIN Code does not match the selected location. (belongs to ' || (select state from s where s.k = (p2.k + 1) % 25) || ')' end as error, c_m in (4, 6) as is_valid,
  case when c_m in (4, 6) and substr(pin, 3, 1) <> '1' then 'Note: PIN ' || pin || ' is usually outside primary postal sub-circle for Centre.' end as warning from (select *, id % 7 as c_m from p) p2""")
def pin_validation(spark, d):
    nation = table(spark, d, "nation")
    p2 = (10 + F.col("n_nationkey") % 25).cast("string")
    states = nation.select(F.col("n_name").alias("state"), F.array(p2).alias("pin_prefixes"), F.create_map(F.lit("Centre"), F.array(F.concat(p2, F.lit("1")))).alias("district_overrides"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    m = F.col("c_custkey") % 7
    pin = F.when(m == 0, "").when(m == 1, "12a456").when(m == 2, "12345").when(m == 3, "012345").otherwise(
        F.concat((10 + (F.col("c_nationkey") + F.when(m == 5, 1).otherwise(0)) % 25).cast("string"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")))
    pins = c.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("state"), F.lit("Centre").alias("district"), pin.alias("pin"))
    return ck.validate_pins(pins, states).select("id", "pin", "error", "is_valid", "warning")


@query("district_typeahead", "P19", """
select n_name as state, coalesce(string_agg(dname, ',' order by dname), '') as districts from (select n_name, unnest([n_name || ' North', n_name || ' South', 'Port ' || n_name]) as dname from nation) where contains(lower(dname), 'north') or contains(lower(dname), 'port') group by 1""".replace("contains(lower(dname), 'north') or contains(lower(dname), 'port')", "contains(lower(dname), 'ort')"))
def district_typeahead(spark, d):
    n = F.col("n_name")
    states = table(spark, d, "nation").select(n.alias("state"), F.array(F.concat(n, F.lit(" North")), F.concat(n, F.lit(" South")), F.concat(F.lit("Port "), n)).alias("districts"))
    return fl.district_typeahead(states, "ORT").select("state", F.array_join(F.sort_array("districts"), ",").alias("districts"))
