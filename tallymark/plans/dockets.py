"""Dashboards, registers, searches and docket storage over orders and line items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymark.operators import analytics as an
from tallymark.operators import filters as fl
from tallymark.plans.inputs import WITH_DOCKETS, dockets, violations
from tallymark.plans.registry import query, table
from tallymark.session import checkpoint_dir
from tallymark.sources import dockets as store

DAY = "yyyy-MM-dd"


@query("kpi_card", "A1", WITH_DOCKETS + """
select count(*) as total_scans,
  count(*) filter (overall_status = 'COMPLIANT') as compliant_count,
  count(*) filter (overall_status = 'NON_COMPLIANT') as non_compliant_count,
  count(*) filter (overall_status = 'NEEDS_REVIEW') as review_count,
  cast(sum(violation_count) as bigint) as violations_count,
  round(count(*) filter (overall_status = 'COMPLIANT') * 100.0::double / count(*), 1) as compliance_rate
from dockets""")
def kpi_card(spark, d):
    return an.kpi_card(dockets(spark, d, counts=True))


@query("recent_dockets", "W13 A1", WITH_DOCKETS + """
select id, product_name, overall_status, cast(compliance_score as bigint) as compliance_score, strftime(created_at, '%Y-%m-%d') as created_on
from dockets order by created_at desc, ord limit 5""")
def recent_dockets(spark, d):
    top = an.recent(dockets(spark, d), "created_at", "ord", 5)
    return top.select("id", "product_name", "overall_status", F.col("compliance_score").cast("bigint").alias("compliance_score"),
                      F.date_format("created_at", DAY).alias("created_on"))


@query("status_breakdown", "A2 P9", WITH_DOCKETS + """
, c as (select count(*) as total, count(*) filter (status = 'Compliant') as a, count(*) filter (status = 'Non-Compliant') as b,
  count(*) filter (status = 'Under Review') as r from dockets)
select 'Compliant Packages' as name, a as value, round(a * 100.0::double / total, 1) as rate from c
union all select 'Non-Compliant (Violations)', b, round(b * 100.0::double / total, 1) from c
union all select 'Under Officer Review', r, round(r * 100.0::double / total, 1) from c""")
def status_breakdown(spark, d):
    df = dockets(spark, d).withColumn("status", fl.status_label(F.col("overall_status")))
    return an.status_breakdown(df)


@query("monthly_timeline", "A3", WITH_DOCKETS + """
select strftime(created_at, '%Y-%m') as month, count(*) as total, count(*) filter (status = 'Compliant') as compliant,
  cast(sum(case when status = 'Non-Compliant' then greatest(violation_count, 1) else 0 end) as bigint) as violations
from dockets group by 1""")
def monthly_timeline(spark, d):
    return an.monthly_timeline(dockets(spark, d, counts=True))


@query("infraction_distribution", "A4", WITH_DOCKETS + """
, c as (select case when rule_reference <> '' then rule_reference || ' — ' || violation_type else violation_type end as infraction,
  count(*) as n from violations group by 1)
select infraction, n, round(n * 100.0::double / (select sum(n) from c), 1) as share from c""")
def infraction_distribution(spark, d):
    return an.infraction_distribution(violations(spark, d))


@query("top_infractions", "A5", WITH_DOCKETS + """
, c as (select coalesce(nullif(rule_reference, ''), violation_type) as infraction, count(*) as n from violations group by 1)
select infraction, n, round(n * 100.0::double / (select sum(n) from c), 1) as share from c order by n desc, infraction limit 5""")
def top_infractions(spark, d):
    return an.top_infractions(violations(spark, d), 5, full_label=False)


@query("violations_by_category", "A6", WITH_DOCKETS + """
, c as (select coalesce(nullif(category, ''), 'General') as category,
  cast(sum(case when violation_count > 0 then violation_count when status = 'Non-Compliant' then 1 else 0 end) as bigint) as violations
  from dockets group by 1)
select category, violations, violations * 25000 as compounding_fines from c""")
def violations_by_category(spark, d):
    return an.violations_by_category(dockets(spark, d, parties=True, counts=True))


@query("zone_caseload", "A7", WITH_DOCKETS + """
select coalesce(nullif(zone, ''), 'Default Zone') as zone, count(*) as inspections, count(*) filter (status = 'Compliant') as compliant,
  round(count(*) filter (status = 'Compliant') * 100.0::double / count(*), 1) as compliance_rate
from dockets group by 1""")
def zone_caseload(spark, d):
    return an.zone_caseload(dockets(spark, d, parties=True))


@query("port_detentions", "A8", WITH_DOCKETS + """
select count(*) filter (inspection_type = 'Port of Entry Inward' and status = 'Non-Compliant') as port_detentions,
  cast(sum(violation_count) as bigint) as violations, cast(sum(violation_count) * 25000 as bigint) as compounding_total
from dockets""")
def port_detentions(spark, d):
    return an.port_detentions(dockets(spark, d, counts=True))


@query("product_catalogue", "A9 P4", WITH_DOCKETS + """
, c as (select coalesce(nullif(barcode, ''), product_name) as product_key, arg_min(id, ord) as id, arg_min(product_name, ord) as name,
  arg_min(barcode, ord) as barcode, arg_min(brand, ord) as brand, arg_min(category, ord) as category, arg_min(manufacturer, ord) as manufacturer,
  arg_min(status, ord) as compliance_status, strftime(arg_min(created_at, ord), '%Y-%m-%d') as last_inspection,
  cast(sum(violation_count) as bigint) as total_violations, count(*) as records from dockets group by 1)
select * from c where contains(lower(name), 'product') and compliance_status = 'Compliant'""")
def product_catalogue(spark, d):
    cat = an.product_catalogue(dockets(spark, d, parties=True, counts=True))
    cat = cat.withColumn("last_inspection", F.date_format("last_inspection_at", DAY)).drop("last_inspection_at")
    return fl.product_catalogue_filter(cat, "PRODUCT", status="Compliant")


@query("product_register", "A19", WITH_DOCKETS + """
select product_name, count(*) as total_audits, count(*) filter (status = 'Non-Compliant') as total_violations,
  case when bool_or(status = 'Non-Compliant') then 'High' else 'Low' end as market_risk_rating,
  arg_max(status, strftime(created_at, '%Y-%m-%d') || lpad(cast(ord as varchar), 12, '0')) as compliance_status,
  max(strftime(created_at, '%Y-%m-%d')) as last_inspection,
  arg_max(id, strftime(created_at, '%Y-%m-%d') || lpad(cast(ord as varchar), 12, '0')) as last_inspection_id
from dockets group by 1""")
def product_register(spark, d):
    reg = an.product_register(dockets(spark, d))
    return reg.withColumn("last_inspection", F.date_format("last_inspection_at", DAY)).drop("last_inspection_at")


@query("violation_registry", "A10 P3", WITH_DOCKETS + """
select v.violation_id, v.case_id, v.rule_reference, v.violation_type, v.severity, x.officer_name as officer, x.product_name,
  strftime(x.created_at, '%Y-%m-%d') as inspection_date
from violations v join dockets x on x.id = v.case_id
where v.severity = 'High' and (contains(lower(v.violation_type), 'unit') or contains(lower(v.rule_reference), 'unit')
  or contains(lower(x.product_name), 'unit') or contains(lower(v.violation_id), 'unit'))""")
def violation_registry(spark, d):
    flat = an.flatten_violations(dockets(spark, d), violations(spark, d))
    flat = flat.withColumn("inspection_date", F.date_format("inspection_date", DAY))
    return fl.violation_registry(flat, "UNIT", "High")


@query("inspection_history", "P1 P2", WITH_DOCKETS + """
select id, product_name, brand, manufacturer, status, category, officer_name from dockets
where (contains(lower(id), '12') or contains(lower(product_name), '12') or contains(lower(brand), '12')
   or contains(lower(manufacturer), '12') or contains(lower(barcode), '12'))
  and status = 'Non-Compliant' and contains(officer_name, '3')""")
def inspection_history(spark, d):
    kept = fl.inspection_history(dockets(spark, d, parties=True), "12", status="Non-Compliant", officer="3")
    return kept.select("id", "product_name", "brand", "manufacturer", "status", "category", "officer_name")


@query("transcript_search", "P1 S9", """
select doc_id, lang, source from documents where contains(lower(text), 'license') or contains(lower(source), 'license')""")
def transcript_search(spark, d):
    docs = table(spark, d, "documents")
    return fl.search_dockets(docs, "LICENSE", ("text", "source")).select("doc_id", "lang", "source")


@query("search_index", "S9 P1", """
select o_orderkey as scan_id, o_orderstatus as overall_status, o_clerk as manufacturer from (select *, 'Clerk ' || cast(o_custkey % 40 as varchar) as o_clerk from orders) where contains(lower(o_clerk), 'clerk 3')""")
def search_index(spark, d):
    """Scans are appended in two writes to an index in the shared folder, which is then searched."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scan_id"), F.lit("Product").alias("product_name"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 40).cast("string")).alias("manufacturer"), F.lit("").alias("ocr_text"),
        F.col("o_orderstatus").alias("overall_status"), F.lit(100).alias("compliance_score"), F.col("o_orderdate").cast("string").alias("ts"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    for late in (False, True):
        store.append_search_rows(rows.filter((F.col("o_orderstatus") == "P") == late), path)
    return fl.search_dockets(spark.read.parquet(path), "CLERK 3", ("manufacturer", "product_name")).select("scan_id", "overall_status", "manufacturer")


@query("docket_page", "A11", WITH_DOCKETS + """
select id, product_name, status, strftime(created_at, '%Y-%m-%d') as created_on from dockets order by created_at desc, ord limit 50 offset 100""")
def docket_page(spark, d):
    out = an.page(dockets(spark, d), "created_at", "ord", 50, 100)
    return out.select("id", "product_name", "status", F.date_format("created_at", DAY).alias("created_on"))


@query("notice_candidates", "P18", WITH_DOCKETS + """
select category, count(*) as dockets, cast(sum(violation_count) as bigint) as violations from dockets
where status = 'Non-Compliant' or violation_count > 0 group by 1""")
def notice_candidates(spark, d):
    kept = fl.notice_candidates(dockets(spark, d, parties=True, counts=True))
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("dockets"), F.sum("violation_count").cast("bigint").alias("violations"))


@query("header_counters", "A18", WITH_DOCKETS + """
select count(*) filter (status = 'Under Review') as pending_reviews, count(*) filter (status = 'Non-Compliant') as violations,
  greatest(2, count(*) filter (status = 'Under Review') + (case when count(*) filter (status = 'Non-Compliant') > 0 then 1 else 0 end)) as total_notifications
from dockets""")
def header_counters(spark, d):
    return an.notification_counts(dockets(spark, d))


@query("audit_log_filter", "P5 P8 P17", """
select event_type as module, count(*) as n, cast(count(distinct user_id) as bigint) as officers from events
where (contains(lower(props), 'a') or contains(lower(event_type), 'a')) and event_type <> 'view' group by 1""")
def audit_log_filter(spark, d):
    ev = table(spark, d, "events").select(
        F.col("event_type").alias("module"), F.col("event_type").alias("action"), F.lit("").alias("officer_name"),
        F.lit("").alias("record_id"), F.col("props").alias("details"), F.lit("Success").alias("status"), "user_id")
    kept = fl.audit_log_filter(ev, "A", status="Success").filter(F.col("module") != "view")
    return kept.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("officers"))


@query("facet_values", "P8 P16", "select distinct source as facet from documents union select distinct lang from documents")
def facet_values(spark, d):
    docs = table(spark, d, "documents")
    return fl.facet(docs.select(F.col("source").alias("facet")).unionByName(docs.select(F.col("lang").alias("facet"))), "facet")


@query("audit_csv_lines", "S10", r"""
select event_id, '"' || cast(event_id as varchar) || '","' || event_type || '","' || replace(props, '"', '""') || '"' as csv_line from events""")
def audit_csv_lines(spark, d):
    return table(spark, d, "events").select("event_id", store.csv_line("event_id", "event_type", "props").alias("csv_line"))


@query("docket_upsert", "S6", """
select o_custkey as id, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as seq,
  arg_max(o_orderpriority, o_orderkey) as priority from orders group by 1""")
def docket_upsert(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    old = rows.filter(F.col("seq") % 2 == 0)
    new = rows.filter(F.col("seq") % 2 == 1)
    return store.upsert(old, new, "id", "seq")


@query("docket_delete", "S7", """
select l_returnflag, count(*) as kept from lineitem
where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'P') group by 1""")
def docket_delete(spark, d):
    dead = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    out = store.cascade_delete(dead, "id", {"violations": (table(spark, d, "lineitem"), "l_orderkey")})
    return out["violations"].groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"))


@query("docket_lookup", "S8", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 4242")
def docket_lookup(spark, d):
    rows = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    return store.by_id(rows, 4242).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("docket_json_read", "S5 P11", """
select case when o_orderkey % 10 <> 9 then cast(o_orderkey as varchar) end as id,
  case when o_orderkey % 5 = 0 or o_orderkey % 10 = 9 then 'Packaged Commodity' else 'Product ' || cast(o_orderkey % 97 as varchar) end as product_name,
  case when o_orderkey % 4 = 0 or o_orderkey % 10 = 9 then 'COMPLIANT' else o_orderstatus end as overall_status,
  case when o_orderkey % 2 = 0 then cast(o_orderkey % 101 as bigint) else 100 end as compliance_score
from orders""")
def docket_json_read(spark, d):
    o = table(spark, d, "orders")
    body = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("scan_id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Product "), (F.col("o_orderkey") % 97).cast("string"))).alias("productName"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).otherwise(F.lit("")).alias("overall_status"),
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 101).cast("int")).alias("compliance_score")))
    raw = o.select(F.when(F.col("o_orderkey") % 10 == 9, F.lit("{broken")).otherwise(body).alias("docket_json"))
    rows = store.docket_row(store.parse_dockets(raw))
    return rows.select("id", "product_name", "overall_status", F.col("compliance_score").cast("bigint").alias("compliance_score"))


@query("inspection_records", "S13 S12", """
select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%d') as date,
  case when o_orderstatus = 'O' then 'VIO-DB-RULE 13-0' else '' end as violation_ids, 'Draft' as final_decision
from orders where not exists (select 1 from customer where c_custkey = o_orderkey)""")
def inspection_records(spark, d):
    o = table(spark, d, "orders")
    check = lambda s: F.struct(
        F.lit("RULE 13").alias("rule_no"), F.lit("13(2)").alias("sub_rule"), F.lit("Units").alias("rule_title"), s.alias("status"))
    body = F.to_json(F.struct(F.array(
        check(F.lit("PASS")), check(F.when(F.col("o_orderstatus") == "O", "FAIL").otherwise("PASS"))).alias("compliance_checks")))
    api = store.parse_dockets(o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"), F.lit("").alias("product_name"),
        F.lit("").alias("manufacturer"), F.lit("Compliant").alias("status"), F.lit(0).alias("compliance_score"), body.alias("docket_json")))
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    out = store.add_late_columns(store.inspection_records(api, known), {"final_decision": "Draft"})
    return out.select("id", "date", F.array_join(F.col("violations.violation_id"), ",").alias("violation_ids"), "final_decision")


@query("annotation_export", "S11", """
select cast(p_partkey as varchar) as scan_id,
 '{"version":"5.0.1","imagePath":"img_' || cast(p_partkey as varchar) || '","shapes":[{"label":"' || p_brand || '","points":[' || cast(p_size as varchar) || ',0]},{"label":"'
 || p_type || '","points":[0,' || cast(p_size as varchar) || ']}]}' as document from part""")
def annotation_export(spark, d):
    p = table(spark, d, "part")
    shape = lambda name, pts: F.struct(name.alias("label"), pts.alias("points"))
    scans = p.select(
        F.col("p_partkey").cast("string").alias("scan_id"), F.concat(F.lit("img_"), F.col("p_partkey").cast("string")).alias("image_id"),
        F.array(shape(F.col("p_brand"), F.array(F.col("p_size"), F.lit(0))), shape(F.col("p_type"), F.array(F.lit(0), F.col("p_size")))).alias("shapes"))
    return store.annotation_json(scans)


@query("evidence_lookup", "P10", """
select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey = 77 and (l_linenumber = 2 or l_partkey = 2)""")
def evidence_lookup(spark, d):
    ev = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("scan_id"),
                                            F.col("l_linenumber").alias("region_id"), F.col("l_partkey").alias("image_id"))
    return fl.evidence_lookup(ev, 77, 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("report_summary", "A12 A13", """
with c as (select l_orderkey as scan_id, case when l_discount > 0.08 then 'FAIL' when l_discount > 0.06 then 'NEEDS REVIEW' when l_tax > 0.06 then 'NOT APPLICABLE' else 'PASS' end as status from lineitem)
select scan_id, count(*) as total_rules_evaluated, count(*) filter (status = 'FAIL') as infractions_count,
  count(*) filter (status = 'NEEDS REVIEW') as needs_review_count, count(*) filter (status = 'FAIL') > 0 as notice_issuance_recommended,
  count(*) filter (status = 'PASS') as pass_count, count(*) filter (status = 'NOT APPLICABLE') as not_applicable_count
from c group by 1""")
def report_summary(spark, d):
    status = (F.when(F.col("l_discount") > 0.08, "FAIL").when(F.col("l_discount") > 0.06, "NEEDS REVIEW")
              .when(F.col("l_tax") > 0.06, "NOT APPLICABLE").otherwise("PASS"))
    checks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), status.alias("status"))
    counts = an.check_status_counts(checks).select("scan_id", "pass_count", "not_applicable_count")
    return an.report_summary(checks).join(counts, "scan_id")


@query("stage_latency", "A17", """
select event_type as stage, count(*) as runs, round(avg(value), 4) as mean_ms, max(value) as max_ms from events group by 1""")
def stage_latency(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    return an.stage_latency(ev).drop("p95_ms")


@query("text_coverage", "A14", """
select l_partkey as image_id, count(*) as regions, round(sum(l_quantity * (l_linenumber + 1)), 2) as text_area,
  round(sum(l_quantity * (l_linenumber + 1)) * 100.0::double / 999983, 2) as coverage_pct from lineitem group by 1""")
def text_coverage(spark, d):
    regions = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("image_id"), F.col("l_quantity").alias("width"), (F.col("l_linenumber") + 1).alias("height"), F.col("l_discount").alias("confidence"))
    out = an.text_coverage(regions, F.lit(999983.0))
    return out.select("image_id", "regions", F.round("text_area", 2).alias("text_area"), "coverage_pct")


@query("extraction_quality", "A16", """
with p as (select l.doc_id, 'quality' as field, d.n_chars >= 200 as predicted, l.quality = 1 as actual from documents d join labels l using (doc_id)
  union all select l.doc_id, 'toxic', contains(lower(d.text), 'hate'), l.toxic = 1 from documents d join labels l using (doc_id))
select field, count(*) as samples, count(*) filter (predicted = actual) as correct,
  round(count(*) filter (predicted = actual) * 100.0::double / count(*), 2) as accuracy_pct,
  coalesce(round(count(*) filter (predicted and not actual) * 100.0::double / nullif(count(*) filter (not actual), 0), 2), 0.0::double) as false_positive_pct,
  coalesce(round(count(*) filter (actual and not predicted) * 100.0::double / nullif(count(*) filter (actual), 0), 2), 0.0::double) as false_negative_pct
from p group by 1""")
def extraction_quality(spark, d):
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels")
    pair = lambda a, b, name: F.inline(F.array(
        F.struct(F.lit("quality").alias("field"), a.alias(name)), F.struct(F.lit("toxic").alias("field"), b.alias(name))))
    pred = docs.select("doc_id", pair(F.col("n_chars") >= 200, F.contains(F.lower("text"), F.lit("hate")), "predicted"))
    truth = labels.select("doc_id", pair(F.col("quality") == 1, F.col("toxic") == 1, "actual"))
    return an.extraction_quality(pred, truth, ["doc_id"])
