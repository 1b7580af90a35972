"""Linkage and fusion queries over parts, line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import text as tx
from tallymark.operators import fuse as fu
from tallymark.operators import link as lk
from tallymark.operators import nearlines as nl
from tallymark.plans.labels import WITH_LABEL_LINES, WITH_TEXT_LINES, labels, texts
from tallymark.plans.registry import query, table
from tallymark.sources import transcripts as tr

SQL_IDENT = """ident as (select p_partkey as ord, p_brand as session, lower(p_name) as name, lower(p_type) as category, case when p_size % 3 = 0 then null else cast(p_size % 7 as varchar) end as pack,
  case when p_partkey % 4 = 0 then 'm' || cast(p_size % 5 as varchar) end as model, case when p_partkey % 6 = 0 then null else 'acme' end as maker from part)"""
_PARTS = {"name": (0.35, 0.40), "category": (0.15, 0.50), "pack": (0.10, 0.35), "model": (0.55, 0.35), "maker": (0.15, 0.0)}


def images(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("session"), F.col("p_partkey").alias("ord"), "p_name", "p_type", "p_size")
    return lk.identity(p, {
        "name": F.col("p_name"), "category": F.col("p_type"), "pack": F.when(F.col("p_size") % 3 != 0, (F.col("p_size") % 7).cast("string")),
        "model": F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string"))),
        "maker": F.when(F.col("p_partkey") % 6 != 0, "acme")}).select("session", "ord", "ident")


def _score_sql() -> str:
    out = []
    for n, (g, l) in _PARTS.items():
        same = f"a.{n} = b.{n}" + (f" or contains(a.{n}, b.{n}) or contains(b.{n}, a.{n})" if n in ("name", "maker") else "")
        out.append(f"case when a.{n} is null or b.{n} is null then 0.0::double when {same} then {g}::double else -{l}::double end")
    return f"round(greatest(0::double, least(1::double, {' + '.join(out)})), 4)"


@query("session_matches", "J1", f"""
with {SQL_IDENT}, f as (select session, min(ord) as anchor from ident group by 1),
s as (select b.session, b.ord, f.anchor, {_score_sql()} as score from ident b join f using (session) join ident a on a.ord = f.anchor where b.ord > f.anchor)
select *, case when score >= 0.7 then 'MATCHED' when score >= 0.45 then 'NEEDS_REVIEW' else 'NOT_MATCHED' end as status from s""")
def session_matches(spark, d):
    return lk.anchor_matches(images(spark, d), "session", "ord").select("session", "ord", "anchor", "score", "status")


# Leaders by recursion over the order of a session; only for the comparison.
@query("product_clusters", "J2", f"""
with recursive {SQL_IDENT}, n as (select *, row_number() over (partition by session order by ord) as rn from ident),
e as (select b.session, b.ord, coalesce(list(a.ord) filter (a.ord is not null), []) as cands from n b left join n a on a.session = b.session and a.ord < b.ord and {_score_sql()} >= 0.7 group by 1, 2),
x as (select n.session, n.ord, n.rn, e.cands from n join e using (session, ord)),
st as (select session, ord, rn, [ord] as leaders, ord as cluster_ord from x where rn = 1
  union all select x.session, x.ord, x.rn, case when len(list_intersect(st.leaders, x.cands)) > 0 then st.leaders else list_append(st.leaders, x.ord) end,
    coalesce(list_min(list_intersect(st.leaders, x.cands)), x.ord) from st join x on x.session = st.session and x.rn = st.rn + 1)
select session, ord, cluster_ord from st""")
def product_clusters(spark, d):
    return lk.leader_clusters(images(spark, d), "session", "ord")


SQL_SOURCES = """src as (select l_partkey as product_id, case l_linenumber % 3 when 0 then 'MRP' when 1 then 'NET_QUANTITY' else 'BATCH' end as field_name,
  case when l_linenumber = 6 then '' else cast(cast(l_discount * 100 as int) % (l_partkey % 3 + 1) as varchar) end as value, 0.5 + l_tax as confidence, l_orderkey * 10 + l_linenumber as ord from lineitem),
n as (select *, nullif(value, '') as nv from src),
u as (select product_id, field_name, cast(count(distinct nv) as int) as k, max(confidence) filter (nv is not null) as c, count(*) as sources, min(nv) as one from n group by 1, 2)"""


def field_sources(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    value = F.when(n == 6, "").otherwise(((F.col("l_discount") * 100).cast("int") % (F.col("l_partkey") % 3 + 1)).cast("string"))
    return li.select(F.col("l_partkey").alias("product_id"), F.when(n % 3 == 0, "MRP").when(n % 3 == 1, "NET_QUANTITY").otherwise("BATCH").alias("field_name"), value.alias("value"),
                     F.lit(None).cast("string").alias("unit"), F.lit("PRESENT").alias("status"), (0.5 + F.col("l_tax")).alias("confidence"),
                     F.col("l_orderkey").cast("string").alias("image_id"), F.when(n % 2 == 0, "FRONT").otherwise("BACK").alias("panel"), (F.col("l_orderkey") * 10 + n).alias("ord"))


@query("unified_fields", "J3 J4", f"""
with {SQL_SOURCES.replace("cast(l_discount * 100 as int)", "cast(trunc(l_discount * 100) as int)")} select product_id, field_name, case k when 0 then 'NOT_VISIBLE' when 1 then 'CONFIRMED' else 'CONFLICT' end as status, case when k = 1 then one end as value,
  case when k = 1 then round(c, 4) else 0.0::double end as confidence, sources from u""")
def unified_fields(spark, d):
    unified, _ = fu.merge_fields(field_sources(spark, d))
    return unified.withColumn("confidence", F.round("confidence", 4)).drop("unit")


@query("conflict_candidates", "J4", f"""
with {SQL_SOURCES.replace("cast(l_discount * 100 as int)", "cast(trunc(l_discount * 100) as int)")} select n.product_id, n.field_name, n.nv as value, round(max(n.confidence), 4) as confidence from n join u using (product_id, field_name) where k > 1 and nv is not null group by 1, 2, 3""")
def conflict_candidates(spark, d):
    _, cand = fu.merge_fields(field_sources(spark, d))
    return cand.select("product_id", "field_name", "value", F.round("confidence", 4).alias("confidence"))


@query("best_fields", "J5", """
with s as (select p_partkey as k, [case when p_size % 3 = 0 then 'Found' when p_size % 3 = 1 then 'Defective' else 'Under Review' end, case when p_partkey % 2 = 0 then 'Found' else 'Under Review' end] as st,
  [0.5 + (p_size % 10) / 20.0::double, 0.5 + (p_partkey % 10) / 20.0::double] as c from part)
select k, case when (st[2] = 'Found' and st[1] <> 'Found') or (c[2] > c[1] and st[1] <> 'Defective') then st[2] else st[1] end as status,
  round(case when (st[2] = 'Found' and st[1] <> 'Found') or (c[2] > c[1] and st[1] <> 'Defective') then c[2] else c[1] end, 4) as confidence from s""")
def best_fields(spark, d):
    f = lambda s, c: F.struct(s.alias("status"), c.alias("confidence"))
    size, k = F.col("p_size"), F.col("p_partkey")
    arr = F.array(f(F.when(size % 3 == 0, "Found").when(size % 3 == 1, "Defective").otherwise("Under Review"), 0.5 + size % 10 / 20.0),
                  f(F.when(k % 2 == 0, "Found").otherwise("Under Review"), 0.5 + k % 10 / 20.0))
    v = table(spark, d, "part").select(k.alias("k"), fu.fold_best_field(arr).alias("f"))
    return v.select("k", "f.status", F.round("f.confidence", 4).alias("confidence"))


@query("first_found_fields", "J5", """
select o_custkey, arg_min(o_orderkey, (case when o_orderstatus = 'F' then 0 else 1000000000 end) + o_orderkey) as o_orderkey, arg_min(o_orderstatus, (case when o_orderstatus = 'F' then 0 else 1000000000 end) + o_orderkey) as code from orders group by 1""")
def first_found_fields(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("code"), F.when(F.col("o_orderstatus") == "F", "Found").otherwise("Missing").alias("status"))
    return fu.first_found_field(o, ["o_custkey"], "o_orderkey").drop("status")


@query("first_filled_attributes", "J6", """
select o_custkey, arg_min(o_orderpriority, o_orderkey) filter (o_orderpriority <> '5-LOW') as priority, arg_min(o_orderstatus, o_orderkey) filter (o_orderstatus <> 'O') as state from orders group by 1""")
def first_filled_attributes(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise(" ").alias("priority"),
                                         F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("state"))
    return fu.first_filled_attributes(o, ["o_custkey"], ["priority", "state"])


@query("surface_consistency", "J7", """
with r as (select l_orderkey as k, cast(cast(l_quantity as int) % 3 as double) as v from lineitem), g as (select k, count(*) filter (v > 0) as n, min(v) filter (v > 0) as lo, max(v) filter (v > 0) as hi from r group by 1),
f as (select o_orderkey as k, 'Found' as status, 0.9::double as confidence from orders)
select k, case when n >= 2 and lo <> hi then 'Under Review' else status end as status, round(case when n >= 2 and lo <> hi then 0.45::double when n >= 2 then 0.93::double else confidence end, 4) as confidence from f left join g using (k)""")
def surface_consistency(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity").cast("int") % 3).cast("double").alias("v"))
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("Found").alias("status"), F.lit(0.9).alias("confidence"))
    return fu.apply_consistency(f, fu.consistency(r, ["k"], "v"), ["k"]).select("k", "status", F.round("confidence", 4).alias("confidence"))


@query("policy_merge", "J8", """
with f as (select distinct on (scan_id, ord) * from (select l_orderkey as scan_id, l_linenumber as ord, case l_linenumber % 4 when 0 then 'MRP' when 1 then 'NET_QUANTITY' when 2 then 'SERVING_SIZE' else 'NET_QUANTITY' end as meaning,
  cast(cast(l_quantity as int) % 2 as varchar) as value, case when l_linenumber = 3 then 'Front (PDP)' else 'Back Panel' end as panel, min(l_tax) over (partition by l_orderkey, l_linenumber) as confidence, l_quantity from lineitem) order by scan_id, ord, l_quantity),
s as (select scan_id, meaning, count(*) as n, min(value) as lo, max(value) as hi, arg_min(ord, (case when panel like 'Front%' then 0 else 100 end) + ord) as fr, arg_max(ord, confidence * 1000 - ord / 100.0) as su from f group by 1, 2)
select scan_id, ord, meaning, value, case when meaning in ('MRP', 'NET_QUANTITY') and n > 1 and lo <> hi then 'CONFLICT' else 'RESOLVED' end as status from f join s using (scan_id, meaning)
where meaning not in ('MRP', 'NET_QUANTITY') or n = 1 or lo <> hi or ord = (case when meaning = 'NET_QUANTITY' then fr else su end)""")
def policy_merge(spark, d):
    n = F.col("l_linenumber")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_tax").alias("confidence"))
    f = li.select(F.col("l_orderkey").alias("scan_id"), n.alias("ord"), F.when(n % 4 == 0, "MRP").when(n % 4 == 2, "SERVING_SIZE").otherwise("NET_QUANTITY").alias("meaning"),
                  (F.col("l_quantity").cast("int") % 2).cast("string").alias("value"), F.when(n == 3, "Front (PDP)").otherwise("Back Panel").alias("panel"), "confidence", F.lit("RESOLVED").alias("status"))
    return fu.policy_merge(f).select("scan_id", "ord", "meaning", "value", "status")


def _entities(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("product_id"), n.alias("ord"), n.cast("string").alias("image_id"), F.when(n % 3 == 0, "packer").otherwise("Manufacturer").alias("role"),
                     F.concat(F.lit("Maker "), (F.col("s") % 3).cast("string")).alias("name"), F.when(n % 2 == 0, F.concat(F.lit("Plot "), n.cast("string"))).alias("address"), (0.7 + n * 0.03).alias("confidence"))


SQL_ENT = """e as (select l_orderkey as product_id, l_linenumber as ord, case when l_linenumber % 3 = 0 then 'PACKER' else 'MANUFACTURER' end as role, 'maker ' || cast(min(l_suppkey) % 3 as varchar) as name from lineitem group by 1, 2)"""


# Two parties for each panel, so that chains of one name pass panels in which others stand between.
def _two_parties(spark, d):
    one = _entities(spark, d)
    second = one.withColumn("ord", F.col("ord") + 100).withColumn("name", F.concat(F.lit("Trader "), (F.col("product_id") % 2).cast("string")))
    return one.unionByName(second).withColumn("ord", F.col("ord") % 100 * 2 + F.when(F.col("ord") > 100, 1).otherwise(0))


@query("entity_links", "J9", """
with m as (select l_orderkey as product_id, l_linenumber as n, min(l_suppkey) % 3 as s from lineitem group by 1, 2),
e as (select product_id, n, n * 2 + k as ord, cast(n as varchar) as image_id, case when n % 3 = 0 then 'packer' else 'Manufacturer' end as role,
  case k when 0 then 'Maker ' || cast(s as varchar) else 'Trader ' || cast(product_id % 2 as varchar) end as name, case when n % 2 = 0 then 'Plot ' || cast(n as varchar) end as address, 0.7::double + n * 0.03::double as confidence from m, (values (0), (1)) as v(k)),
k as (select *, 'r' || upper(role) as key from e union all select *, 'n' || lower(trim(name)) from e),
g as (select product_id, key, image_id, min(ord) as first from k group by all),
c as (select *, lag(image_id) over w as p_image, lag(first) over w as p_first from g window w as (partition by product_id, key order by first)),
l as (select k.product_id, c.p_first as p, k.ord as ord from k join c on c.product_id = k.product_id and c.key = k.key and c.image_id = k.image_id where c.p_first is not null
  union select k.product_id, k.ord, c.first from k join c on c.product_id = k.product_id and c.key = k.key and c.p_image = k.image_id)
select l.product_id, upper(a.role) || '_LINK' as entity_type, a.image_id as source_image_id, b.image_id as target_image_id, round(least(a.confidence, b.confidence), 2) as confidence,
  concat_ws(' — ', case when a.address is null and b.address is not null then b.name else a.name end, nullif(case when a.address = b.address then b.address else concat_ws(', ', a.address, b.address) end, '')) as linked_value
from l join e a on a.product_id = l.product_id and a.ord = l.p join e b on b.product_id = l.product_id and b.ord = l.ord""")
def entity_links(spark, d):
    return lk.entity_links(_two_parties(spark, d))


@query("merged_entities", "J11", f"with {SQL_ENT} select product_id, role, name, min(ord) as ord from e group by 1, 2, 3")
def merged_entities(spark, d):
    return lk.merged_entities(_entities(spark, d)).select("product_id", F.upper("role").alias("role"), F.lower("name").alias("name"), "ord")


@query("panel_completeness", "J10", """
with p as (select distinct l_orderkey as product_id, case l_linenumber when 1 then 'FRONT' when 2 then 'BACK' when 3 then 'LEFT' when 4 then 'SIDE' end as panel from lineitem)
select product_id, coalesce(string_agg(panel, ',' order by panel), '') as available, 7 - count(panel) as missing from p group by 1""")
def panel_completeness(spark, d):
    n = F.col("l_linenumber")
    img = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("product_id"), F.when(n == 1, "front").when(n == 2, "BACK").when(n == 3, "Left").when(n == 4, "SIDE").otherwise("PARTIAL").alias("panel"))
    c = lk.panel_completeness(img)
    return c.select("product_id", F.array_join("available_panels", ",").alias("available"), F.size("missing_panels").cast("bigint").alias("missing"))


@query("panel_graph", "J12", f"""
with {SQL_ENT} select relation, count(*) as n from (select 'HAS_PANEL' as relation from e union all select 'HAS_FIELD' from (select distinct product_id, role from e) union all select 'OWNS' from e
  union all select 'LINKED_TO' from (select lag(ord) over (partition by product_id, role order by ord) as s from e) where s is not null) group by 1
union all select node_type, count(*) from (select 'PRODUCT' as node_type from (select distinct product_id from e) union all select 'PANEL' from e union all select 'FIELD' from (select distinct product_id, role from e)) group by 1""")
def panel_graph(spark, d):
    e = _entities(spark, d).withColumn("product_id", F.col("product_id").cast("string")).withColumn("panel", F.col("image_id")).withColumn("field_name", F.upper("role"))
    fields = e.groupBy("product_id", "field_name").agg(F.min("name").alias("value"), F.lit("CONFIRMED").alias("status"))
    links = lk.entity_links(e.withColumn("name", F.upper("role")))
    nodes, edges = lk.panel_graph(e.select("product_id", "image_id", "panel"), fields, e.select("product_id", "image_id", "field_name"), links)
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).unionByName(nodes.groupBy(F.col("node_type").alias("relation")).agg(F.count(F.lit(1)).alias("n")))


@query("identity_graph", "J13", """
with p as (select p_partkey, p_brand, p_name, case when p_size % 2 = 0 then 'IMPORTER' else 'PACKER' end as role, case when p_size % 3 <> 0 then 'Plot' end as address, case when p_size % 5 = 0 then '201301' end as pin from part)
select relation, count(*) as n from (select 'OWNS_BRAND' as relation from p union all select 'HAS_NAME' from p union all select 'LOCATED_AT' from p where address is not null union all select 'HAS_PIN' from p where address is not null and pin is not null
  union all select 'HAS_MODEL' from p where role = 'IMPORTER') group by 1""")
def identity_graph(spark, d):
    size = F.col("p_size")
    e = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product_name"), F.when(size % 2 == 0, "IMPORTER").otherwise("PACKER").alias("role"),
                                       F.lit("Acme Ltd").alias("name"), F.when(size % 3 != 0, "Plot").alias("address"), F.when(size % 5 == 0, "201301").alias("pin"), F.lit("M1").alias("model_number"))
    _, edges = lk.identity_graph(e)
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("reading_consensus", "J14 J15", """
select p_partkey as id, case when p_size % 2 = 0 then 1 else 2 end as groups, case when p_size % 2 = 0 then 'Net Wt 5' || cast(p_size % 10 as varchar) || 'g' else 'Net Wt 5' || cast(p_size % 10 as varchar) || 'g' end as text from part""")
def reading_consensus(spark, d):
    size = F.col("p_size")
    digit = (size % 10).cast("string")
    r = lambda t, x: F.struct(t.alias("text"), x.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"))
    good = F.concat(F.lit("Net Wt 5"), digit, F.lit("g"))
    arr = F.array(r(good, F.lit(0)), r(F.concat(F.lit("Net Wt 5"), digit, F.lit("9")), F.lit(2)), r(good, F.lit(4)), r(F.lit("MRP 10"), F.when(size % 2 == 0, 6).otherwise(200)))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), fu.cluster_readings(arr).alias("g"))
    return v.select("id", F.size("g").alias("groups"), fu.character_vote(F.transform(F.get("g", F.lit(0)), lambda x: x["text"]))["text"].alias("text"))


# Three passes over each line item: shifted boxes, texts with reading errors.
_READ = {"x": "cast(l_linenumber * 17 % 60 as double) + pass * 4.0", "y": "cast(l_linenumber * 9 as double) + pass * 1.5", "w": "40.0 + cast(cast(l_quantity as int) as double)", "h": "10.0 + cast(l_linenumber % 3 as double)",
         "text": "concat(case when pass = 2 and l_quantity > 25 then 'Net Wt S' else 'Net Wt 5' end, l_returnflag, case when pass = 1 then '9' else 'g' end)"}
_READ_COLS = ", ".join(f"min(cast({e} as double)) as {c}" if c != "text" else f"min({e}) as text" for c, e in _READ.items())


@query("reading_groups", "J14", f"""
with recursive r0 as (select l_orderkey as image_id, l_linenumber * 3 + pass as ord, {_READ_COLS} from lineitem, (values (0), (1), (2)) as v(pass) group by 1, 2),
r as materialized (select *, row_number() over (partition by image_id order by ord) as k, lower(text) as t from r0),
fold as (
  select image_id, k, ord, ord as leader, [struct_pack(ord := ord, x := x, y := y, w := w, h := h, t := t)] as ls from r where k = 1
  union all
  select image_id, k, ord, case when pos > 0 then ls[pos].ord else ord end, case when pos > 0 then ls else list_append(ls, me) end
  from (select n.image_id, n.k, n.ord, f.ls, struct_pack(ord := n.ord, x := n.x, y := n.y, w := n.w, h := n.h, t := n.t) as me,
    coalesce(list_position(list_transform(list_transform(f.ls, lambda s: struct_pack(t := s.t, i := greatest(0::double, least(s.x + s.w, n.x + n.w) - greatest(s.x, n.x)) * greatest(0::double, least(s.y + s.h, n.y + n.h) - greatest(s.y, n.y)), area := s.w * s.h + n.w * n.h)),
      lambda o: o.i / (o.area - o.i) > 0.35::double or (o.i / (o.area - o.i) > 0.15::double and 1.0::double - levenshtein(o.t, n.t) / greatest(length(o.t), length(n.t))::double > 0.55::double)), true), 0)::bigint as pos
    from fold f join r n on n.image_id = f.image_id and n.k = f.k + 1))
select image_id, ord, leader from fold""")
def reading_groups(spark, d):
    n, at = F.col("l_linenumber"), lambda c, k: F.expr(_READ[c].replace("pass", str(k)))
    # Passes of a line differ by constants and by their texts, so lines are grouped before they are read three times.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.expr(_READ["w"])).alias("w"), *[F.min(at("text", k)).alias(f"text_{k}") for k in range(3)])
    reading = lambda k, text: F.struct((n * 3 + k).alias("ord"), at("x", k).alias("x"), at("y", k).alias("y"), "w", at("h", k).alias("h"), text.alias("text"))
    texts_ = [F.col(f"text_{k}") for k in range(3)]
    rows = lines.select(F.col("l_orderkey").alias("image_id"), F.inline(F.when(n.isNull(), F.array(reading(0, F.least(*texts_)))).otherwise(F.array(*[reading(k, t) for k, t in enumerate(texts_)]))))
    return fu.reading_groups(rows)


@query("character_votes", "J15", """
select p_partkey as id, 'A1' || cast(p_size % 10 as varchar) as text, round(0.65::double + 0.3::double, 3) as confidence from part""")
def character_votes(spark, d):
    n = (F.col("p_size") % 10).cast("string")
    arr = F.array(F.concat(F.lit("A1"), n), F.concat(F.lit("AI"), n), F.concat(F.lit("A1"), n, F.lit("x")))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), fu.character_vote(arr).alias("v"))
    return v.select("id", "v.text", "v.confidence")


@query("best_readings", "J16", """
select p_partkey as id, p_name as text, case when p_size % 3 = 0 then 0.95::double else 0.9::double end as confidence from part""")
def best_readings(spark, d):
    r = lambda t, c: F.struct(t.alias("text"), F.lit(c).alias("confidence"))
    name = F.col("p_name")
    arr = F.array(r(F.lit("###########"), 0.3), r(name, 0.85), r(name, 0.80), F.when(F.col("p_size") % 3 == 0, r(F.upper(name), 0.5)).otherwise(r(F.lit("zz"), 0.5)))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), fu.best_reading(arr).alias("v"))
    return v.select("id", "v.text", "v.confidence")


@query("engine_agreement", "J17", """
select p_partkey as id, case p_size % 4 when 0 then 'VERIFIED' when 1 then 'NEEDS REVIEW' when 2 then 'VERIFIED' else 'NOT DETECTED' end as status,
  case p_size % 4 when 0 then 0.98::double when 1 then 0.55::double when 2 then 0.94::double else 0.0::double end as confidence from part""")
def engine_agreement(spark, d):
    m = F.col("p_size") % 4
    vals = F.when(m == 0, F.array(F.lit("Rs 240"), F.lit(" Rs 240 "))).when(m == 1, F.array(F.lit("Rs 240"), F.lit("Rs 2400"))).when(
        m == 2, F.array(F.lit("Rs 240.00"), F.lit("Rs. 240.00"))).otherwise(F.array(F.lit(" "), F.lit("")))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), fu.engine_agreement(vals, F.lit(True)).alias("v"))
    return v.select("id", "v.status", "v.confidence")


@query("distinct_label_lines", "J18", WITH_LABEL_LINES + """
, b as (select l.doc_id, row_number() over (partition by l.doc_id order by line_index) - 1 as position, l.text, string_split(s.text, chr(10))[1] as title from lines l join label_src s on s.doc_id = l.doc_id)
select doc_id, position, text, case when text = title or text = 'Mfd by: Acme Foods Pvt Ltd' then 0.95::double else 0.9::double end as confidence from b
union all select doc_id, count(*), 'Mfd by: Acme Foods Pvt. Ltd', 0.9::double from b where doc_id % 6 <> 0 group by doc_id""")
def distinct_label_lines(spark, d):
    t = labels(spark, d).select("doc_id", F.transform(tx.line_array(F.concat("text", F.lit("\nMfd by: Acme Foods Pvt. Ltd\n"), F.get(F.split("text", "\n"), F.lit(0)))),
                                                      lambda l: F.struct(l["text"].alias("text"), F.lit(0.90).alias("confidence"))).alias("lines"))
    return t.select("doc_id", F.posexplode(fu.distinct_lines(F.col("lines"))).alias("position", "l")).select("doc_id", F.col("position").cast("bigint").alias("position"), "l.text", F.round("l.confidence", 2).alias("confidence"))


@query("repeated_lines", "J18", WITH_TEXT_LINES + """
, k as (select doc_id, line_index, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) as line_key from lines)
select line_key, count(*) as occurrences, min(doc_id) as first_doc from k where line_key <> '' group by 1""")
def repeated_lines(spark, d):
    ln = tr.explode_lines(texts(spark, d), ["doc_id"])
    return fu.repeated_lines(ln, ["doc_id", "line_index"]).select("line_key", "occurrences", F.col("first.doc_id").alias("first_doc"))


# Letters beyond ASCII in the given tables, as one byte each: DuckDB counts edits in bytes.
_MARKED = "éóèñçüêäöíß₹"
_BAG = " + ".join(f"abs(a.c{i} - b.c{i})" for i in range(10))


@query("distinct_corpus_lines", "J18", WITH_TEXT_LINES + f"""
, firsts as materialized (select lower(text) as low, min(struct_pack(d := doc_id, i := line_index, t := text)) as f, count(*) as many from lines group by lower(text)),
n as materialized (select *, row_number() over (order by f.d, f.i) as id, length(low) as n, translate(low, '{_MARKED}', {' || '.join(f'chr({i})' for i in range(1, len(_MARKED) + 1))}) as plain,
  {", ".join(f"length(low) - length(replace(low, '{c}', '')) as c{i}" for i, c in enumerate("etaonirhsd"))} from firsts),
wide as (select *, n // 8 + unnest([-1, 0, 1]) as near_n from n),
alike as materialized (select a.id as a, b.id as b, a.plain as x, b.plain as y, greatest(a.n, b.n) as longest from wide a join n b on a.near_n = b.n // 8 and a.id < b.id
  where b.n between a.n - 8 and a.n + 8 and least(a.n, b.n) >= 0.84::double * greatest(a.n, b.n) and {_BAG} <= least(16, 0.3::double * greatest(a.n, b.n))),
near as materialized (select a, b from alike where levenshtein(x, y) <= 8 and 1.0::double - levenshtein(x, y) / longest::double > 0.85::double),
ends as materialized (select a as id from near union select b from near),
steps as (select list(struct_pack(kept := []::bigint[], id := id, nb := nb) order by id) as s from (select id, coalesce(list(near.a) filter (near.a is not null), []::bigint[]) as nb from n left join near on near.b = n.id
  where id in (select id from ends) group by id)),
kept as materialized (select unnest(list_reduce(list_prepend(struct_pack(kept := []::bigint[], id := 0::bigint, nb := []::bigint[]), s),
  lambda acc, x: struct_pack(kept := case when list_has_any(acc.kept, x.nb) then acc.kept else list_append(acc.kept, x.id) end, id := x.id, nb := x.nb)).kept) as id from steps),
counts as (select lower(regexp_replace(f.t, '[^a-zA-Z0-9]', '', 'g')) as key, sum(many) as occurrences from n group by 1)
select f.d as doc_id, f.i as line_index, f.t as text, case when key <> '' and c.occurrences >= 2 then 0.95::double else 0.9::double end as confidence, case when key = '' then 1 else c.occurrences end::bigint as occurrences
from n join counts c on c.key = lower(regexp_replace(f.t, '[^a-zA-Z0-9]', '', 'g')) where id in (select id from n except select id from ends union all select id from kept)""")
def distinct_corpus_lines(spark, d):
    ln = texts(spark, d).select("doc_id", F.inline(F.transform(tx.line_array(F.col("text")), lambda l: F.struct(l["line_index"].alias("line_index"), l["text"].alias("text")))))
    return nl.distinct_corpus_lines(ln, ["doc_id", "line_index"])
