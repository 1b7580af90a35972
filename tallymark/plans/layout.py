"""Layout queries over boxes derived from line items and over label lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import lexicon as lx
from tallymark.functions import text as tx
from tallymark.operators import layout as ly
from tallymark.plans import sqltext as q
from tallymark.plans.labels import SQL_LABELS, WITH_LABEL_LINES, WITH_TEXT_LINES, labels, texts
from tallymark.plans.registry import query, table
from tallymark.sources import transcripts as tr

# A line item as a box on the image of its supplier.
BOX = {
    "id": "l_orderkey * 10 + l_linenumber",
    "image_id": "l_suppkey",
    "x": "cast((l_orderkey * 7 + l_linenumber * 31) % 400 as double)",
    "y": "cast(l_orderkey * 3 % 997 as double)",
    "w": "20.0 + cast(cast(l_quantity as int) as double)",
    "h": "8.0 + cast(l_linenumber as double)",
    "text": "case l_linenumber % 5 when 0 then 'Ingredients' when 1 then 'Net Qty 5 g' when 2 then 'Store in a cool' when 3 then l_returnflag else l_linestatus end",
}
_COLS = ", ".join(f"cast({e} as double) as {n}" if n in "xywh" else f"{e} as {n}" for n, e in BOX.items())
# Duplicate order lines exist in the data: one box per (order, line).
SQL_BOX = f"box as (select id, min(image_id) as image_id, min(x) as x, min(y) as y, min(w) as w, min(h) as h, min(text) as text from (select {_COLS} from lineitem) group by id)"


def boxes(spark, d):
    b = table(spark, d, "lineitem").selectExpr(*[f"cast({e} as double) as {n}" if n in "xywh" else f"{e} as {n}" for n, e in BOX.items()])
    return b.groupBy("id").agg(*[F.min(c).alias(c) for c in ("image_id", "x", "y", "w", "h", "text")])


@query("reading_order", "W1", f"""
with {SQL_BOX} select id, image_id, row_number() over (partition by image_id order by round_even(y / 15, 0), x, id) as reading_order from box""")
def reading_order(spark, d):
    return ly.reading_order(boxes(spark, d)).select("id", "image_id", "reading_order")


# The rule itself, word by word: the state is the list of an image's lines (sums of centre and height, words).
SQL_LINES = f"""{SQL_BOX},
w0 as materialized (select *, y + h / 2 as cy, row_number() over (partition by image_id order by y, x, id) as r from box),
fold as (
  select image_id, r, id, 1::bigint as line_no, [struct_pack(c := cy, h := h, n := 1::double)] as ls from w0 where r = 1
  union all
  select image_id, r, id, case when pos > 0 then pos else len(ls) + 1 end,
    case when pos > 0 then list_transform(ls, lambda s, i: case when i = pos then struct_pack(c := s.c + cy, h := s.h + h, n := s.n + 1) else s end) else list_append(ls, struct_pack(c := cy, h := h, n := 1::double)) end
  from (select w.image_id, w.r, w.id, w.cy, w.h, f.ls, coalesce(list_position(list_transform(f.ls, lambda s: abs(w.cy - s.c / s.n) <= s.h / s.n * 0.55::double), true), 0)::bigint as pos
    from fold f join w0 w on w.image_id = f.image_id and w.r = f.r + 1)),
b2 as materialized (select b.*, f.line_no from box b join fold f on f.id = b.id)"""


@query("words_to_lines", "W2 W10", f"""
with recursive {SQL_LINES}, b3 as (select *, x - lag(x + w) over w1 as gap, lag(h) over w1 as lh from b2 window w1 as (partition by image_id, line_no order by x, id)),
b4 as (select *, cast(sum(case when gap > greatest(45::double, 3.5::double * (h + lh) / 2) then 1 else 0 end) over (partition by image_id, line_no order by x, id rows unbounded preceding) as bigint) as part_no from b3)
select image_id, line_no, part_no, round(min(x), 2) as x, round(min(y), 2) as y, round(max(x + w) - min(x), 2) as w, round(max(y + h) - min(y), 2) as h, count(*) as members from b4 group by 1, 2, 3""")
def words_to_lines(spark, d):
    return ly.union_boxes(ly.words_to_lines(boxes(spark, d)), ["image_id", "line_no", "part_no"])


@query("lines_to_blocks", "W3", f"""
with {SQL_BOX}, p as (select *, lag(x) over w as px, lag(y) over w as py, lag(w) over w as pw, lag(h) over w as ph from box window w as (partition by image_id order by y, id))
select id, image_id, cast(sum(case when coalesce(y - (py + ph) <= 1.6::double * (h + ph) / 2 and greatest(0::double, least(x + w, px + pw) - greatest(x, px)) > 0.2::double * least(w, pw), false) then 0 else 1 end)
  over (partition by image_id order by y, id rows unbounded preceding) as bigint) as block_no from p""")
def lines_to_blocks(spark, d):
    return ly.lines_to_blocks(boxes(spark, d)).select("id", "image_id", "block_no")


@query("percent_blocks", "W3", f"""
with {SQL_BOX}, n as (select image_id, row_number() over (partition by image_id order by y, x, id) as line_index, case when id % 6 <> 0 then y / 5 end as y, x, h / 10 as h from box),
k as (select *, coalesce(round_even(y / 3, 0) * 3, line_index::double) as band, case when y is null then 0 else x end as xx from n),
p as (select *, lag(y) over w as py, lag(h) over w as ph, lag(line_index) over w as pl from k window w as (partition by image_id order by band, xx, line_index))
select image_id, line_index, sum(case when case when y is not null and py is not null then y - (py + ph) between 0 and 5 else coalesce(line_index = pl + 1, false) end then 0 else 1 end)
  over (partition by image_id order by band, xx, line_index rows unbounded preceding)::bigint as block_no from p""")
def percent_blocks(spark, d):
    """Boxes of every sixth line item are taken away, so that both rules are used."""
    b = ly.carry.row_number_across(ly.segmented(boxes(spark, d)), ["image_id"], "segment", ["y", "x", "id"], "line_index")
    lines = b.select("image_id", "line_index", F.when(F.col("id") % 6 != 0, F.col("y") / 5).alias("y"), "x", (F.col("h") / 10).alias("h"))
    return ly.lines_to_blocks_percent(lines).select("image_id", "line_index", "block_no")


def _header_sql(col: str) -> str:
    return "case " + " ".join(f"when {q.m(col, p)} then '{n}'" for n, p in lx.SECTION_HEADERS.items()) + " end"


@query("box_sections", "W4 J25", f"""
with {SQL_BOX}, p as (select *, {_header_sql('text')} as hd, lag(y + h) over w as pb from box window w as (partition by image_id order by y, x, id)),
m as (select *, coalesce(hd, case when y - pb > 200 then 'OTHER' end) as mark from p)
select id, image_id, coalesce(last_value(mark ignore nulls) over (partition by image_id order by y, x, id rows between unbounded preceding and current row), 'OTHER') as section from m""")
def box_sections(spark, d):
    return ly.sections_by_box(boxes(spark, d)).select("id", "image_id", "section")


@query("text_sections", "W4 J25", WITH_TEXT_LINES + f"""
, m as (select doc_id, line_index, {_header_sql('text')} as mark from lines)
select doc_id, line_index, coalesce(last_value(mark ignore nulls) over (partition by doc_id order by line_index rows between unbounded preceding and current row), 'OTHER') as section from m""")
def text_sections(spark, d):
    t = texts(spark, d).select("doc_id", tx.line_array(F.col("text")).alias("lines"))
    return ly.sections_in_text(t, ["doc_id"]).select("doc_id", "line_index", "section")


def _heading_sql(col: str, part: str) -> str:
    if part == "field":
        return "case " + " ".join(f"when {q.m(col, p)} then '{n}'" for n, p in ly.HEADINGS) + " end"
    return "case " + " ".join(f"when {q.m(col, p)} then trim(regexp_replace({col}, {q.lit(p)}, ''), ' :;=-')" for _, p in ly.HEADINGS) + " end"


@query("heading_values", "W5", WITH_LABEL_LINES + f"""
, h as (select doc_id, line_index, next1, {_heading_sql('text', 'field')} as field, {_heading_sql('text', 'value')} as v, {_heading_sql('next1', 'field')} as nf from ctx)
select * from (select doc_id, line_index, field, case when v <> '' then v when nf is null then next1 end as value, case when v <> '' then 'SAME_LINE' else 'PROXIMITY' end as association,
  case when v <> '' then 0.98::double else 0.94::double end as confidence from h where field is not null) where value is not null""")
def heading_values(spark, d):
    return ly.heading_values(tr.explode_lines(labels(spark, d), ["doc_id"]), ["doc_id"])


REGION_TEXT = "case l_linenumber % 6 when 0 then 'MRP:' when 1 then concat('Net Qty: ', cast(cast(l_quantity as int) as {t}), ' g') when 2 then ' Mfd by ' when 3 then '' when 4 then concat('Acme ', l_returnflag) else 'Batch No.' end"


@query("heading_values_by_box", "W5", f"""
with {SQL_BOX}, t as (select l_orderkey * 10 + l_linenumber as id, min(trim({REGION_TEXT.format(t='varchar')})) as t from lineitem group by 1),
r as (select b.* exclude (text), t.t as text from box b join t on t.id = b.id),
p as (select *, lead(id) over w as nid, lead(text) over w as nt, lead(x) over w as nx, lead(y) over w as ny from r window w as (partition by image_id order by y, x, id)),
h as (select *, {_heading_sql('text', 'field')} as field, {_heading_sql('text', 'value')} as v, {_heading_sql('nt', 'field')} as nf from p)
select image_id, id as heading_id, case when v <> '' then id else nid end as value_id, field, case when v <> '' then v else nt end as value, case when v <> '' then 'SAME_LINE' else 'PROXIMITY' end as association,
  case when v <> '' then 0.98::double else 0.94::double end as confidence
from h where field is not null and (v <> '' or (nf is null and nt <> '' and ((ny - (y + h) between 0 and 60 and abs(nx - x) < 180) or (abs(ny - y) < 20 and nx - (x + w) >= 0 and nx - (x + w) < 80))))""")
def heading_values_by_box(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", f"{REGION_TEXT.format(t='string')} as t").groupBy("id").agg(F.min(F.trim("t")).alias("text"))
    return ly.heading_values_by_box(boxes(spark, d).drop("text").join(t, "id"))


@query("line_prominence", "W8", f"""
with {SQL_BOX}, a as (select image_id, avg(h) as avg_height from box group by 1),
s as (select id, y / 10 as y, case when h >= avg_height * 1.5::double then 'large' when h <= avg_height * 0.7::double then 'small' else 'medium' end as relative_size from box join a using (image_id))
select id, relative_size, case when y < 30 then 'top' when y > 70 then 'bottom' else 'middle' end as vertical_zone, relative_size = 'large' and y <= 70 as is_prominent, y > 70 or relative_size = 'small' as is_bottom_stamp from s""")
def line_prominence(spark, d):
    b = boxes(spark, d).withColumn("y", F.col("y") / 10)
    return ly.prominence(b).select("id", "relative_size", "vertical_zone", "is_prominent", "is_bottom_stamp")


@query("product_split", "W9", """
with r as (select l_orderkey as image_id, case when l_linenumber % 2 = 0 then l_linenumber * 4.0::double else 300.0::double + l_linenumber + case when l_orderkey % 5 = 0 then -140.0::double else 0.0::double end end as x, 30.0::double + l_linenumber as w from lineitem),
s as (select image_id, min(x) as lo, max(x + w) - min(x) as span, count(*) as n from r group by 1),
f as (select image_id, max(n) as n, cast(sum((x + w <= lo + span * 0.35::double + span * 0.05::double)::int) as bigint) as left_n, cast(sum((x >= lo + span * 0.65::double - span * 0.05::double)::int) as bigint) as right_n,
  cast(sum((x < lo + span * 0.65::double and x + w > lo + span * 0.35::double)::int) as bigint) as straddle_n from r join s using (image_id) group by 1)
select image_id, case when n >= 4 and left_n >= 2 and right_n >= 2 and straddle_n = 0 then 2 else 1 end as products, left_n, right_n, straddle_n from f""")
def product_split(spark, d):
    n = F.col("l_linenumber")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.when(n % 2 == 0, n * 4.0).otherwise(300.0 + n + F.when(F.col("l_orderkey") % 5 == 0, -140.0).otherwise(0.0)).alias("x"), (30.0 + n).alias("w"))
    return ly.split_products(r)


@query("key_value_rows", "W11", WITH_LABEL_LINES + r"""
, p as (select doc_id, line_index, regexp_extract(text, '^([^:|–—\t]*)[:|–—\t](.*)$', 1) as h1, regexp_extract(text, '^([^:|–—\t]*)[:|–—\t](.*)$', 2) as v1,
  regexp_extract(text, '^(.*?)\s{2,}(.*)$', 1) as h2, regexp_extract(text, '^(.*?)\s{2,}(.*)$', 2) as v2 from lines)
select doc_id, line_index, case when length(trim(h1)) > 1 and length(trim(v1)) > 0 then trim(h1) else trim(h2) end as header, case when length(trim(h1)) > 1 and length(trim(v1)) > 0 then trim(v1) else trim(v2) end as value
from p where (length(trim(h1)) > 1 and length(trim(v1)) > 0) or (length(trim(h2)) > 1 and length(trim(v2)) > 0)""")
def key_value_rows(spark, d):
    ln = tr.explode_lines(labels(spark, d), ["doc_id"]).select("doc_id", "line_index", ly.table_row(F.col("text")).alias("p"))
    return ln.filter("p is not null").select("doc_id", "line_index", "p.header", "p.value")


@query("cell_fields", "W12", """
select p_partkey as table_id, 0 as row_index, 'SERVING_SIZE' as semantic_type, cast(p_size as varchar) || ' g' as field_value from part
union all select p_partkey, 1, 'NUTRITION_INFORMATION', 'Energy: ' || cast(p_size * 10 as varchar) from part where p_size % 2 = 0""")
def cell_fields(spark, d):
    p = table(spark, d, "part")
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("col_index"), t.alias("text"))
    size = F.col("p_size").cast("string")
    cells = p.select(F.col("p_partkey").alias("table_id"), F.inline(F.array(
        cell(0, 0, F.lit("Serving Size ")), cell(0, 1, F.concat(size, F.lit(" g"))), cell(1, 0, F.lit("Energy")),
        cell(1, 1, F.when(F.col("p_size") % 2 == 0, (F.col("p_size") * 10).cast("string")).otherwise("")), cell(2, 0, F.lit("Colour")), cell(2, 1, F.col("p_brand")))))
    return ly.cell_fields(cells).select("table_id", "row_index", "semantic_type", "field_value")


@query("line_neighbours", "J19", """
with l as (select p_partkey as image_id, unnest([0, 1, 2, 3]) as id, p_size from part), b as (select image_id, id, cast(id * (p_size % 40) as double) as x, cast(id * (4 + p_size % 20) as double) as y, 30.0::double as w, 6.0::double as h from l)
select a.image_id, a.id, coalesce(string_agg(cast(o.id as varchar), ',' order by o.id), '') as near from b a left join b o on o.image_id = a.image_id and o.id <> a.id and abs(o.y - (a.y + a.h)) <= 14
  and (least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x) > 0 or abs(a.x - o.x) < 25) group by 1, 2""")
def line_neighbours(spark, d):
    size = F.col("p_size")
    b = lambda i: F.struct(F.lit(i).alias("id"), (i * (size % 40)).cast("double").alias("x"), (i * (4 + size % 20)).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(6.0).alias("h"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.array(*[b(i) for i in range(4)]).alias("boxes"))
    return p.select("image_id", F.inline(ly.neighbours(F.col("boxes")))).select("image_id", "id", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"))


@query("neighbour_rows", "J19", f"""
with {SQL_BOX}, n as (select image_id, row_number() over (partition by image_id order by y, x, id) as id, case when id % 7 <> 0 then x end as x, case when id % 7 <> 0 then y end as y, w, h from box)
select a.image_id, a.id, b.id as near from n a join n b on a.image_id = b.image_id and a.id <> b.id
where (a.y is not null and b.y is not null and abs(b.y - (a.y + a.h)) <= 14 and (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 0 or abs(a.x - b.x) < 25)) or (a.y is null and b.id - a.id in (-1, 1, 2))""")
def neighbour_rows(spark, d):
    """Boxes of every seventh line item are taken away, so that both rules are used."""
    b = boxes(spark, d)
    n = ly.carry.row_number_across(ly.segmented(b), ["image_id"], "segment", ["y", "x", "id"], "number")
    shown = F.col("id") % 7 != 0
    return ly.neighbour_rows(n.select("image_id", F.col("number").alias("id"), F.when(shown, F.col("x")).alias("x"), F.when(shown, F.col("y")).alias("y"), "w", "h"))


@query("words_in_cells", "J20", f"""
with {SQL_BOX}, c as (select p_partkey as cell_id, p_partkey % 50 as image_id, cast(p_partkey * 13 % 380 as double) as x, cast(p_partkey * 29 % 960 as double) as y, 90.0::double as w, 70.0::double as h from part)
select b.id, c.cell_id from box b join c on b.image_id = c.image_id and b.x + b.w / 2 between c.x and c.x + c.w and b.y + b.h / 2 between c.y and c.y + c.h""")
def words_in_cells(spark, d):
    k = F.col("p_partkey")
    cells = table(spark, d, "part").select(k.alias("cell_id"), (k % 50).alias("image_id"), (k * 13 % 380).cast("double").alias("x"), (k * 29 % 960).cast("double").alias("y"), F.lit(90.0).alias("w"), F.lit(70.0).alias("h"))
    return ly.words_in_cells(boxes(spark, d), cells).select("id", "cell_id")
