"""Label transcripts rendered from the part table, and texts of both kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.plans import sqltext as q
from tallymark.plans.registry import table
from tallymark.session import spread, spread_wide

K = "p_partkey"
PRICE = "cast(cast(p_retailprice as decimal(12,2)) as string)"
SIZE = "cast(p_size as string)"

# One SQL expression per printed line; null lines are left out.
LINES = [
    f"case when {K} % 37 = 0 then 'AKM1 O1 HA' else concat(p_name, ' ', case {K} % 9 when 0 then 'Herbal Shampoo' when 1 then 'Masala Biscuits' when 2 then 'Toilet Soap' "
    f"when 3 then 'LED Bulb' when 4 then 'Ball Pen' when 5 then 'Cotton Towel' when 6 then 'Dog Food' else 'Set' end) end",
    f"case when {K} % 10 = 3 then 'Experience the radiant glow' end",
    f"case {K} % 8 when 0 then concat('Net Qty: ', {SIZE}, ' g') when 1 then concat('Net Wt. ', {SIZE}, ' gms') when 2 then concat('Net Quantity ', {SIZE}, ' kg') "
    f"when 3 then concat('NET VOLUME: ', {SIZE}, ' ml') when 4 then concat({SIZE}, ' g') when 5 then concat('NET WT.', chr(10), {SIZE}, ' g') when 7 then concat('Net Content ', {SIZE}, ' ltr') end",
    f"case when {K} % 5 = 0 then 'Energy per 100g 250 kcal' end",
    f"case {K} % 7 when 0 then concat('MRP Rs. ', {PRICE}, ' (incl. of all taxes)') when 1 then concat('M.R.P. ₹', {PRICE}, ' inclusive of all taxes') when 2 then concat('MRP: ', {PRICE}) "
    f"when 3 then concat('Rs. ', {PRICE}, '/-') when 5 then concat('Max Retail Price Rs ', {PRICE}, chr(10), 'Inclusive of all taxes') when 6 then concat('MRP ₹', {PRICE}, ' USP ₹1.20/g') end",
    f"case {K} % 6 when 0 then 'Mfd by: Acme Foods Pvt Ltd' when 1 then concat('Manufactured by:', chr(10), 'Bharat Mills Limited') when 2 then 'Marketed by Zenith Traders, Sector 18, Gurugram 122015' "
    f"when 3 then 'Imported by: Globex Imports LLP' when 5 then 'Packed by Sunrise Packers' end",
    f"case when {K} % 4 <> 3 then 'Plot No 12, Industrial Area, Phase II' end",
    f"case {K} % 3 when 0 then concat('Noida, Uttar Pradesh - 2013', lpad(cast({K} % 100 as string), 2, '0')) when 1 then 'Gurugram, Haryana' else 'Fort, Mumbai 400001' end",
    f"case when {K} % 11 = 0 then '' end",
    f"case when {K} % 5 = 4 then null when {K} % 13 = 0 then 'Mfg Date: 0?/2024' else concat('Mfg Date: ', lpad(cast(1 + {K} % 12 as string), 2, '0'), '/2024') end",
    f"case {K} % 5 when 0 then 'Best Before 12 months from mfg' when 1 then 'Expiry Date: 05/2026' when 2 then 'Use by Jan 2027' when 3 then 'Pkd: 04/2024' end",
    f"case {K} % 4 when 0 then concat('Batch No: B', cast({K} as string)) when 1 then concat('Lot No. L-', cast({K} as string)) when 2 then concat('Model No: MX', cast({K} as string), ' SKU: S', {SIZE}) end",
    f"case {K} % 3 when 0 then 'Customer Care: 1800-123-4567 care@acme.in' when 1 then 'Toll free 9876543210' end",
    f"case {K} % 6 when 0 then 'Country of Origin: India' when 3 then 'Made in China' end",
    f"case {K} % 4 when 0 then 'Ingredients: Aqua, Glycerin, Sugar' when 1 then 'Wheat Flour, Sugar, Palm Oil 12 g' end",
    f"case when {K} % 9 = 0 then 'Directions: Apply evenly on skin' end",
    f"case when {K} % 8 = 1 then 'Keep out of reach of children' end",
    f"case when {K} % 12 = 5 then '| - - ---' end",
]
LABEL_TEXT = "concat_ws(chr(10), " + ", ".join(LINES) + ")"


def labels(spark: SparkSession, data_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, data_dir, "part")).selectExpr("p_partkey as doc_id", f"{LABEL_TEXT} as text", *more)


def texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rendered labels and the driver's documents as one corpus of whole texts."""
    docs = spread_wide(table(spark, data_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    own = labels(spark, data_dir).withColumn("doc_id", F.concat(F.lit("L"), F.col("doc_id").cast("string")))
    return own.unionByName(docs)


STRIPPED = q.strip("raw")

SQL_LABELS = f"label_src as (select p_partkey as doc_id, p_size, p_brand, p_type, p_retailprice, {LABEL_TEXT} as text from part)"
SQL_TEXTS = (
    f"text_src as (select 'L' || cast(p_partkey as varchar) as doc_id, {LABEL_TEXT} as text from part "
    "union all select 'D' || cast(doc_id as varchar), text from documents)"
)


def sql_lines(source: str) -> str:
    """CTEs ``lines`` and ``ctx`` (two neighbours on both sides) over ``source``."""
    return f"""
cut as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_index from {source}),
lines as (select doc_id, line_index, {STRIPPED} as text from cut where {STRIPPED} <> ''),
ctx as (select *, row_number() over w as position, lag(text, 1) over w as prev1, lag(text, 2) over w as prev2, lead(text, 1) over w as next1, lead(text, 2) over w as next2
  from lines window w as (partition by doc_id order by line_index))"""


WITH_LABEL_LINES = f"with {SQL_LABELS}, {sql_lines('label_src')}"
WITH_TEXT_LINES = f"with {SQL_TEXTS}, {sql_lines('text_src')}"
