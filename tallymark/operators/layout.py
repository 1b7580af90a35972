"""Reading order, lines, blocks, sections, headings, tables and regions.

Boxes come as rows (image_id, x, y, w, h, ...).  Ordered steps use the segment
windows of :mod:`tallymark.operators.carry`; label text without boxes is
handled inside its own row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallymark.functions import lexicon as lx
from tallymark.functions import text as tx
from tallymark.operators import carry

# fixed values
READING_BAND = 15.0
PERCENT_BAND = 3.0
SAME_LINE = 0.55
COLUMN_GAP = 45.0
COLUMN_GAP_HEIGHTS = 3.5
BLOCK_GAP_HEIGHTS = 1.6
BLOCK_OVERLAP = 0.2
BLOCK_GAP_PERCENT = 5.0
SECTION_GAP = 200.0
SEGMENT_HEIGHT = 100.0
LARGE, SMALL = 1.5, 0.7
ISLANDS = 10_000
VALUE_BELOW, VALUE_SHIFT, VALUE_LEVEL, VALUE_BESIDE = 60, 180, 20, 80
NEIGHBOUR_DX = 25.0
GRID = 50.0
HEADINGS = [
    ("NET_QUANTITY", r"(?i)^(?:net\s+(?:quantity|qty|wt|volume|weight|mass))\b[.:;=\-]?\s*"),
    ("SERVING_SIZE", r"(?i)^(?:serving\s+size)\b[.:;=\-]?\s*"),
    ("SALE_PRICE", r"(?i)^(?:unit\s+sale\s+price|u\.?s\.?p\.?)\b[.:;=\-]?\s*"),
    ("MRP", r"(?i)^(?:m\.?r\.?p\.?|maximum\s+retail\s+price|mrp\s*\(incl\.?\s*of\s*all\s*taxes\))\b[.:;=\-]?\s*"),
    ("PRICE", r"(?i)^(?:price|sale\s+price|retail\s+price)\b[.:;=\-]?\s*"),
    ("MANUFACTURER_NAME", r"(?i)^(?:manufactured\s+(?:by|at)|mfd\s+by|produced\s+by)\b[.:;=\-]?\s*"),
    ("MARKETER_NAME", r"(?i)^(?:marketed\s+by|mkt\s+by)\b[.:;=\-]?\s*"),
    ("PACKER_NAME", r"(?i)^(?:packed\s+by|pkd\s+by)\b[.:;=\-]?\s*"),
    ("IMPORTER_NAME", r"(?i)^(?:imported\s+by|imp\s+by)\b[.:;=\-]?\s*"),
    ("DISTRIBUTOR_NAME", r"(?i)^(?:distributed\s+by)\b[.:;=\-]?\s*"),
    ("MANUFACTURING_DATE", r"(?i)^(?:mfg\s*(?:date|on|\.)?|mfd\s*(?:date|on|\.)?|date\s+of\s+mfg)\b[.:;=\-]?\s*"),
    ("PACKING_DATE", r"(?i)^(?:pkd\s*(?:date|on|\.)?|packed\s*(?:date|on|\.)?|date\s+of\s+pkd)\b[.:;=\-]?\s*"),
    ("EXPIRY_DATE", r"(?i)^(?:exp\s*(?:date|\.)?|expiry\s*(?:date)?|use\s+by|use\s+before)\b[.:;=\-]?\s*"),
    ("BEST_BEFORE_DATE", r"(?i)^(?:best\s+before|shelf\s+life)\b[.:;=\-]?\s*"),
    ("BATCH_NUMBER", r"(?i)^(?:batch\s*(?:no|number|\.)?|b\.?\s*no)\b[.:;=\-]?\s*"),
    ("LOT_NUMBER", r"(?i)^(?:lot\s*(?:no|number|\.)?)\b[.:;=\-]?\s*"),
    ("SERIAL_NUMBER", r"(?i)^(?:serial\s*(?:no|number|\.)?|s\.?\s*no)\b[.:;=\-]?\s*"),
    ("MODEL_NUMBER", r"(?i)^(?:model\s*(?:no|number|\.)?)\b[.:;=\-]?\s*"),
    ("CONSUMER_CARE", r"(?i)^(?:consumer\s+care|customer\s+(?:care|service|support)|helpline|toll\s*free)\b[.:;=\-]?\s*"),
    ("EMAIL", r"(?i)^(?:email|e-mail)\b[.:;=\-]?\s*"),
    ("WEBSITE", r"(?i)^(?:website|web)\b[.:;=\-]?\s*"),
    ("COUNTRY_OF_ORIGIN", r"(?i)^(?:country\s+of\s+origin|made\s+in)\b[.:;=\-]?\s*"),
]
NUTRIENTS = ("energy", "protein", "carbohydrate", "fat", "sugar", "sodium", "nutrient")


def segmented(boxes: DataFrame, height: float = SEGMENT_HEIGHT) -> DataFrame:
    return boxes.withColumn("segment", F.floor(F.col("y") / height))


def reading_order(boxes: DataFrame, band: float = READING_BAND, tie: str = "id") -> DataFrame:
    """Number boxes by band of y, then x.  Halves round to even."""
    b = boxes.withColumn("band", F.bround(F.col("y") / band)).withColumn("segment", F.floor(F.col("band") / 8))
    return carry.row_number_across(b, ["image_id"], "segment", ["band", "x", tie], "reading_order").drop("segment")


def _fold_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each island, for words that arrive island by island in order."""
    current, lines, made = None, [], 0
    for batch in batches:
        numbers = []
        for image, island, y, h in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("image_id", "_island", "y", "h"))):
            if (image, island) != current:
                current, lines, made = (image, island), [], 0
            cy = y + h / 2
            # A line that ends above this word ends above all that follow.
            lines = [line for line in lines if line[1] / line[3] + SAME_LINE * line[2] / line[3] >= y]
            for line in lines:
                if abs(cy - line[1] / line[3]) <= line[2] / line[3] * SAME_LINE:
                    line[1], line[2], line[3] = line[1] + cy, line[2] + h, line[3] + 1
                    numbers.append(line[0])
                    break
            else:
                made += 1
                lines.append([made, cy, h, 1])
                numbers.append(made)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "_line"])


def words_to_lines(words: DataFrame, tie: str = "id") -> DataFrame:
    """Add ``line_no`` and ``part_no``: a word joins the first line whose mean centre
    is within 0.55 of its mean height, and a wide gap to the left starts a part.

    Words are taken by y and x, and every word moves the means of its line, so
    the rule is a fold.  It runs apart in each island: a word that begins below
    centre + 0.55 height of all words before it can join none of their lines,
    nor can any word after it.  Islands of one image go to different tasks, and
    a task keeps only the lines that may still grow.
    """
    w = segmented(words)
    order = ["y", "x", tie]
    w = carry.max_before_across(w, ["image_id"], "segment", order, F.col("y") + F.col("h") / 2 + SAME_LINE * F.col("h"), "_reach")
    cut = (F.col("_reach").isNull() | (F.col("y") > F.col("_reach"))).cast("int")
    w = carry.running_sum_across(w, ["image_id"], "segment", order, cut, "_island").select(*words.columns, "_island")
    dealt = w.repartition("image_id", "_island").sortWithinPartitions("image_id", "_island", *order)
    w = dealt.mapInArrow(_fold_lines, StructType([*w.schema.fields, StructField("_line", LongType())]))
    # Lines of earlier islands come first: one row for each island is carried.
    islands = w.groupBy("image_id", "_island").agg(F.max("_line").alias("_lines")).withColumn("_seg", F.floor(F.col("_island") / ISLANDS))
    islands = carry.running_sum_across(islands, ["image_id"], "_seg", ["_island"], F.col("_lines"), "_upto").select("image_id", "_island", (F.col("_upto") - F.col("_lines")).alias("_before"))
    w = w.join(islands, ["image_id", "_island"]).withColumn("line_no", F.col("_before") + F.col("_line")).select(*words.columns, "line_no")
    # Inside one printed line the words are few; they are ordered by x.
    by_x = Window.partitionBy("image_id", "line_no").orderBy("x", tie)
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(by_x)
    wide = gap > F.greatest(F.lit(COLUMN_GAP), COLUMN_GAP_HEIGHTS * (F.col("h") + F.lag("h").over(by_x)) / 2)
    w = w.withColumn("_wide", F.coalesce(wide.cast("int"), F.lit(0)))
    return w.withColumn("part_no", F.sum("_wide").over(by_x.rowsBetween(Window.unboundedPreceding, 0))).drop("_wide")


def union_boxes(boxes: DataFrame, keys: Sequence[str], digits: int = 2) -> DataFrame:
    """Enclosing box of each group."""
    g = boxes.groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.count(F.lit(1)).alias("members"))
    return g.select(*keys, F.round("x", digits).alias("x"), F.round("y", digits).alias("y"),
                    F.round(F.col("_r") - F.col("x"), digits).alias("w"), F.round(F.col("_b") - F.col("y"), digits).alias("h"), "members")


def lines_to_blocks(lines: DataFrame, tie: str = "id") -> DataFrame:
    """Add ``block_no``: lines close below each other that overlap sideways."""
    s = segmented(lines)
    order = ["y", tie]
    s = carry.lag_across(s, ["image_id"], "segment", order, ["x", "y", "w", "h"])
    gap = F.col("y") - (F.col("prev_y") + F.col("prev_h"))
    overlap = F.least(F.col("x") + F.col("w"), F.col("prev_x") + F.col("prev_w")) - F.greatest("x", "prev_x")
    joined = (gap <= BLOCK_GAP_HEIGHTS * (F.col("h") + F.col("prev_h")) / 2) & (F.greatest(F.lit(0.0), overlap) > BLOCK_OVERLAP * F.least("w", "prev_w"))
    start = ~F.coalesce(joined, F.lit(False))
    return carry.running_sum_across(s, ["image_id"], "segment", order, start.cast("int"), "block_no").select(*lines.columns, "block_no")


def lines_to_blocks_percent(lines: DataFrame, max_gap: float = BLOCK_GAP_PERCENT) -> DataFrame:
    """Add ``block_no`` to lines whose boxes are in per cent of the image.

    Lines follow by bands of 3 % and x, lines without a box (null y) by their
    number among them.  A block goes on where a line begins 0 to 5 % below the
    one before it, or, where one of the two has no box, has the next number.
    """
    first = F.coalesce(F.bround(F.col("y") / PERCENT_BAND) * PERCENT_BAND, F.col("line_index").cast("double"))
    s = lines.withColumn("_band", first).withColumn("_x", F.when(F.col("y").isNull(), 0.0).otherwise(F.col("x"))).withColumn("segment", F.floor(F.col("_band") / SEGMENT_HEIGHT))
    order = ["_band", "_x", "line_index"]
    s = carry.lag_across(s, ["image_id"], "segment", order, ["y", "h", "line_index"])
    gap = F.col("y") - (F.col("prev_y") + F.col("prev_h"))
    joined = F.when(F.col("y").isNotNull() & F.col("prev_y").isNotNull(), gap.between(0, max_gap)).otherwise(F.col("line_index") == F.col("prev_line_index") + 1)
    start = ~F.coalesce(joined, F.lit(False))
    return carry.running_sum_across(s, ["image_id"], "segment", order, start.cast("int"), "block_no").select(*lines.columns, "block_no")


def header_of(text: Column) -> Column:
    out = None
    for name, pattern in lx.SECTION_HEADERS.items():
        out = F.when(tx.has(text, pattern), name) if out is None else out.when(tx.has(text, pattern), name)
    return out


def sections_by_box(regions: DataFrame, tie: str = "id") -> DataFrame:
    """Section of each region: a header starts one, a wide vertical gap ends it."""
    s = segmented(regions).withColumn("_header", header_of(F.col("text"))).withColumn("_bottom", F.col("y") + F.col("h"))
    order = ["y", "x", tie]
    s = carry.lag_across(s, ["image_id"], "segment", order, ["_bottom"])
    s = s.withColumn("_mark", F.coalesce("_header", F.when(F.col("y") - F.col("prev__bottom") > SECTION_GAP, "OTHER")))
    s = carry.fill_across(s, ["image_id"], "segment", order, "_mark", "section")
    return s.select(*regions.columns, F.coalesce("section", F.lit("OTHER")).alias("section"))


def sections_in_text(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per line with the section it belongs to, from the ``lines`` array.

    Each header is repeated up to the next one, which keeps the work linear in
    the number of lines.
    """
    marks = F.filter(F.transform("lines", lambda l, i: F.struct(i.alias("at"), header_of(l["text"]).alias("name"))), lambda m: m["name"].isNotNull())
    d = df.select(*keys, "lines", marks.alias("marks"))
    m, n = F.col("marks"), F.size("lines")
    lead = F.array_repeat(F.lit("OTHER"), F.coalesce(F.get(m, F.lit(0))["at"], n))
    body = F.flatten(F.transform(m, lambda h, k: F.array_repeat(h["name"], F.coalesce(F.get(m, k + 1)["at"], n) - h["at"])))
    d = d.select(*keys, "lines", F.concat(lead, body).alias("sections"))
    return d.select(*keys, F.inline(F.zip_with("lines", "sections", lambda l, s: F.struct(l["line_index"].alias("line_index"), l["text"].alias("text"), s.alias("section")))))


def heading_of(text: Column) -> Column:
    """struct<field,value>: the heading a line starts with and the rest of the line."""
    out = None
    for field, pattern in HEADINGS:
        verdict = F.struct(F.lit(field).alias("field"), F.btrim(F.regexp_replace(text, pattern, ""), F.lit(" :;=-")).alias("value"))
        out = F.when(tx.has(text, pattern), verdict) if out is None else out.when(tx.has(text, pattern), verdict)
    return out


def heading_values(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Heading-value pairs: same line .98, else the next line .94.

    Expects the columns of ``explode_lines``.  A value line follows exactly one
    line, so it cannot be used twice.
    """
    # The generator drops lines without a heading; a filter would read each line twice.
    found = F.filter(F.array(F.struct(heading_of(F.col("text")).alias("_h"))), lambda x: x["_h"].isNotNull())
    h = lines.select(*lines.columns, F.inline(found)).withColumn("_n", heading_of(F.col("next1")))
    same = F.col("_h.value") != ""
    below = F.when(F.col("_n").isNull(), F.col("next1"))
    return h.select(*keys, "line_index", F.col("_h.field").alias("field"), F.when(same, F.col("_h.value")).otherwise(below).alias("value"),
                    F.when(same, "SAME_LINE").otherwise("PROXIMITY").alias("association"), F.when(same, 0.98).otherwise(0.94).alias("confidence")).filter("value is not null")


def heading_values_by_box(regions: DataFrame, tie: str = "id") -> DataFrame:
    """Heading-value pairs of regions with boxes: same region .98, else the next region .94.

    Regions follow by y, x and ``tie``.  A heading without a value of its own
    takes the region after it, if that is no heading and lies close: at most 60
    below with less than 180 between the left edges, or less than 20 off its
    level and at most 80 to the right.  A region follows one region only, so it
    is a value once.
    """
    s = segmented(regions.withColumn("text", tx.strip(F.coalesce("text", F.lit("")))))
    order = ["y", "x", tie]
    s = carry.lag_across(s, ["image_id"], "segment", order, [tie, "text", "x", "y", "w", "h"], prefix="up_")
    s = s.select("*", heading_of(F.col("text")).alias("_own"), heading_of(F.col("up_text")).alias("_up"))
    below, right = F.col("y") - (F.col("up_y") + F.col("up_h")), F.col("x") - (F.col("up_x") + F.col("up_w"))
    under = below.between(0, VALUE_BELOW) & (F.abs(F.col("x") - F.col("up_x")) < VALUE_SHIFT)
    beside = (F.abs(F.col("y") - F.col("up_y")) < VALUE_LEVEL) & (right >= 0) & (right < VALUE_BESIDE)
    taken = F.col("_own").isNull() & (F.col("text") != "") & (F.col("_up.value") == "") & (under | beside)

    def pair(heading: Column, value_of: str, head_id: str, kind: str, sure: float) -> Column:
        return F.struct(F.col(head_id).alias("heading_id"), F.col(tie).alias("value_id"), heading["field"].alias("field"), F.col(value_of).alias("value"), F.lit(kind).alias("association"), F.lit(sure).alias("confidence"))

    found = F.when(F.col("_own.value") != "", pair(F.col("_own"), "_own.value", tie, "SAME_LINE", 0.98)).when(taken, pair(F.col("_up"), "text", f"up_{tie}", "PROXIMITY", 0.94))
    return s.select("image_id", found.alias("f")).filter("f is not null").select("image_id", "f.*")


def prominence(lines: DataFrame) -> DataFrame:
    """Relative size and zone of each line; the mean height is one row per image."""
    mean = lines.filter("h > 0").groupBy("image_id").agg(F.avg("h").alias("avg_height"))
    out = lines.join(mean, "image_id", "left").withColumn("avg_height", F.coalesce("avg_height", F.lit(4.0)))
    size = F.when(F.col("h") >= F.col("avg_height") * LARGE, "large").when(F.col("h") <= F.col("avg_height") * SMALL, "small").otherwise("medium")
    zone = F.when(F.col("y") < 30, "top").when(F.col("y") > 70, "bottom").otherwise("middle")
    return (out.withColumn("relative_size", size).withColumn("vertical_zone", zone)
            .withColumn("is_prominent", (size == "large") & (zone != "bottom")).withColumn("is_bottom_stamp", (zone == "bottom") | (size == "small")))


def split_products(regions: DataFrame) -> DataFrame:
    """Products per image: two when the middle band is empty and both sides have two lines."""
    span = regions.groupBy("image_id").agg(F.min("x").alias("lo"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("span"), F.count(F.lit(1)).alias("n"))
    r = regions.join(span, "image_id")
    right, lo, width = F.col("x") + F.col("w"), F.col("lo"), F.col("span")
    mid_start, mid_end = lo + width * 0.35, lo + width * 0.65
    flags = r.groupBy("image_id").agg(
        F.sum((right <= mid_start + width * 0.05).cast("int")).alias("left_n"), F.sum((F.col("x") >= mid_end - width * 0.05).cast("int")).alias("right_n"),
        F.sum(((F.col("x") < mid_end) & (right > mid_start)).cast("int")).alias("straddle_n"), F.max("n").alias("n"))
    two = (F.col("n") >= 4) & (F.col("left_n") >= 2) & (F.col("right_n") >= 2) & (F.col("straddle_n") == 0)
    return flags.select("image_id", F.when(two, 2).otherwise(1).alias("products"), "left_n", "right_n", "straddle_n")


def table_row(text: Column) -> Column:
    """struct<header,value> of a delimited line, null when it is not a pair."""
    def pair(pattern: str) -> Column:
        parts = F.split(text, pattern, 2)
        head, value = tx.strip(F.get(parts, F.lit(0))), tx.strip(F.get(parts, F.lit(1)))
        return F.when((F.length(head) > 1) & (F.length(value) > 0), F.struct(head.alias("header"), value.alias("value")))
    return F.coalesce(pair(r"[:|–—\t]"), pair(r"\s{2,}"))


def cell_fields(cells: DataFrame) -> DataFrame:
    """Cells of a table to fields: serving size and nutrition rows.

    Column 0 is the header and column 1 the value; the pivot is an aggregate
    per row of the table, combined map-side.
    """
    text = tx.strip(F.coalesce("text", F.lit("")))
    rows = cells.groupBy("table_id", "row_index").agg(
        F.max(F.when(F.col("col_index") == 0, text)).alias("header"), F.max(F.when(F.col("col_index") == 1, text)).alias("value"))
    low = F.lower("header")
    nutrient = F.lit(False)
    for w in NUTRIENTS:
        nutrient = nutrient | F.contains(low, F.lit(w))
    serving = F.contains(low, F.lit("serving size")) | F.contains(low, F.lit("per serving"))
    kind = F.when(serving, "SERVING_SIZE").when(nutrient, "NUTRITION_INFORMATION")
    out = rows.filter((F.col("header") != "") & (F.col("value") != "")).withColumn("semantic_type", kind).filter("semantic_type is not null")
    return out.withColumn("field_value", F.when(serving, F.col("value")).otherwise(F.concat_ws(": ", "header", "value"))).withColumn("confidence", F.when(serving, 0.98).otherwise(0.96))


def neighbours(boxes: Column, max_dy: float = 14.0) -> Column:
    """Per box of one image the indexes of its neighbours, from an array of boxes."""
    def near(a: Column) -> Column:
        def test(b: Column) -> Column:
            dy = F.abs(b["y"] - (a["y"] + a["h"]))
            overlap = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
            return (b["id"] != a["id"]) & (dy <= max_dy) & ((overlap > 0) | (F.abs(a["x"] - b["x"]) < 25.0))
        return F.transform(F.filter(boxes, test), lambda b: b["id"])
    return F.transform(boxes, lambda a: F.struct(a["id"].alias("id"), near(a).alias("near")))


def neighbour_rows(lines: DataFrame, max_dy: float = 14.0) -> DataFrame:
    """(image_id, id, near): pairs of lines of an image that stand close, as rows.

    ``near`` begins at most ``max_dy`` off the lower edge of the line and
    overlaps it sideways, or has its left edge within 25.  Lines meet by bands
    of y and cells of x; a pair is taken in one cell only, that of the greater
    left end.  A line without a box (null y) has its neighbours by number
    instead: ``id`` - 1, + 1 and + 2, with or without a box.
    """
    boxed = lines.filter(F.col("y").isNotNull())
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / GRID), F.floor(high / GRID)))
    reach = F.greatest(F.col("x") + F.col("w"), F.col("x") + NEIGHBOUR_DX)
    lower = F.col("y") + F.col("h")
    targets = boxed.select("image_id", "id", "x", "w", lower.alias("lower"), (F.col("x") - NEIGHBOUR_DX).alias("left"), reach.alias("right"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(lower / max_dy) + d)).alias("band"))
    targets = targets.withColumn("cell", cells(F.col("left"), F.col("right")))
    others = boxed.select("image_id", F.col("id").alias("near"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"), F.floor(F.col("y") / max_dy).alias("band")).withColumn("cell", cells(F.col("x2"), F.col("x2") + F.col("w2")))
    overlap = F.least(F.col("x") + F.col("w"), F.col("x2") + F.col("w2")) - F.greatest("x", "x2")
    once = F.col("cell") == F.floor(F.greatest("left", "x2") / GRID)
    close = (F.col("id") != F.col("near")) & (F.abs(F.col("y2") - F.col("lower")) <= max_dy) & ((overlap > 0) | (F.abs(F.col("x") - F.col("x2")) < NEIGHBOUR_DX))
    by_box = targets.join(others, ["image_id", "band", "cell"]).filter(once & close).select("image_id", "id", "near")
    steps = lines.filter(F.col("y").isNull()).select("image_id", "id", F.explode(F.array(F.col("id") - 1, F.col("id") + 1, F.col("id") + 2)).alias("near"))
    return by_box.unionByName(steps.join(lines.select("image_id", F.col("id").alias("near")), ["image_id", "near"]).select("image_id", "id", "near"))


def words_in_cells(words: DataFrame, cells: DataFrame, grid: float = 50.0) -> DataFrame:
    """Word to table cell by its centre.

    Cells are registered in every grid square they touch, so the join is an
    equi-join on (image, square) and not a comparison of all pairs.  The planner
    knows nothing of the squares and takes the cells for as small as their
    table; the hint keeps it from sending them whole to every task.
    """
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    w = words.withColumn("cx", cx).withColumn("cy", cy).withColumn("gx", F.floor(cx / grid)).withColumn("gy", F.floor(cy / grid))
    steps = lambda a, b: F.sequence(F.floor(a / grid), F.floor(b / grid))
    c = cells.select("image_id", "cell_id", F.col("x").alias("c_x"), F.col("y").alias("c_y"), F.col("w").alias("c_w"), F.col("h").alias("c_h"))
    c = c.withColumn("gx", F.explode(steps(F.col("c_x"), F.col("c_x") + F.col("c_w")))).withColumn("gy", F.explode(steps(F.col("c_y"), F.col("c_y") + F.col("c_h"))))
    inside = F.col("cx").between(F.col("c_x"), F.col("c_x") + F.col("c_w")) & F.col("cy").between(F.col("c_y"), F.col("c_y") + F.col("c_h"))
    return w.join(c.hint("merge"), ["image_id", "gx", "gy"]).filter(inside).select(*words.columns, "cell_id")
