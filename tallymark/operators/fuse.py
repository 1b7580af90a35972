"""Fusion of readings and fields from several panels, engines or variants."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import text as tx
from tallymark.operators import carry
from tallymark.operators import classify as cl
from tallymark.session import cut_lineage

# fixed values
EMPTY_WORDS = ("", "not_visible", "unknown", "none")
COEXIST = ("SERVING_SIZE", "INGREDIENT_QUANTITY")
CONFLICT_CONFIDENCE = 0.45
AGREEMENT_BONUS = 0.03
GRID = 50.0
# Readings of an image up to which one task groups it, and pairs of texts whose edits are counted at once.
MOST_READINGS = 128
PAIRS_AT_ONCE = 4096


def merge_fields(sources: DataFrame, keys: tuple[str, str] = ("product_id", "field_name"), ord_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Unified fields and the candidates of conflicting ones.

    Input: one row per source (keys, value, unit, status, confidence, image_id,
    panel, ord).  First level: best source per distinct value; second level:
    one value is CONFIRMED, several are a CONFLICT.  Both combine map-side.
    """
    value = F.btrim(F.coalesce("value", F.lit("")))
    skip = F.col("status").isin("NOT_APPLICABLE", "NOT_VISIBLE") & (value == "")
    s = sources.filter(~skip).withColumn("_v", value).withColumn("confidence", F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.90))
    s = s.withColumn("_n", F.when(~F.lower("_v").isin(*EMPTY_WORDS), F.lower("_v")))
    best = F.max_by(F.struct(F.col("_v").alias("value"), "image_id", "panel", "confidence"), F.struct("confidence", -F.col(ord_col)))
    per_value = s.groupBy(*keys, "_n").agg(
        best.alias("b"), F.max("confidence").alias("top"), F.min(F.when(F.col("unit").isNotNull(), F.struct(F.col(ord_col), F.col("unit")))).alias("u"), F.count(F.lit(1)).alias("n"))
    real = F.col("_n").isNotNull()
    merged = per_value.groupBy(*keys).agg(
        F.sum(real.cast("int")).alias("values"), F.max_by("b.value", F.when(real, F.struct("top", "b.value"))).alias("v"),
        F.max(F.when(real, F.col("top"))).alias("c"), F.min("u").alias("u"), F.sum("n").alias("sources"))
    status = F.when(F.col("values") == 0, "NOT_VISIBLE").when(F.col("values") == 1, "CONFIRMED").otherwise("CONFLICT")
    sure = F.col("values") == 1
    unified = merged.select(*keys, status.alias("status"), F.when(sure, F.col("v")).alias("value"), F.when(sure, F.col("c")).otherwise(0.0).alias("confidence"),
                            F.col("u.unit").alias("unit"), "sources")
    clash = unified.filter("status = 'CONFLICT'").select(*keys)
    candidates = per_value.filter(real).join(clash, list(keys), "left_semi").select(*keys, "b.*")
    return unified, candidates


def fold_best_field(fields: Column) -> Column:
    """Exact left fold over the surfaces of one scan (array in surface order).

    A later field replaces the kept one when it is Found and the kept one is
    not, or when it is surer and the kept one is not Defective.
    """
    def step(kept: Column, f: Column) -> Column:
        better = ((f["status"] == "Found") & (kept["status"] != "Found")) | ((f["confidence"] > kept["confidence"]) & (kept["status"] != "Defective"))
        return F.when(better, f).otherwise(kept)
    return F.aggregate(F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))), F.get(fields, F.lit(0)), step)


def first_found_field(fields: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """Variant for long tables: the first Found field, else the first of all."""
    body = F.struct(*[F.col(c) for c in fields.columns if c not in keys])
    return fields.groupBy(*keys).agg(F.min_by(body, F.struct((F.col("status") != "Found").alias("late"), F.col(ord_col))).alias("f")).select(*keys, "f.*")


def first_filled_attributes(rows: DataFrame, keys: list[str], attributes: list[str], ord_col: str = "ord") -> DataFrame:
    """Per scan the first non-blank value of each attribute, in surface order."""
    pick = lambda c: F.min(F.when(F.btrim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.struct(F.col(ord_col).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return rows.groupBy(*keys).agg(*[pick(c) for c in attributes])


def consistency(readings: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Do all surfaces agree on a number?  Minimum and maximum decide."""
    shown = F.when(F.col(value) > 0, F.col(value))
    g = readings.groupBy(*keys).agg(F.count(shown).alias("panels"), F.min(shown).alias("lo"), F.max(shown).alias("hi"))
    return g.withColumn("verdict", F.when(F.col("panels") < 2, "SINGLE").when(F.col("lo") != F.col("hi"), "CONFLICT").otherwise("CONSISTENT"))


def apply_consistency(fields: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Conflict: Under Review at .45; agreement: +.03, at most .99."""
    j = fields.join(verdicts.select(*keys, "verdict"), keys, "left")
    clash, agree = F.col("verdict") == "CONFLICT", F.col("verdict") == "CONSISTENT"
    return (
        j.withColumn("status", F.when(clash, "Under Review").otherwise(F.col("status")))
        .withColumn("confidence", F.when(clash, CONFLICT_CONFIDENCE).when(agree, F.least(F.lit(0.99), F.col("confidence") + AGREEMENT_BONUS)).otherwise(F.col("confidence")))
    )


def policy_merge(fields: DataFrame, scan: str = "scan_id", ord_col: str = "ord") -> DataFrame:
    """Merge panel fields by the policy of their meaning.

    Serving and ingredient quantities coexist; net quantity and price conflict
    when values differ, otherwise the front panel (or the surest reading) is
    kept; all other meanings are kept whole.
    """
    value = F.lower(F.trim(F.col("value").cast("string")))
    front = F.lower("panel").rlike("pdp|front")
    stats = fields.groupBy(scan, "meaning").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.min(F.struct((~front).alias("b"), F.col(ord_col).alias("o")))["o"].alias("_front"),
        F.max_by(F.col(ord_col), F.struct("confidence", -F.col(ord_col))).alias("_sure"))
    j = fields.join(stats, [scan, "meaning"])
    unique = F.col("meaning").isin("NET_QUANTITY", "MRP") & (F.col("_n") > 1)
    clash = unique & (F.col("_lo") != F.col("_hi"))
    chosen = F.when(F.col("meaning") == "NET_QUANTITY", F.col("_front")).otherwise(F.col("_sure"))
    kept = j.filter(~unique | F.coalesce(clash, F.lit(False)) | (F.col(ord_col) == chosen))
    return kept.withColumn("status", F.when(F.coalesce(clash, F.lit(False)), "CONFLICT").otherwise(F.col("status"))).select(*fields.columns)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with fields x, y, w, h."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = w * h
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def cluster_readings(readings: Column) -> Column:
    """Readings of one image (array in order) to arrays of agreeing readings.

    A reading joins the first group whose first member overlaps it (IoU above
    .35, or above .15 with similar text).
    """
    def same(group: Column, r: Column) -> Column:
        head = F.get(group, F.lit(0))
        overlap = iou(head, r)
        return (overlap > 0.35) | ((overlap > 0.15) & (tx.similarity(F.lower(head["text"]), F.lower(r["text"])) > 0.55))

    def step(groups: Column, r: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: same(g, r)), True)
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(r))).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(F.array(r))))

    return F.aggregate(readings, F.array(F.slice(readings, 1, 0)), lambda acc, r: step(F.filter(acc, lambda g: F.size(g) > 0), r))


def reading_pairs(readings: DataFrame) -> DataFrame:
    """(image_id, a, b): readings a < b (by ord) of an image that agree: IoU above .35, or above .15 with similar text.

    Such boxes overlap, so readings meet in the cells of a grid that they
    touch; a pair is taken in one cell only, that of the upper left corner of
    the intersection.
    """
    steps = lambda low, size: F.explode(F.sequence(F.floor(low / GRID), F.floor((low + size) / GRID)))
    r = readings.filter((F.col("w") > 0) & (F.col("h") > 0)).select("image_id", F.col("ord").alias("a"), F.struct("x", "y", "w", "h").alias("p"), tx.strip(F.lower(F.coalesce("text", F.lit("")))).alias("t"))
    r = r.withColumn("gx", steps(F.col("p.x"), F.col("p.w"))).withColumn("gy", steps(F.col("p.y"), F.col("p.h")))
    other = r.select("image_id", "gx", "gy", F.col("a").alias("b"), F.col("p").alias("q"), F.col("t").alias("u"))
    once = (F.col("gx") == F.floor(F.greatest("p.x", "q.x") / GRID)) & (F.col("gy") == F.floor(F.greatest("p.y", "q.y") / GRID))
    met = r.join(other, ["image_id", "gx", "gy"]).filter((F.col("a") < F.col("b")) & once).select("image_id", "a", "b", "t", "u", iou(F.col("p"), F.col("q")).alias("overlap"))
    return met.filter((F.col("overlap") > 0.35) | ((F.col("overlap") > 0.15) & (tx.similarity(F.col("t"), F.col("u")) > 0.55))).select("image_id", "a", "b")


def _similar(a: np.ndarray, b: np.ndarray, texts: list[str]) -> np.ndarray:
    """Whether the texts numbered ``a`` and ``b`` have a ratio above .55; tables of edit distances are filled for many pairs at once."""
    n = np.array([len(t) for t in texts])
    out = a == b
    long = np.maximum(n[a], n[b])
    open_ = np.flatnonzero(~out & (1.0 - np.abs(n[a] - n[b]) / np.maximum(long, 1) > 0.55))
    open_ = open_[np.argsort(long[open_], kind="stable")]
    for low in range(0, len(open_), PAIRS_AT_ONCE):
        some = open_[low : low + PAIRS_AT_ONCE]
        one, other = (np.array([texts[k] for k in side[some]], dtype=f"<U{long[some[-1]]}").view(np.uint32).reshape(len(some), -1).T for side in (a, b))
        rows, columns = n[a[some]], n[b[some]]
        edits = np.where(rows == 0, columns, 0)
        before = np.tile(np.arange(len(other) + 1)[:, None], len(some))
        for i in range(1, rows.max() + 1):
            row = np.empty_like(before)
            row[0] = i
            for j in range(1, columns.max() + 1):
                row[j] = np.minimum(np.minimum(before[j], row[j - 1]) + 1, before[j - 1] + (one[i - 1] != other[j - 1]))
            ended = np.flatnonzero(rows == i)
            edits[ended] = row[columns[ended], ended]
            before = row
        out[some] = 1.0 - edits / long[some] > 0.55
    return out


def _agreeing(image: np.ndarray, node: np.ndarray, valid: np.ndarray, box: list[np.ndarray], text: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of one image, in order, whose readings agree as :func:`reading_pairs` says; rows are sorted by image and node."""
    x, y, w, h = box
    right, bottom, area = x + w, y + h, w * h
    found, shown = [], []
    step, a = 1, np.flatnonzero(valid)
    while len(a := a[a + step < len(image)]) and len(a := a[image[a] == image[a + step]]):
        p = a[valid[a + step] & (node[a] != node[a + step])]
        q = p + step
        inter = np.maximum(0.0, np.minimum(right[p], right[q]) - np.maximum(x[p], x[q])) * np.maximum(0.0, np.minimum(bottom[p], bottom[q]) - np.maximum(y[p], y[q]))
        overlap = inter / (area[p] + area[q] - inter)
        sure, open_ = overlap > 0.35, (overlap > 0.15) & (overlap <= 0.35)
        found.append((p[sure], q[sure]))
        shown.append((p[open_], q[open_]))
        step += 1
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    p, q = (np.concatenate(side) for side in zip(*shown))
    pairs, which = np.unique(np.minimum(text[p], text[q]) * len(texts) + np.maximum(text[p], text[q]), return_inverse=True)
    alike = _similar(pairs // len(texts), pairs % len(texts), texts)[which]
    return tuple(node[np.concatenate([*side, more[alike]])] for side, more in zip(zip(*found), (p, q)))


def _leaders_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image_id, ord, leader) of readings (image_id, ord, x, y, w, h, text) sorted by image and ord; an image that goes on in the next batch waits for it."""
    kept = None
    for batch in chain(batches, [None]):
        if batch is not None:
            kept = batch if kept is None else pa.concat_batches([kept, batch])
        if kept is None or not kept.num_rows:
            continue
        image = pc.fill_null(kept.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        whole = kept.num_rows
        if batch is not None and image[-1] >= 0:
            whole -= int(np.argmax(image[::-1] != image[-1])) if (image != image[-1]).any() else whole
        if whole:
            yield _leaders(kept.slice(0, whole), image[:whole])
        kept = kept.slice(whole)


def _leaders(rows: pa.RecordBatch, image: np.ndarray) -> pa.RecordBatch:
    place = pc.fill_null(rows.column(1).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    # Rows of one image and ord are one node.
    starts = np.append(True, (image[1:] != image[:-1]) | (place[1:] != place[:-1]))
    node, first = np.cumsum(starts) - 1, np.flatnonzero(starts)
    box = [pc.cast(rows.column(c), pa.float64()).to_numpy(zero_copy_only=False) for c in range(2, 6)]
    valid = (image >= 0) & (place >= 0) & (box[2] > 0) & (box[3] > 0) & ~np.isnan(box[0]) & ~np.isnan(box[1])
    said = rows.column(6).dictionary_encode()
    a, b = _agreeing(image, node, valid, box, said.indices.to_numpy(zero_copy_only=False).astype(np.int64), said.dictionary.to_pylist())
    # Node by node from the first of each image: who is led leads nobody.
    new = np.append(True, image[first][1:] != image[first][:-1])
    rank = np.arange(len(first)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    order = np.lexsort((a, b, rank[b]))
    a, b = a[order], b[order]
    leader = np.arange(len(first))
    ends = np.flatnonzero(np.append(rank[b][1:] != rank[b][:-1], True)) + 1 if len(b) else []
    low = 0
    for high in ends:
        leads = leader[a[low:high]] == a[low:high]
        led, at = np.unique(b[low:high][leads], return_index=True)
        leader[led] = a[low:high][leads][at]
        low = high
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(1).take(pa.array(first[leader[node]]))], ["image_id", "ord", "leader"])


def _groups_in_place(readings: DataFrame, rows: int) -> DataFrame:
    """:func:`reading_groups` of images of few readings, which are sent once and grouped many at a time."""
    kind = {c: readings.schema[c].dataType.simpleString() for c in ("image_id", "ord")}
    r = readings.select("image_id", "ord", "x", "y", "w", "h", tx.strip(F.lower(F.coalesce("text", F.lit("")))).alias("text"))
    return carry.together(r, "image_id", rows).sortWithinPartitions("image_id", "ord").mapInArrow(_leaders_of_batches, f"image_id {kind['image_id']}, ord {kind['ord']}, leader {kind['ord']}")


def reading_groups(readings: DataFrame) -> DataFrame:
    """(image_id, ord, leader): the first reading of the group that each reading joins.

    A reading joins the first group whose first reading it agrees with, else it
    starts one.  Readings are rows (image_id, ord, text, x, y, w, h).  Images of
    few readings are grouped whole, one after another; a dense one is spread
    over tasks.
    """
    dense, rows = carry.crowded(readings, "image_id", MOST_READINGS)
    if dense is None:
        return _groups_in_place(readings, rows)
    return _groups_in_place(readings.join(dense, "image_id", "left_anti"), rows).unionByName(_groups_across(readings.join(dense, "image_id", "left_semi")))


def _groups_across(readings: DataFrame) -> DataFrame:
    """:func:`reading_groups` of images of any number of readings: in each round, readings that no open earlier one agrees with lead and those they agree with follow."""
    edges = cut_lineage(reading_pairs(readings))
    open_, followers = edges, None
    while not open_.isEmpty():
        key = ["image_id", "a"]
        leading = open_.select(*key).join(open_.select("image_id", F.col("b").alias("a")), key, "left_anti").distinct()
        led = cut_lineage(open_.join(leading, key, "left_semi").select("image_id", "b").distinct())
        followers = led if followers is None else followers.unionByName(led)
        open_ = cut_lineage(open_.join(led, ["image_id", "b"], "left_anti").join(led.withColumnRenamed("b", "a"), key, "left_anti"))
    own = readings.select("image_id", "ord")
    if followers is None:
        return own.withColumn("leader", F.col("ord"))
    first = edges.join(followers.withColumnRenamed("b", "a"), ["image_id", "a"], "left_anti").join(followers, ["image_id", "b"], "left_semi")
    first = first.groupBy("image_id", F.col("b").alias("ord")).agg(F.min("a").alias("leader"))
    return own.join(first, ["image_id", "ord"], "left").withColumn("leader", F.coalesce("leader", "ord"))


def consensus_readings(readings: DataFrame) -> DataFrame:
    """One row for each group of agreeing readings: voted text, confidence, status, surest box, agreement and competing texts.

    A group holds the readings of one printed line, one for each pass, so its
    texts are few.
    """
    grouped = readings.join(reading_groups(readings), ["image_id", "ord"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"])
    g = grouped.groupBy("image_id", "leader").agg(texts.alias("texts"), F.count(F.lit(1)).alias("agreement"), F.max_by(F.struct("x", "y", "w", "h"), F.struct("confidence", -F.col("ord"))).alias("box"))
    g = g.withColumn("v", F.explode(F.array(character_vote(F.col("texts")))))
    sure = tx.has(F.col("v.text"), r"[\p{L}\p{N}]") & (F.col("v.confidence") >= 0.25)
    return g.select("image_id", "leader", F.col("v.text").alias("text"), F.col("v.confidence").alias("confidence"), F.when(sure, "CONFIRMED").otherwise("OCR_UNCERTAIN").alias("status"),
                    "box.*", "agreement", F.array_sort(F.array_distinct(F.filter("texts", lambda t: t != F.col("v.text")))).alias("competing"))


def character_vote(strings: Column) -> Column:
    """Majority text of several readings: struct<text,confidence>.

    A reading shared by more than half wins; otherwise each position of the
    most frequent reading is put to the vote.
    """
    counted = F.transform(F.array_distinct(strings), lambda s, i: F.struct(F.size(F.filter(strings, lambda t: t == s)).alias("n"), (-i).alias("o"), s.alias("s")))

    def vote(top: Column) -> Column:
        primary = top["s"]
        others = F.filter(strings, lambda t: t != primary)

        def position(p: Column) -> Column:
            own = F.substring(primary, p, F.lit(1))
            letters = F.concat(F.array(own), F.filter(F.transform(others, lambda t: F.substring(t, p, F.lit(1))), lambda c: c != ""))
            return F.array_max(F.transform(F.array_distinct(letters), lambda c, i: F.struct(F.size(F.filter(letters, lambda x: x == c)).alias("n"), (-i).alias("o"), c.alias("c"))))

        won = F.transform(F.sequence(F.lit(1), F.greatest(F.length(primary), F.lit(1))), position)
        share = F.size(F.filter(won, lambda x: x["n"] >= 2)) / F.greatest(F.length(primary), F.lit(1))
        clear = top["n"] > F.size(strings) / 2
        return F.struct(
            F.when(clear | (F.size(strings) == 1), primary).otherwise(F.array_join(F.transform(won, lambda x: x["c"]), "")).alias("text"),
            F.when(F.size(strings) == 1, 0.90).when(clear, F.least(F.lit(0.99), 0.85 + 0.15 * top["n"] / F.size(strings))).otherwise(
                F.round(F.least(F.lit(0.99), 0.65 + 0.30 * share), 3)).alias("confidence"))

    return tx.let(F.array_max(counted), vote)


def best_reading(readings: Column) -> Column:
    """Surest reading with an agreement bonus: struct<text,confidence,competing>."""
    ordered = F.sort_array(F.transform(readings, lambda r, i: F.struct(r["confidence"].alias("confidence"), (-i).alias("o"), r["text"].alias("text"))), asc=False)

    def verdict(rs: Column) -> Column:
        top = F.get(rs, F.lit(0))
        alike = lambda r: tx.similarity(F.lower(top["text"]), F.lower(r["text"])) >= 0.85
        n = F.size(F.filter(rs, alike))
        conf = F.when(n >= 3, F.least(F.lit(0.99), top["confidence"] + 0.10)).when(n == 2, F.least(F.lit(0.98), top["confidence"] + 0.05)).otherwise(top["confidence"])
        return F.struct(top["text"].alias("text"), F.round(conf, 2).alias("confidence"),
                        F.array_distinct(F.transform(F.filter(rs, lambda r: ~alike(r)), lambda r: r["text"])).alias("competing"))

    return tx.let(ordered, verdict)


def engine_agreement(values: Column, is_price: Column) -> Column:
    """Agreement of several engines on a field: struct<value,confidence,disagree,status>."""
    filled = F.filter(F.transform(values, tx.strip), lambda v: v != "")

    def verdict(vs: Column) -> Column:
        numbers = F.array_distinct(F.filter(F.transform(vs, lambda v: F.regexp_extract(v, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")), lambda n: n.isNotNull()))
        base = F.get(vs, F.lit(0))
        close = F.forall(vs, lambda v: tx.similarity(F.lower(base), F.lower(v)) >= 0.70)
        longest = F.array_max(F.transform(vs, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]
        out = lambda v, c, dis, s: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(dis).alias("disagree"), F.lit(s).alias("status"))
        return (
            F.when(F.size(vs) == 0, out(F.lit("Not reliably detected"), 0.0, False, "NOT DETECTED"))
            .when(F.size(F.array_distinct(vs)) == 1, out(base, 0.98, False, "VERIFIED"))
            .when(is_price & (F.size(numbers) > 1), out(F.lit("Disagreement detected"), 0.55, True, "NEEDS REVIEW"))
            .when(close, out(longest, 0.94, False, "VERIFIED"))
            .otherwise(out(F.lit("Ambiguous OCR consensus across passes"), 0.50, True, "NEEDS REVIEW"))
        )

    return tx.let(filled, verdict)


def distinct_lines(lines: Column, threshold: float = 0.85) -> Column:
    """Lines of one transcript without near repeats of earlier kept lines.

    Elements carry text and confidence; a line seen in several passes gains
    .05 (at most .99).
    """
    key = lambda t: F.lower(F.regexp_replace(t, r"[^a-zA-Z0-9]", ""))
    keys = F.transform(lines, lambda l: key(l["text"]))

    def kept(ks: Column) -> Column:
        def step(acc: Column, l: Column) -> Column:
            low = F.lower(l["text"])
            seen = F.exists(acc, lambda a: (F.abs(F.length(a["text"]) - F.length(low)) <= 0.2 * F.greatest(F.length(a["text"]), F.length(low)))
                            & (tx.similarity(F.lower(a["text"]), low) > threshold))
            repeats = F.size(F.filter(ks, lambda k: k == key(l["text"])))
            item = F.struct(l["text"].alias("text"), F.when((repeats >= 2) & (key(l["text"]) != ""), F.least(F.lit(0.99), l["confidence"] + 0.05)).otherwise(l["confidence"]).alias("confidence"))
            return F.when(seen, acc).otherwise(F.concat(acc, F.array(item)))
        empty = F.slice(F.transform(lines, lambda l: F.struct(l["text"].alias("text"), l["confidence"].alias("confidence"))), 1, 0)
        return F.aggregate(lines, empty, step)

    return tx.let(keys, kept)


def repeated_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Exact repeats over a whole line table: count per alphanumeric key.

    A plain aggregate, so a boilerplate line that fills a third of the table is
    combined in every task before it travels.
    """
    key = F.lower(F.regexp_replace("text", r"[^a-zA-Z0-9]", ""))
    return lines.withColumn("line_key", key).filter("line_key <> ''").groupBy("line_key").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(F.struct(*keys)).alias("first"))


def noise_free(readings: Column) -> Column:
    return F.filter(readings, lambda r: ~cl.is_noise(r["text"]))
