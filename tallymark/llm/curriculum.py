"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over training time 0..1, a straight ramp.
Its integral, scaled to the source's target, is the source's cumulative token
demand.  Documents of a source stand in a fixed order (by a digest of the id);
where a document's words lie in that supply, the inverse of the demand gives
its training position.  Positions are range-sorted.

Cumulative sums are taken in two levels, within (source, slice of the order)
and over the slices.  A slice is a range partition of that order, so a source
or an id with a third of all rows is spread over many.  Word counts are taken
once and written to the checkpoint folder; all later steps read that narrow
table, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Equal rows are counted together and told out again in pieces of so many.
PIECE = 1 << 16
#: Weight at the start and at the end of training, by the same turns as WEIGHTS; each pair adds up to 2.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _turn(rank: Column, values: tuple) -> Column:
    """The value whose turn it is, for a rank counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each source of (source, total): its weight, ramp and target.

    The level that all open sources share by weight is found by water filling:
    in the order of cap over weight, the sources that reach their cap come
    first, so one running sum settles which do.  Sources are few rows, one for
    each name; the windows without a key see only those.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rank = F.row_number().over(by_name) - 1
    named = sizes.select("source", "source_size", _turn(rank, weights).alias("weight"), (F.col("source_size") * repeats).alias("cap"), _turn(rank, tuple(a for a, _ in RAMPS)).alias("start"), _turn(rank, tuple(b for _, b in RAMPS)).alias("end"))
    wanted = F.lit(share) * F.sum("source_size").over(everything)
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = named.withColumns({"level": level, "place": F.row_number().over(by_cap)})
    judged = ranked.withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    shared = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("place"))).over(everything)
    target = F.when(F.col("open"), shared * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return judged.withColumn("target", target).select("source", "source_size", "weight", "start", "end", "target")


def _invert(demand: Column, start: Column, end: Column) -> Column:
    """Training time at which a ramp has met the given part (0..1) of its integral."""
    slope = end - start
    return F.when(slope == 0, demand).otherwise((F.sqrt(start * start + F.lit(2) * slope * demand) - start) / slope)


def curriculum(docs: DataFrame) -> DataFrame:
    """How often and when each document is trained on.

    One row for each distinct (doc_id, source, text), ``copies`` of it in the
    input: size, source_size, target, taken (words, for each copy), position
    and second_position (0..1, null where that pass leaves it out), passes.
    Pass p of a source offers its words again from p times its size; what lies
    before the target is taken, so the source meets its target to within a
    word, and repeated rows share alike (rounded down).  A null text has size
    0 and is never taken; a null source is a source of its own, the last;
    a null id is ordered as the empty string.  Reruns give equal rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    counted = sized.groupBy("doc_id", "source", "size", "t1", "t2").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest)
    # A slice is a range of the order down to the text, so rows of one null or repeated id do not share one.
    held = cut_lineage(counted.repartitionByRange("source", "digest", "doc_id", "size", "t1", "t2").withColumn("slice", F.spark_partition_id()))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("source", "slice").orderBy("digest", "doc_id", "size", "t1", "t2").rowsBetween(Window.unboundedPreceding, -1)
    rows = held.withColumn("within", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    slices = held.groupBy("source", "slice").agg(F.sum(words).alias("slice_size"))
    over = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(F.col("source").alias("s"), F.col("slice").alias("p"), F.coalesce(F.sum("slice_size").over(over), F.lit(0)).alias("before"))
    goals = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    plan = offsets.join(goals, F.col("s").eqNullSafe(goals.source)).drop("source")
    placed = rows.join(plan, rows.source.eqNullSafe(plan.s) & (rows.slice == plan.p)).withColumn("offset", F.col("before") + F.col("within"))
    goal, zero = F.floor("target"), F.lit(0).cast("long")

    def part(p: int) -> Column:
        return F.greatest(zero, F.least(words, goal - F.col("source_size") * p - F.col("offset")))

    def when(p: int) -> Column:
        middle = (F.col("offset") + F.col("source_size") * p + words / 2) / F.col("target")
        return F.when((words > 0) & (middle <= 1), _invert(middle, F.col("start"), F.col("end")))

    return placed.select(
        "doc_id", "source", "t1", "t2", "copies", "size", "source_size", "target", F.floor((part(0) + part(1)) / F.col("copies")).alias("taken"),
        when(0).alias("position"), when(1).alias("second_position"),
    ).withColumn("passes", F.col("position").isNotNull().cast("int") + F.col("second_position").isNotNull().cast("int"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``, range-sorted by training position, the rows left out last."""
    zero, one, piece = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(PIECE).cast("long")
    narrow = curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), "t1", "copies")
    # Equal rows leave their task as pieces, which are told out elsewhere, and their numbers let the sort part them again.
    pieces = narrow.withColumn("piece", F.explode(F.sequence(zero, F.floor((F.col("copies") - one) / piece)))).repartition("t1", "doc_id", "piece")
    copies = pieces.withColumn("copy", F.explode(F.sequence(one, F.least(piece, F.col("copies") - F.col("piece") * piece))))
    ordered = copies.orderBy(F.col("position").asc_nulls_last(), "doc_id", "piece", "copy")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


def materialise(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` in training order, each once for every pass that trains on it."""
    plan = curriculum(docs.select("doc_id", "source", "text")).filter("passes > 0")
    when = plan.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), "t1", "t2", F.array_compact(F.array("position", "second_position")).alias("times"))
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs.doc_id.alias("_d"), docs.source.alias("_s"), F.xxhash64(docs.text).alias("_1"), F.xxhash64(F.lit("second"), docs.text).alias("_2"))
    met = keyed.join(when, keyed._d.eqNullSafe(when.d) & keyed._s.eqNullSafe(when.s) & (keyed._1 == when.t1) & (keyed._2 == when.t2))
    timed = met.select("row", F.explode("times").alias("position"), "_d", "_1", "_2")
    order = ["position", "_d", "_1", "_2"]
    return timed.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(doc_id::varchar) as digest from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
named as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 as turn, source_size * 2 as cap from sources),
weighed as (select *, case turn when 0 then 5 when 1 then 2 else 1 end as weight, case turn when 0 then 1.5::double when 1 then 1.0::double else 0.5::double end as a, case turn when 0 then 0.5::double when 1 then 1.0::double else 1.5::double end as b from named),
levelled as (
  select *, row_number() over (order by cap::double / weight, source nulls last) as place,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
      / sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following)::double as level from weighed),
judged as (select *, cap::double / weight > level as open from levelled),
goals as (
  select source, source_size, a, b, case when open then (min_by(level, place) filter (open) over ()) * weight else cap::double end as target from judged),
placed as (
  select s.doc_id, s.size, g.*, (coalesce(sum(s.size) over (partition by s.source order by s.digest, s.doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as start
  from sized s join goals g on s.source is not distinct from g.source),
timed as (
  select *, (start + size / 2.0::double) / target as q from placed)
select doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::bigint - start)) + greatest(0, least(size, floor(target)::bigint - source_size - start)))::bigint as taken,
  case when size > 0 and q <= 1 then round(case when b = a then q else (sqrt(a * a + 2 * (b - a) * q) - a) / (b - a) end, 9) end as position
from timed
"""
