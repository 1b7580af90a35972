"""Line dedup: explode normalised lines, hash, count documents, drop, reassemble.

Only hashes, ids and positions of the long lines are shuffled while counting;
the text of a document moves once, to meet the positions it loses.  A line that
a third of all documents hold is first reduced to one row for each document,
then counted with partial sums; where its rows meet the small table of frequent
lines, adaptive execution splits the skewed side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: stripped white space, shortest key, fewest documents.
STRIP = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def wide_hash(value: Column) -> list[Column]:
    """128 bits in two longs."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2")]


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, kept`` of every row of ``docs``.

    A line whose key has ``min_chars`` code points and is held by ``min_docs``
    documents goes, except from the document with the largest id that holds it.
    Null or empty text is one empty line.  Rows that repeat an id are one
    document: they count once and lose or keep lines alike.  A null id is one
    document, smaller than all others.  Other columns are not read.
    """
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    # A row is known by its id and a hash of its text: positions are the same in rows that agree in both.
    keyed = named.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    exploded = keyed.select("doc_id", "t1", "t2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long_lines = exploded.select("doc_id", "t1", "t2", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "pos", *wide_hash(F.col("key")))
    holders = long_lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).drop("one")
    frequent = holders.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs).drop("n")
    gone = long_lines.join(frequent, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    lost = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("lost")).select(F.col("doc_id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "lost")
    met = keyed.join(lost, keyed.doc_id.eqNullSafe(lost.d) & (keyed.t1 == lost.u1) & (keyed.t2 == lost.u2), "left")
    split = met.select("doc_id", "text", lines_of(F.col("text")).alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    kept = F.when(F.size("lost") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return split.select("doc_id", "text", n.cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept.alias("kept"))


def line_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`drop_frequent_lines`."""
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
with lines as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
frequent as (
  select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (
  select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id <> f.last as gone from keyed k left join frequent f on f.key = k.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""
