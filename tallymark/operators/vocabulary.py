"""Categories by a vocabulary table: every phrase looked up by its words, however many phrases there are.

A vocabulary is a table (category, kind, subcategory, phrase): keywords that
score for a category, and words that tell its sub-category.  A text is cut at
word borders once; each word stands with those that follow it, as many as the
longest phrase has.  Words that begin phrases stay, once for each length of
these, and meet the vocabulary by an equi-join on the whole phrase.  No
expression grows with the vocabulary, and texts are not compared with phrases
that do not begin in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.session import cut_lineage

# fixed values: hundredths for each hit, the most for one phrase, and the gates
LONG_WORD, SHORT_WORD, SHORT_CHARS, MOST = 15, 8, 3, 40
LEAST, HIGHEST, OPEN, CLOSE, SURE = 15, 99, 35, 12, 70
CONFIRMED = 55
IMPORTED, IMPORT_POINTS = "IMPORTED_PRODUCT", 30
IMPORT_WORDS = ("imported by", "importer", "country of origin", "made in", "product of")

LONGEST_PHRASE = 64
# A table of so many bytes, by its letters and so many for each row, is sent to all tasks.
SENT_BYTES, ROW_BYTES = 32 << 20, 64


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header: category, kind (keyword or sub), subcategory, phrase."""
    return spark.read.option("header", True).schema("category string, kind string, subcategory string, phrase string").csv(path)


def _pieces(low: Column) -> Column:
    return F.array_remove(F.split(low, r"\b"), "")


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be sent to all tasks if its measured size allows; it is written once, so that it is not made again."""
    held = cut_lineage(table)
    chars = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in held.columns), F.lit(0))
    size = held.agg(F.coalesce(F.sum(chars * 4 + ROW_BYTES), F.lit(0))).first()[0]
    return F.broadcast(held) if size <= SENT_BYTES else held


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, phrase, hits): how often each of the distinct phrases stands in a text, as whole words and without regard to case.

    A phrase that overlaps itself counts at every place.  Phrases without a
    word are not looked for; one of more than 64 pieces is an error.  A word
    that no phrase begins with is not sent anywhere.
    """
    known = phrases.select(F.lower("phrase").alias("phrase")).distinct().withColumn("_p", _pieces(F.col("phrase")))
    known = cut_lineage(known.filter(F.col("phrase").rlike(r"^\w")).select("phrase", F.size("_p").alias("many"), F.get("_p", F.lit(0)).alias("first")))
    longest = known.agg(F.coalesce(F.max("many"), F.lit(1))).first()[0]
    if longest > LONGEST_PHRASE:
        raise ValueError(f"a phrase has {longest} pieces")
    cut = docs.select(F.col(key), _pieces(F.lower(F.coalesce(text_col, F.lit("")))).alias("_p"))
    # The same array, shifted by one piece for every place in a phrase: one row holds a word and what follows it.
    shifted = F.arrays_zip(*[F.slice("_p", F.lit(k + 1), F.greatest(F.size("_p"), F.lit(1))).alias(f"p{k}") for k in range(longest)])
    words = cut.select(key, F.inline(shifted)).toDF(key, *[f"p{k}" for k in range(longest)]).filter(F.col("p0").rlike(r"^\w"))
    # A word asks once for each length of the phrases that begin with it, however many these are.
    lengths = _small(known.select("first", "many").distinct())
    met = words.join(lengths, words.p0 == lengths["first"])
    said = met.select(key, F.array_join(F.slice(F.array(*[F.col(f"p{k}") for k in range(longest)]), F.lit(1), F.col("many")), "").alias("phrase"))
    return said.join(_small(known.select("phrase")), "phrase").groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("hits"))


def vocabulary_categories(docs: DataFrame, vocabulary: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """category, subcategory, confidence, status and runner_up of every text (``key`` is unique).

    A keyword gives .15 a hit (.08 if it has three letters at most), .40 at
    most; import wording gives .30 to ``IMPORTED_PRODUCT``.  Categories under
    .15 are no candidates; of equal ones the first by name leads.  The leader
    stays open (UNKNOWN) under .35, or under .70 when the next is closer than
    .12.  The sub-category is the first by name, of the leader's, one of whose
    words the text contains.  Points are whole hundredths, so sums are exact.
    """
    keywords = vocabulary.filter("kind = 'keyword'").select("category", F.lower("phrase").alias("phrase")).distinct()
    hits = phrase_hits(docs, keywords, key, text_col).join(_small(keywords), "phrase")
    each = F.when(F.length("phrase") > SHORT_CHARS, LONG_WORD).otherwise(SHORT_WORD)
    points = hits.select(key, "category", F.least(F.lit(MOST).cast("long"), F.col("hits") * each).alias("points"))
    low = F.lower(F.coalesce(text_col, F.lit("")))
    imported = F.lit(False)
    for word in IMPORT_WORDS:
        imported = imported | F.contains(low, F.lit(word))
    points = points.unionByName(docs.filter(imported).select(key, F.lit(IMPORTED).alias("category"), F.lit(IMPORT_POINTS).cast("long").alias("points")))
    scored = points.groupBy(key, "category").agg(F.least(F.lit(HIGHEST).cast("long"), F.sum("points")).alias("score")).filter(F.col("score") >= LEAST)
    # One row for each category that a text has words of.
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "category"))).filter("place <= 2")
    top = ranked.groupBy(key).agg(*[F.max(F.when(F.col("place") == p, F.col(c))).alias(f"{c}{p}") for p in (1, 2) for c in ("category", "score")])
    subs = _small(vocabulary.filter("kind = 'sub'").groupBy(F.col("category").alias("category1"), F.lower("phrase").alias("_word")).agg(F.min("subcategory").alias("subcategory")))
    held = docs.select(key, low.alias("_low")).join(top.select(key, "category1"), key).join(subs, "category1").filter(F.contains("_low", F.col("_word")))
    sub = held.groupBy(key).agg(F.min("subcategory").alias("subcategory"))
    out = docs.select(key).join(top, key, "left").join(sub, key, "left")
    close = F.coalesce((F.col("score1") - F.col("score2") < CLOSE) & (F.col("score1") < SURE), F.lit(False))
    score = F.coalesce("score1", F.lit(0).cast("long"))
    return out.select(
        key, F.when(close | (score < OPEN), "UNKNOWN").otherwise(F.col("category1")).alias("category"), F.when(~(score < OPEN) | close, F.col("subcategory")).alias("subcategory"), (score / 100).alias("confidence"),
        F.when(~close & (score >= CONFIRMED), "CONFIRMED").otherwise("NEEDS_REVIEW").alias("status"), F.col("category2").alias("runner_up"))
