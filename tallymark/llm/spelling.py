"""Spelling variants: words one edit apart, found through pivotal grams.

Bigrams are ordered by how many words hold them.  The gram prefix of a word is
its three rarest bigrams (with all places of the last one); its pivots are two
disjoint bigrams of these, chosen by dynamic programming so that the lists they
open are shortest.  One edit touches one of two disjoint grams at most.  Of two
near words take the one whose prefix ends first in the order: the pivot that the
edit leaves alone is then in the prefix of the other word.

Position limits are sharp for one edit, because all of a word on one side of it
stays as it is.  An edit behind the left pivot leaves everything up to that
pivot, in place; any other leaves everything from the right pivot on, at the
same distance from the end.  The two letters at the far end are either left too,
and belong to the key, or hold the edit, and then all before them is left.  So a
word probes with four keys, and candidates are verified by their edit distance.

Grams are over a fixed alphabet, so their order is a table of at most 8,100 rows
whatever the corpus, and a word has fewer than 3,000 near words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import LOWER
from tallymark.session import cut_lineage

#: Fixed values of the contract.
LETTERS = "a-zÀ-ÿ"
MIN_CHARS = 7
MIN_COUNT = 2
DELETE_EVERY = 31
FACTOR = 10
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
PREFIX, PIVOTS, EDGE = 3, 2, 2
#: Letters after lower-casing A-Z: 26 and 64, so so many bigrams at most.
MOST_GRAMS = 90 * 90


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long_run = re.compile(f"[{LETTERS}]{{{MIN_CHARS},}}")
    held: Counter[str] = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            start = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
            for word in long_run.findall((text.as_py() or "").encode().translate(LOWER).decode()):
                h = zlib.crc32(word.encode(), start)
                if h % DELETE_EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                held[word] += 1
            if len(held) > HELD:
                yield hand_on()
    if held:
        yield hand_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of ``docs`` that is long and frequent enough.

    Shorter runs cannot become words, so they are not looked at.  A null text
    has no words; a null doc_id is written as nothing before the colon.
    """
    counted = docs.select(docs["doc_id"], docs["text"]).mapInArrow(_count, "word string, n bigint")
    return counted.filter(F.char_length("word") >= MIN_CHARS).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def pivots(places: list[int], cost: list[int], picks: int = PIVOTS) -> tuple[int, ...]:
    """``picks`` disjoint bigram places of the least total cost; places rise, and ties go to the left.

    best[k] is the cheapest choice of k places among those seen so far; a place
    extends the best choice of k - 1 that ends two letters before it.
    """
    done: list[list[tuple[int, tuple[int, ...]]]] = []
    for i, place in enumerate(places):
        before = next((done[j] for j in range(i - 1, -1, -1) if places[j] <= place - 2), [(0, ())])
        so_far = list(done[-1]) if done else [(0, ())]
        for k, (spent, chosen) in enumerate(before[:picks], start=1):
            choice = (spent + cost[i], (*chosen, place))
            if k == len(so_far):
                so_far.append(choice)
            elif choice < so_far[k]:
                so_far[k] = choice
        done.append(so_far)
    return done[-1][picks][1]


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], tuple[int, ...]]:
    """Rank of the last prefix gram, places of the prefix grams, places of the pivots.

    ``order`` gives a bigram's rank, rare ones first, and the number of words that hold it.
    """
    grams = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = grams[PREFIX - 1][0]
    first = sorted((i, many) for (_, many), i in grams[:PREFIX])
    return last[0], [i for rank, i in grams if rank <= last], pivots([i for i, _ in first], [many for _, many in first])


def probes(word: str, left: int, right: int) -> list[tuple[str, str]]:
    """The keys a word looks for: kept up to its left pivot, or from its right pivot on."""
    return [("L", f"{word[: left + 2]} {word[-EDGE:]}"), ("l", word[:-EDGE]), ("R", f"{word[:EDGE]} {word[right:]}"), ("r", word[EDGE:])]


def postings(word: str, places: list[int]) -> set[tuple[str, str]]:
    """The keys a word is found under: one for each prefix gram and side, and its ends for every length that one edit can give."""
    n = len(word)
    out = {("L", f"{word[: p + 2]} {word[-EDGE:]}") for p in places if p + 2 + EDGE <= n} | {("R", f"{word[:EDGE]} {word[p:]}") for p in places if p >= EDGE}
    for other in (n - 1, n, n + 1):
        kept = other - EDGE
        out |= {("l", word[:kept]), ("r", word[n - kept :])}
    return out


def near_words(words: DataFrame) -> DataFrame:
    """Distinct pairs (a, n_a, b, n_b), a < b, of words of ``words`` (word, n) exactly one edit apart."""
    spark = words.sparkSession
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).orderBy("many", "gram").limit(MOST_GRAMS).collect()
    sent = spark.sparkContext.broadcast({r["gram"]: (rank, r["many"]) for rank, r in enumerate(counted)})

    def keys(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = sent.value
            for batch in batches:
                kinds, texts, row, lasts = [], [], [], []
                for i, word in enumerate(batch.column(0).to_pylist()):
                    last, places, (left, right) = signature(word, order)
                    for kind, text in probes(word, left, right) if probing else postings(word, places):
                        kinds.append(kind)
                        texts.append(text)
                        row.append(i)
                        lasts.append(last)
                row = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string()), batch.column(0).take(row), batch.column(1).take(row), pa.array(lasts, pa.int32())], ["kind", "text", "word", "n", "last"])

        name = (lambda c: c) if probing else (lambda c: f"{c}_2")
        made = words.select("word", "n").mapInArrow(run, "kind string, text string, word string, n bigint, last int")
        return made.select(F.xxhash64("kind", "text").alias("key"), *[F.col(c).alias(name(c)) for c in ("word", "n", "last")])

    met = keys(True).join(keys(False), "key").filter(
        (F.col("last") <= F.col("last_2")) & (F.abs(F.char_length("word") - F.char_length("word_2")) <= 1) & (F.levenshtein("word", "word_2", 1) == 1))
    ours, theirs, first = F.struct("word", "n"), F.struct(F.col("word_2").alias("word"), F.col("n_2").alias("n")), F.col("word") < F.col("word_2")
    ends = met.select(F.when(first, ours).otherwise(theirs).alias("a"), F.when(first, theirs).otherwise(ours).alias("b"))
    return ends.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to.

    A form is ten times as frequent as its word, so a path has fewer than 20
    steps, and each round doubles the steps taken.
    """
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of ``docs`` (doc_id and text are read).

    A word without a near word that is frequent enough has no form and is its
    own root.  Empty and null texts give no words, a text of any length is read
    whole, repeated rows count each time, ties go to the smaller word, and an
    empty table gives no rows.
    """
    words = cut_lineage(vocabulary(docs))
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionAll(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    ranked = cut_lineage(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.minus") >= F.col("n") * FACTOR, F.col("best")).alias("best")))
    forms = ranked.filter("best is not null").select("word", F.col("best.other").alias("form"))
    met = ranked.join(roots(forms), "word", "left")
    return met.select("word", F.col("best.other").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.minus")).alias("form_n"))


#: Near words agree without one letter, at one place in both or in the longer; the checksum is taken bit by bit.
SQL = r"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents),
long_runs as (select run, coalesce(doc_id::varchar, '') || ':' || run as said from runs where length(run) >= 7),
sums as (
  select run, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(said))), lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) as h from long_runs),
spelt as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from sums),
words as (select word, count(*) as n from spelt where length(word) >= 7 group by word having count(*) >= 2),
shapes as (
  select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as shape from words, unnest(range(length(word))) as r(i)),
shorter as (select distinct x.word, x.n, y.word as other, y.n as other_n from words x join shapes y on x.word = y.shape),
pairs as (
  select x.word, y.word as other, y.n as other_n from shapes x join shapes y on x.shape = y.shape and x.i = y.i and x.word <> y.word
  union all select word, other, other_n from shorter union all select other, word, n from shorter),
best as (select word, count(*) as n_near, max(other_n) as top from pairs group by word),
named as (select p.word, min(p.other) as other from pairs p join best b on b.word = p.word and b.top = p.other_n group by p.word),
ranked as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.top >= 10 * w.n then m.other end as form, case when b.top >= 10 * w.n then b.top end as form_n
  from words w left join best b on b.word = w.word left join named m on m.word = w.word),
paths as (
  select word, word as at from ranked union all select p.word, r.form from paths p join ranked r on r.word = p.at where r.form is not null)
select r.word, r.form, p.at as root, r.n::bigint as n, r.n_near::bigint as n_near, r.form_n::bigint as form_n
from ranked r join paths p on p.word = r.word join ranked e on e.word = p.at and e.form is null
"""
