"""MinHash near-duplicates with tensored banding, candidates confirmed on full sets.

A small collection of 16 hash groups of three minhashes each is computed; every
pair of groups is a table key of six.  48 minhashes so do the work of 720.  A
pair of texts of similarity s meets in a table when two groups agree:
1 - (1 - s^3)^16 - 16 s^3 (1 - s^3)^15, which is 0.998 at s = 0.75 and 0.9998 at
0.8, while texts that only share a passage (s = 0.2) meet with 0.008.

A group value that no other text has cannot agree, so it is dropped before
pairs are formed: texts without a relative give no table keys at all.

Equal shingle sets are one node, so copies never make pairs.  Nodes that share
a table key are first linked through the smallest node of the key: as many
candidates as nodes, not all pairs.  Confirmed links give components; only where
a key still holds several components can a link be missing.  The nodes of such
keys are compared by an exact rule, not by key: with a node's shingles in the
order of how few open nodes hold them, two linked sets have a first common
shingle early enough for what follows to reach the needed overlap.  Only pairs
of different components that meet so are confirmed on their texts.  In a group
of copies that were each edited on their own, edits come first in that order, so
just the copies with hardly an edit meet.  A candidate link is thus confirmed,
refuted exactly, or lies within a component already.  Counting by key is
pre-aggregated, and a hot key in a join is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import LOWER, Chunk, bytes_of, chunks, mix, runs
from tallymark.session import cut_lineage

WIDTH = 5
PERCENT = 75
GROUPS, ROWS = 16, 3
WORD = r"[^\x20\x09-\x0D]"
#: Stands for a null id, after all others; rows with a null id are told apart by their text.
NO_ID = 2**63 - 1


def shingles(chunk: Chunk, i: int) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted; of fewer words than a shingle the whole sequence is one."""
    words = chunk.hash[chunk.first[i] : chunk.first[i + 1]]
    if 0 < len(words) < WIDTH:
        return runs(words, len(words), seed=100 + len(words))
    return np.unique(runs(words, WIDTH))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhashes = GROUPS * ROWS
    seeds = mix(np.arange(minhashes, dtype=np.uint64), 99) | np.uint64(1)
    for batch in batches:
        texts = bytes_of(batch, "text")
        sizes, s1, s2, signed = [], [], [], []
        for _, part in chunks(texts):
            chunk = Chunk(part, table=LOWER)
            sets = [shingles(chunk, i) for i in range(len(part))]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets)
            # Every text gets one more value for its own slice, the greatest, so that empty sets have a slice too.
            at = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
            padded = np.full(len(flat) + len(sets), 2**64 - 1, dtype=np.uint64)
            place = np.arange(len(flat)) + np.repeat(np.arange(len(sets)), n)
            signature = np.empty((len(sets), minhashes), dtype=np.uint64)
            for k in range(minhashes):
                padded[place] = (flat ^ (flat >> np.uint64(32))) * seeds[k]
                signature[:, k] = np.minimum.reduceat(padded, at)
            for seed, out in ((21, s1), (22, s2)):
                padded[:] = 0
                padded[place] = mix(flat, seed)
                out.append(np.add.reduceat(padded, at))
            sizes.append(n)
            groups = np.zeros((len(sets), GROUPS), dtype=np.uint64) + np.arange(GROUPS, dtype=np.uint64)
            for k in range(ROWS):
                groups = mix(groups ^ mix(signature[:, k::ROWS], 31 + k), 30)
            signed.append(groups)
        if not texts:
            continue
        keys = np.concatenate(signed).view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, GROUPS, dtype=np.int32), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(s1).view(np.int64)), pa.array(np.concatenate(s2).view(np.int64)), lists], ["id", "t", "n", "s1", "s2", "signature"])


def signatures(docs: DataFrame) -> DataFrame:
    """id, t (text hash), n (set size), s1 and s2 (hash of the set), signature of every row."""
    return _named(docs, docs["text"].cast("binary").alias("text")).mapInArrow(_sign, "id bigint, t bigint, n bigint, s1 bigint, s2 bigint, signature array<bigint>")


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, n): a key for every pair of those group values of a node that another node has too."""
    values = nodes.select("node", "n", F.posexplode("signature").alias("group", "value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("value")
    # A node is one set, so a list holds at most GROUPS values, and each is paired with all after it.
    held = values.join(common, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("group", "value"))).alias("held"))
    paired = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice(F.col("held"), i + 2, F.size("held")), lambda y: F.xxhash64(x["value"], y["value"]))))
    return held.select("node", "n", F.explode(paired).alias("key"))


def _alike(a: str, b: str):
    """The set sizes alone allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[int, np.ndarray] | None = None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts_a, texts_b = batch.column(2), batch.column(3)
        linked = []
        for row, (left, right) in enumerate(zip(a, b)):
            if held is None or held[0] != left:
                held = (left, shingles(Chunk([texts_a[row].as_py() or b""], table=LOWER), 0))
            other = shingles(Chunk([texts_b[row].as_py() or b""], table=LOWER), 0)
            both = len(np.intersect1d(held[1], other, assume_unique=True))
            linked.append(both * 100 >= (len(held[1]) + len(other) - both) * PERCENT)
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full shingle sets are similar enough; ``texts`` has one (node, text) for each node."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a bigint, b bigint")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for first, part in chunks(texts):
            chunk = Chunk(part, table=LOWER)
            sets = [shingles(chunk, i) for i in range(len(part))]
            row = pa.array(np.repeat(np.arange(first, first + len(part)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(3)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "n", "label", "shingle"])


def first_common(open_nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of open nodes (node, n, label) of different labels that can be linked.

    A node's shingles are ordered by the number of open nodes that hold them; a
    shingle at place p leaves n - p for the overlap if it is the first common
    one.  Every linked pair is among the result.
    """
    rows = open_nodes.join(texts.select("node", "text"), "node").select("node", "n", "label", "text").mapInArrow(_shingle_rows, "node bigint, n bigint, label bigint, shingle bigint")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), (F.min("label") < F.max("label")).alias("crosses"))
    ordered = rows.join(held, "shingle").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle", "crosses"))).alias("by_rarity"))
    early = F.slice("by_rarity", F.lit(1), (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int"))
    places = cut_lineage(ordered.select("node", "n", "label", F.posexplode(early).alias("place", "s")).filter("s.crosses").select(F.col("s.shingle").alias("shingle"), "node", "n", "label", (F.col("n") - F.col("place")).alias("rest")))
    other = places.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("rest").alias("rest_b"))
    enough = F.least("rest", "rest_b") * (100 + PERCENT) >= (F.col("n") + F.col("n_b")) * PERCENT
    met = places.join(other, "shingle").filter((F.col("label") < F.col("label_b")) & enough)
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; label is the smallest node it is linked to by any path.

    Each round takes the smallest label among a node and its neighbours and
    then follows labels once more, so paths halve.  Rounds are checkpointed.
    """
    both = cut_lineage(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")))
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jumps = lower.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = cut_lineage(lower.join(jumps, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label"), "old"))
        changed = moved.filter("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def _named(docs: DataFrame, *more) -> DataFrame:
    """id and t (text hash) of every row, and what else is asked for."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs["text"]).alias("t"), *more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """id, t, n_shingles, component, node and kept of every row of ``docs`` (doc_id and text are read).

    Texts are linked by their sets alone.  ``node`` numbers the first set of a
    row's component and ``component`` is the id that comes first with it;
    ``kept`` is true for the rows of just that id and set.  So rows of one id
    with unlike texts are judged each on its own, and so are rows of a null id,
    which come after all others and are told apart by their text.

    A null or wordless text has an empty set (node null) and is linked with
    nothing.  Texts of fewer than five words are linked only with the same
    sequence.
    """
    rows = cut_lineage(signatures(docs))
    filled = rows.filter("n > 0")
    named = filled.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "t")).alias("first"), F.min("signature").alias("signature"))
    # Numbers rise with the id, so the smallest of a component is its first document; they are written once and then only read.
    ranked = named.select("s1", "s2", "n", F.col("first.id").alias("id"), F.col("first.t").alias("t"), "signature").orderBy("id", "t", "s1", "s2")
    nodes = cut_lineage(ranked.withColumn("node", F.monotonically_increasing_id()))
    keys = cut_lineage(table_keys(nodes))
    heads = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    shared = cut_lineage(keys.join(heads, "key"))
    first = cut_lineage(shared.filter((F.col("node") != F.col("head")) & _alike("n", "head_n")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())

    wanted = shared.select("node").distinct().join(nodes.select("node", "id", "t"), "node")
    texts = _named(docs, docs["text"].cast("binary").alias("text"))
    texts = cut_lineage(texts.join(wanted, ["id", "t"]).dropDuplicates(["id", "t"]).select("node", "text"))
    linked = cut_lineage(confirm(first, texts))
    labels = components(linked)

    # Nodes of keys that still hold several components.
    placed = shared.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    open_nodes = cut_lineage(placed.join(several, "key").select("node", "n", "label").distinct())
    more = cut_lineage(confirm(first_common(open_nodes, texts).join(first, ["a", "b"], "left_anti"), texts))
    final = components(linked.union(more))

    # The first document of each set's component: of the smallest node that it is linked to, or its own.
    roots = final.select("label").distinct().join(nodes.select(F.col("node").alias("label"), F.struct("id", "t").alias("root")), "label")
    of_set = nodes.select("s1", "s2", "node", F.struct("id", "t").alias("own")).join(final.join(roots, "label"), "node", "left")
    of_set = of_set.select("s1", "s2", F.coalesce("label", "node").alias("root_node"), F.coalesce("root", "own").alias("root"), F.coalesce(F.col("label") == F.col("node"), F.lit(True)).alias("is_root"))
    met = rows.join(of_set, ["s1", "s2"], "left")
    wordless = F.col("n") == 0
    same = (F.col("id") == F.col("root.id")) & ((F.col("id") != NO_ID) | (F.col("t") == F.col("root.t")))
    return met.select(
        "id", "t", F.col("n").alias("n_shingles"), F.when(wordless, F.col("id")).otherwise(F.col("root.id")).alias("component"),
        F.when(~wordless, F.col("root_node")).alias("node"), (wordless | (F.col("is_root") & same)).alias("kept"),
    )


def near_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; see :func:`near_duplicates`.

    The component_id is null where a row of a null id is the first of its component.
    """
    found = near_duplicates(docs)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(back("id").alias("doc_id"), "n_shingles", back("component").alias("component_id"), "kept")


def one_of_each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row of ``docs`` for each component, of the smallest id; of wordless texts one for each id, and all without an id."""
    found = near_duplicates(docs.select("doc_id", "text")).filter("kept")
    kept = found.filter((F.col("n_shingles") > 0) | (F.col("id") != NO_ID)).groupBy("id", "node").agg(F.min("t").alias("t")).select("id", "t")
    rows = _named(docs, F.struct(*[docs[c] for c in columns]).alias("row"))
    met = rows.join(kept, ["id", "t"]).groupBy("id", "t").agg(F.min("row").alias("row")).select("row.*")
    unnamed = docs.filter((docs["doc_id"].isNull() | (docs["doc_id"] == NO_ID)) & ~F.coalesce(docs["text"], F.lit("")).rlike(WORD)).select(*columns)
    return met.unionAll(unnamed)


SQL = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
sets as (
  select distinct doc_id, md5(array_to_string(words[i:i + 4], ' ')) as w from split, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as r(i) where len(words) > 0),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b on a.w = b.w and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select p.a, p.b from shared p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * p.n >= 75 * (x.n + y.n - p.n)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from split union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
roots as (select doc_id, min(other) as root from reach group by doc_id)
select s.doc_id, coalesce(z.n, 0)::bigint as n_shingles, r.root as component_id, r.root = s.doc_id as kept
from split s join roots r on r.doc_id = s.doc_id left join sizes z on z.doc_id = s.doc_id
"""
