"""Benchmark decontamination: one Aho-Corasick automaton over all test windows.

Question and answer texts are cut into windows of ten consecutive normalised
words (an item with fewer is one window).  The windows become one automaton,
documents are scanned with it once, and hits are mapped back to character
offsets of the original text.

The automaton travels by broadcast, so its size is measured first: windows are
dealt into blocks of at most ``block_bytes`` of pattern text by a hash, and a
benchmark of several blocks is scanned block after block, each adding to the
hits of the last.  No shuffle touches a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.words import spans
from tallymark.session import cut_lineage

WINDOW = 10
BLOCK_BYTES = 32 << 20

#: Outside words lie all ASCII bytes but digits and letters; A-Z become a-z.
_DIGITS, _UPPER, _LOWER = range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)
NORMAL = bytes(b + 32 if b in _UPPER else b if b >= 0x80 or b in _DIGITS or b in _LOWER else 0x20 for b in range(256))
_NOT_SPACE = np.arange(256) != 0x20

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("char_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_built: dict[str, object] = {}


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out_ids, out = batch.column(0).to_pylist(), [], []
        for item, text in zip(ids, batch.column(1).to_pylist()):
            words = (text or b"").translate(NORMAL).split()
            for i in range(max(1, len(words) - width + 1) if words else 0):
                out.append(b" " + b" ".join(words[i : i + width]) + b" ")
                out_ids.append(item)
        yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.string()), pa.array(out, pa.binary())], ["item", "pattern"])


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Each distinct window with the items that hold it.

    A null or wordless text gives none; a null id counts as the id ``null``;
    repeated rows and items with the same window are merged.
    """
    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    cut = named.mapInArrow(lambda it: _windows(it, width), "item string, pattern binary")
    return cut.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(patterns) -> ahocorasick.Automaton:
    """Built once in each worker process; bytes are read as Latin-1 characters, one each."""
    given = patterns.value
    if _built.get("from") is not given:
        found = ahocorasick.Automaton()
        for pattern, items in given:
            text = pattern.decode("latin-1")
            found.add_word(text, (len(text), text.count(" ") - 1, items))
        if len(found):
            found.make_automaton()
        _built.update({"from": given, "automaton": found})
    return _built["automaton"]


def _merge(intervals: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _scan(batches: Iterator[pa.RecordBatch], patterns) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(patterns)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
        before = batch.column(batch.schema.get_field_index("_hits")).to_pylist()
        counts, word_spans, char_spans, found_items = [], [], [], []
        for text, old in zip(texts, before):
            plain = (text or b"").translate(NORMAL)
            words = plain.split()
            joined = b" " + b" ".join(words) + b" "
            hits = list(automaton.iter(joined.decode("latin-1"))) if len(automaton) and words else []
            intervals = [tuple(x) for x in (old or {}).get("word_spans") or []]
            items = set((old or {}).get("items") or [])
            if hits:
                gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)
                last = np.searchsorted(gaps, [end for end, _ in hits])
                for (_, (_, n, ids)), to in zip(hits, last.tolist()):
                    intervals.append((to - n, to))
                    items.update(ids)
            merged = _merge(intervals)
            counts.append(len(words))
            word_spans.append(merged)
            char_spans.append(_original(text, plain, merged))
            found_items.append(sorted(items))
        hits = pa.StructArray.from_arrays([
            pa.array(counts, pa.int64()), pa.array(word_spans, pa.list_(pa.list_(pa.int32()))),
            pa.array(char_spans, pa.list_(pa.list_(pa.int32()))), pa.array(found_items, pa.list_(pa.string())),
        ], ["n_words", "word_spans", "char_spans", "items"])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_row")), batch.column(batch.schema.get_field_index("_text")), hits], ["_row", "_text", "_hits"])


def _original(text: bytes | None, plain: bytes, merged: list[list[int]]) -> list[list[int]]:
    """Character offsets in the original text of word intervals; normalising keeps every byte in its place."""
    if not merged:
        return []
    starts, ends = spans(np.frombuffer(plain, dtype=np.uint8), _NOT_SPACE)
    characters = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    return [[int(characters[starts[low]]) - 1, int(characters[ends[high - 1] - 1])] for low, high in merged]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and ``hits`` of every document.

    ``hits``: n_words, word_spans (merged intervals of hit words), char_spans
    (the same in characters of the original text), items (ids, sorted as
    strings).  Null or empty text has no words and no hits; repeated documents
    get equal hits each; an empty table on either side gives no hits.
    """
    spark: SparkSession = docs.sparkSession
    patterns = windows(benchmark, text_col=text_col, width=width).persist()
    total = patterns.agg(F.sum(F.length("pattern") + 16 + 16 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    row_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    schema = T.StructType([T.StructField("_row", row_type), T.StructField("_text", T.BinaryType()), T.StructField("_hits", HITS)])
    frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].cast("binary").alias("_text"), F.lit(None).cast(HITS).alias("_hits"))
    for block in range(blocks):
        own = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block) if blocks > 1 else patterns
        sent = spark.sparkContext.broadcast([(bytes(r["pattern"]), list(r["items"])) for r in own.toLocalIterator()])
        frame = frame.mapInArrow(lambda it, sent=sent: _scan(it, sent), schema)
        if block < blocks - 1:
            # Written before the next block, so that a task holds one automaton and the cluster one block.
            frame = cut_lineage(frame)
            sent.destroy()
    patterns.unpersist()
    return frame.select(F.col("_row").alias("row"), F.col("_hits").alias("hits"))


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of :func:`find_leaks`, one row for each row of ``docs``."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits.word_spans", F.lit(0).cast("long"), lambda total, s: total + (s[1] - s[0]).cast("long"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs, unchanged."""
    return find_leaks(docs, benchmark).filter(F.size("hits.word_spans") == 0).select("row.*")


SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
items as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
windows as (
  select distinct item, least(10, len(words)) as width, array_to_string(words[i:i + 9], ' ') as w from items, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as r(i) where len(words) > 0),
widths as (select distinct width from windows),
places as (
  select doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') as w from words, widths, unnest(range(1, len(words) - width + 2)) as r(i)),
hits as (select p.doc_id, p.i, p.width, w.item from places p join windows w on w.w = p.w and w.width = p.width),
covered as (select distinct doc_id, i + o as i from hits, unnest(range(0, width)) as t(o)),
n_hits as (select doc_id, count(*) as n from covered group by doc_id),
n_items as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as ids from hits group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from words d left join n_hits h on h.doc_id = d.doc_id left join n_items i on i.doc_id = d.doc_id
"""
