"""Substring dedup with prefix-partitioned suffix trees.

A word sequence of 13 words that also starts in a document with a smaller id is
removed.  Suffixes are grouped by a prefix, and each group is small enough for
memory, so its part of the suffix tree is built in one task:

* A window of 13 words is filed under one suffix inside it, the one whose first
  three words hash lowest.  Equal windows choose equal suffixes, and neighbouring
  windows mostly the same one, so a group receives short runs of text (about 18
  words for 6 windows) instead of one 13-word string for every position.
* Prefixes have variable length.  A census over all documents sums the text
  that each prefix class would receive; classes of one word that are too large
  are split by two words, then by three, and small ones are packed together
  until a group is full.
* In a group, leaves are ordered by their first 13 words, neighbours are
  compared word by word, and the intervals that agree in 13 words or more are
  the deep internal nodes.  All leaves of a node but those of its smallest
  document are repeats; neighbouring ones add up to maximal repeats.

Each chunk of documents is settled in the same way before anything is shuffled,
so a passage that a third of all documents share travels once for each chunk.
A group that is still too large is settled piece by piece: what is known to
repeat is reported and let go, which keeps just the distinct windows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import Chunk, chunks, runs, spans

WIDTH = 13
ANCHOR = 3
LEVELS = (1, 2, 3)
CLASSES = 4096
GROUP_BYTES = 10 << 20
CHUNK = 4 << 20
#: Of zstandard; what is packed is shuffled.
LEVEL = 6
#: Stands for a null id: one document, after all others.
NO_ID = 2**63 - 1

HIT = "id bigint, tag bigint, start int, n int"


def _anchors(h: np.ndarray) -> np.ndarray:
    """For each window of WIDTH words the place of its lowest-hashing suffix, the leftmost of equals."""
    grams = runs(h, ANCHOR, seed=5)
    n = len(h) - WIDTH + 1
    best, place = grams[:n].copy(), np.arange(n)
    for d in range(1, WIDTH - ANCHOR + 1):
        other = grams[d : d + n]
        lower = other < best
        best[lower] = other[lower]
        place[lower] = np.flatnonzero(lower) + d
    return place


def _classes(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The prefix class of the suffixes at some places, for each prefix length."""
    shift = np.uint64(64 - CLASSES.bit_length() + 1)
    return [((h[at] if k == 1 else runs(h, k, seed=4 + k)[at]) >> shift).astype(np.int64) for k in LEVELS]


def deep_nodes(h: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in tree order, and where in it each internal node of depth WIDTH begins.

    Leaves that share no node with another stand alone in theirs.
    """
    first = runs(h, WIDTH)[leaves]
    order = np.argsort(first, kind="stable")
    placed, first = leaves[order], first[order]
    begins = np.ones(len(placed), dtype=bool)
    begins[1:] = first[1:] != first[:-1]
    rest = np.flatnonzero(~begins)
    agree = np.ones(len(rest), dtype=bool)
    for d in range(WIDTH):
        agree &= h[placed[rest] + d] == h[placed[rest - 1] + d]
    if not agree.all():  # two texts with one hash: order by the words themselves
        order = np.lexsort([h[leaves + d] for d in range(WIDTH - 1, -1, -1)])
        placed = leaves[order]
        begins[1:] = False
        for d in range(WIDTH):
            begins[1:] |= h[placed[1:] + d] != h[placed[:-1] + d]
    return order, np.flatnonzero(begins)


def repeats(h: np.ndarray, leaves: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which leaves lie below a deep node that a document with a smaller id reaches too."""
    if not len(leaves):
        return np.zeros(0, dtype=bool)
    order, begins = deep_nodes(h, leaves)
    smallest = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.append(begins, len(order))))
    out = np.empty(len(leaves), dtype=bool)
    out[order] = ids[order] > smallest
    return out


def _joined(*breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members and lengths of the runs in which every given array stays the same."""
    n = len(breaks[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for b in breaks:
        new[1:] |= b[1:] != b[:-1]
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, n))


class Leaves:
    """Windows of a piece of text: place in its words, document, place in the document."""

    def __init__(self, joined: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray, ids: np.ndarray, tags: np.ndarray, at: np.ndarray):
        self.joined, self.h, self.starts, self.ends = joined, h, starts, ends
        self.place, self.ids, self.tags, self.at = place, ids, tags, at

    def take(self, which: np.ndarray) -> Leaves:
        return Leaves(self.joined, self.h, self.starts, self.ends, self.place[which], self.ids[which], self.tags[which], self.at[which])

    def settle(self) -> tuple[list[np.ndarray], Leaves]:
        """The repeats within these leaves as runs (id, tag, start, n), and the leaves that are none."""
        hit = repeats(self.h, self.place, self.ids)
        found = self.take(hit)
        begins, n = _joined(found.ids, found.tags, found.at - np.arange(len(found.at)))
        return [found.ids[begins], found.tags[begins], found.at[begins], n], self.take(~hit)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of neighbouring leaves with one anchor: first leaf, number, place of the anchor."""
        anchor = _anchors(self.h)[self.place]
        begins, n = _joined(self.ids, self.tags, anchor, self.place - np.arange(len(self.place)), self.at - np.arange(len(self.at)))
        return begins, n, anchor[begins]

    def pack(self, begins: np.ndarray, n: np.ndarray) -> bytes:
        """Documents, places, numbers and texts of some segments."""
        first = self.place[begins]
        low, high = self.starts[first], self.ends[first + n + WIDTH - 2]
        text = b" ".join([self.joined[a:b] for a, b in zip(low.tolist(), high.tolist())])
        ids, tags = self.ids[begins], self.tags[begins]
        docs, many = _joined(ids, tags)
        head = [np.diff(ids[docs], prepend=np.int64(0)).astype("<i8"), tags[docs].astype("<i8"), many.astype("<i4"), self.at[begins].astype("<i4"), n.astype("<i4")]
        return zstandard.ZstdCompressor(LEVEL).compress(struct.pack("<qq", len(docs), len(begins)) + b"".join(x.tobytes() for x in head) + text)


def unpack(payloads: list[bytes]) -> Leaves:
    """The leaves of packed segments, over the words of their texts."""
    heads, texts = [], []
    for payload in payloads:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        docs, n = struct.unpack_from("<qq", raw)
        ids, tags = np.cumsum(np.frombuffer(raw, "<i8", docs, 16)), np.frombuffer(raw, "<i8", docs, 16 + 8 * docs)
        many, rest = np.frombuffer(raw, "<i4", docs, 16 + 16 * docs), 16 + 20 * docs
        heads.append([np.repeat(ids, many), np.repeat(tags, many), np.frombuffer(raw, "<i4", n, rest), np.frombuffer(raw, "<i4", n, rest + 4 * n)])
        texts.append(raw[rest + 8 * n :])
    ids, tags, at, n = (np.concatenate([h[k] for h in heads]).astype(np.int64) for k in range(4))
    chunk = Chunk(texts)
    words = n + WIDTH - 1
    segment = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    return Leaves(chunk.joined, chunk.hash, chunk.starts, chunk.ends, (np.cumsum(words) - words)[segment] + inside, ids[segment], tags[segment], at[segment] + inside)


def _leaves(texts: list[bytes], ids: np.ndarray, tags: np.ndarray) -> Leaves:
    """All windows of a chunk of documents."""
    chunk = Chunk(texts)
    n = np.maximum(chunk.counts - WIDTH + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return Leaves(chunk.joined, chunk.hash, chunk.starts, chunk.ends, chunk.first[doc] + at, ids[doc], tags[doc], at)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Leaves]:
    for batch in batches:
        ids, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for first, part in chunks(texts, CHUNK):
            rows = slice(first, first + len(part))
            yield _leaves(part, ids[rows], tags[rows])


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((len(LEVELS), CLASSES))
    for leaves in _read(batches):
        if len(leaves.place):
            begins, n, anchor = leaves.segments()
            first = leaves.place[begins]
            size = leaves.ends[first + n + WIDTH - 2] - leaves.starts[first]
            for level, classes in enumerate(_classes(leaves.h, anchor)):
                sums[level] += np.bincount(classes, weights=size, minlength=CLASSES)
    level, cls = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(cls.astype(np.int32)), pa.array(sums[level, cls].astype(np.int64))], ["level", "class", "bytes"])


def prefix_groups(keyed: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[np.ndarray, int]:
    """The group of each prefix class by prefix length, -1 where the prefix has to be longer; and the number of groups.

    The driver sees one sum for each of 3 x 4,096 classes.
    """
    rows = keyed.mapInArrow(_census, "level int, class int, bytes bigint").groupBy("level", "class").agg(F.sum("bytes").alias("bytes")).collect()
    sums = np.zeros((len(LEVELS), CLASSES))
    for r in rows:
        sums[r["level"], r["class"]] = r["bytes"]
    group, held = 0, 0.0
    out = np.full((len(LEVELS), CLASSES), -1, dtype=np.int32)
    for level in range(len(LEVELS)):
        for cls in range(CLASSES):
            if sums[level, cls] > group_bytes and level < len(LEVELS) - 1:
                continue
            if held + sums[level, cls] > group_bytes and held:
                group, held = group + 1, 0.0
            out[level, cls] = group
            # Longer prefixes hold just what is left over by shorter ones, at most these bytes.
            held += sums[level, cls] if level == 0 or (out[level - 1] < 0).any() else 0
    return out, group + 1


def _deal(batches: Iterator[pa.RecordBatch], groups) -> Iterator[pa.RecordBatch]:
    """Segments by group, and the repeats found within the chunk as they are (group -1)."""
    for leaves in _read(batches):
        found, left = leaves.settle()
        numbers, payloads = [], []
        if len(found[0]):
            numbers.append(-1)
            payloads.append(b"".join(x.astype("<i8").tobytes() for x in found))
        if len(left.place):
            begins, n, anchor = left.segments()
            group = np.full(len(begins), -1, dtype=np.int64)
            for level, classes in enumerate(_classes(left.h, anchor)):
                group = np.where(group < 0, groups.value[level][classes], group)
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order])) + 1
            for own in np.split(order, edges):
                numbers.append(int(group[own[0]]))
                payloads.append(left.pack(begins[own], n[own]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], ["group", "payload"])


def _hits(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in found[:2]), *(pa.array(x.astype(np.int32)) for x in found[2:])], ["id", "tag", "start", "n"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their groups; one group at a time is held."""
    current, held, size = None, [], 0
    for batch in batches:
        for group, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            payload = value.as_py()
            if group < 0:
                yield _hits(list(np.frombuffer(payload, "<i8").reshape(4, -1)))
                continue
            if group != current:
                if held:
                    yield _hits(unpack(held).settle()[0])
                current, held, size = group, [], 0
            held.append(payload)
            size += zstandard.frame_content_size(payload)
            if size > 2 * GROUP_BYTES:
                found, left = unpack(held).settle()
                yield _hits(found)
                begins, n, _ = left.segments()
                held = [left.pack(begins, n)]
                # Distinct text beyond the bound is kept whole; it is looked at again when it has doubled.
                size = min(zstandard.frame_content_size(held[0]), GROUP_BYTES)
    if held:
        yield _hits(unpack(held).settle()[0])


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"), *more)


def find_repeats(docs: DataFrame) -> DataFrame:
    """(id, tag, start, n): n neighbouring windows from word ``start`` on that a document with a smaller id holds too.

    ``tag``, the whole 64-bit hash of the text, tells texts apart that share an id; rows of one id are one document
    and never repeat each other.  A null id comes after all others.
    """
    keyed = _keyed(docs)
    groups, many = prefix_groups(keyed)
    sent = docs.sparkSession.sparkContext.broadcast(groups)
    dealt = keyed.mapInArrow(lambda it: _deal(it, sent), "group int, payload binary")
    # Repeats that are known already need no meeting place: they go anywhere.
    place = F.when(F.col("group") < 0, F.xxhash64("payload")).otherwise(F.col("group").cast("long"))
    gathered = dealt.withColumn("place", place).repartition("place").sortWithinPartitions("group").select("group", "payload")
    return gathered.mapInArrow(_trees, HIT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        n_words, n_removed, kept, removed = [], [], [], []
        for text, hits in zip(texts, lists):
            starts, ends = spans(np.frombuffer(text or b"", dtype=np.uint8))
            cover = np.zeros(len(starts) + 1, dtype=np.int64)
            for start, n in ((h["start"], h["n"]) for h in hits or []):
                cover[start] += 1
                cover[start + n + WIDTH - 1] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            words = (text or b"").split() if not gone.any() else [text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            n_words.append(len(starts))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join(words))
            removed.append(edges.reshape(-1, 2).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_words", "n_removed", "kept", "removed_spans"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by a blank), removed_spans (word intervals, the maximal repeats) of every row.

    Null, empty and wordless texts have no words; texts of fewer than 13 words
    lose none; repeated rows lose the same words; other columns are not read.
    """
    hits = find_repeats(docs).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    rows = _keyed(docs, F.col("doc_id"))
    met = rows.join(hits, ["id", "tag"], "left").select("doc_id", "text", "hits")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(_cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary, removed_spans array<array<bigint>>")


def substring_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`without_repeats`."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) as w from split, unnest(range(1, len(words) - 11)) as r(i)),
hits as (select doc_id, i from windows qualify doc_id > min(doc_id) over (partition by w)),
gone as (select distinct doc_id, i + o as i from hits, unnest(range(0, 13)) as t(o)),
words as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from split),
left_over as (
  select w.doc_id, string_agg(w.word, ' ' order by w.i) filter (g.i is null) as kept, count(g.i) as n_removed
  from words w left join gone g on g.doc_id = w.doc_id and g.i = w.i group by w.doc_id)
select s.doc_id, len(s.words)::bigint as n_words, coalesce(l.n_removed, 0)::bigint as n_removed, sha256(coalesce(l.kept, '')) as kept_sha256
from split s left join left_over l on l.doc_id = s.doc_id
"""
