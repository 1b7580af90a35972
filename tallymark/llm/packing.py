"""Packing by power-of-two decomposition: every sequence is a piece of one document.

A document of n tokens is cut into whole sequences of the largest length and
then into the powers of two that its rest is the sum of, the longest first.
Pieces of one length form a bucket: batches are drawn from one bucket at a time,
so nothing is padded and no sequence crosses documents.

Documents are put in the order of their ids by a range sort and tokenised there,
once, into a table in the shared folder; each piece has its place within its
partition and bucket, and one count for each partition and bucket turns that
into the number of its sequence.  Numbers follow from the rows alone, not from
the number of cores or files, and the tokens are never shuffled.

The tokenizer treats words between white space on their own, so a worker encodes
a distinct word once and remembers a bounded number of them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm.words import LOWER, Chunk, chunks, hashes
from tallymark.session import checkpoint_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Fixed values of the contract.
LONGEST = 2048
END = 1
#: Words that a worker remembers, slots for them, words looked up and words encoded at once.
REMEMBERED, SLOTS, AT_ONCE, GROUP = 700_000, 1 << 21, 300_000, 64
#: First bytes of the marks U+0300 to U+036F, which can join the letter before them.
MARKS = (b"\xcc", b"\xcd")
#: The mark of a token that ends a word, words of letters alone, and bytes that may be parted from a word.
WORD_END = "</w>"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
STOP = np.isin(np.arange(256), list(b".,;:!?"))
ALNUM = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])
#: 24 bytes each.
BROADCAST_ROWS = 500_000


def _part_stops(chunk: Chunk) -> None:
    """Make a stop that ends a word of its own, where a letter or digit stands before it: the tokenizer parts them too."""
    buffer, starts, ends = chunk.buffer, chunk.starts, chunk.ends
    before, lead = buffer[np.maximum(ends - 2, 0)], buffer[np.maximum(ends - 3, 0)]
    letter = ALNUM[before] | ((ends - starts > 2) & (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    parted = (ends - starts > 1) & STOP[buffer[np.maximum(ends - 1, 0)]] & letter
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(parted)[:-1]]) if len(starts) else np.empty(0, dtype=np.int64)
    all_starts, all_ends = np.empty(len(starts) + int(parted.sum()), dtype=np.int64), np.empty(len(starts) + int(parted.sum()), dtype=np.int64)
    all_starts[at], all_ends[at] = starts, ends - parted
    all_starts[at[parted] + 1], all_ends[at[parted] + 1] = ends[parted] - 1, ends[parted]
    chunk.starts, chunk.ends = all_starts, all_ends
    chunk.first = np.searchsorted(all_starts, chunk.offsets)
    chunk.hash = hashes(buffer, all_starts, all_ends)


class Encoder:
    """Token ids of whole texts.  Words are known by their 64-bit hashes, in an open table of bounded size."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[number for token, number in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.places, self.known = np.zeros(SLOTS, dtype=np.uint64), np.full(SLOTS, -1, dtype=np.int32), 0
        self.starts, self.lengths = np.zeros(REMEMBERED + 1, dtype=np.int64), np.zeros(REMEMBERED + 1, dtype=np.int64)
        self.flat, self.used = np.empty(1 << 20, dtype=np.uint16), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where it is not known."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            place = self.places[slot]
            same = (self.keys[slot] == hashes[left]) & (place >= 0)
            out[left[same]] = place[same]
            further = (place >= 0) & ~same
            left, slot = left[further], (slot[further] + 1) % SLOTS
        return out

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(self.known, self.known + len(lengths))
        self.lengths[at] = lengths
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.known += len(lengths)

    def _insert(self, values: np.ndarray, places: np.ndarray) -> None:
        """Put distinct hashes into the table; of those that want one free slot, one gets it."""
        slot = (values & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(values):
            _, first = np.unique(slot, return_index=True)
            first = first[self.places[slot[first]] < 0]
            self.keys[slot[first]], self.places[slot[first]] = values[first], places[first]
            left = np.ones(len(values), dtype=bool)
            left[first] = False
            values, places, slot = values[left], places[left], (slot[left] + 1) % SLOTS

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Words of a group are encoded as one text.

        A word of letters alone has one token that ends a word, its last; a token
        of any other word belongs to the word that its offset lies in.
        """
        simple = np.fromiter((LETTERS.fullmatch(w) is not None for w in words), dtype=bool, count=len(words))
        order, first = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)]), self.known
        plain, other = [w for w, yes in zip(words, simple.tolist()) if yes], [w for w, yes in zip(words, simple.tolist()) if not yes]
        for low in range(0, len(plain), GROUP):
            group = plain[low : low + GROUP]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(group):
                raise ValueError("a word of letters is more than one word to this tokenizer")
            self._keep(ids, np.diff(ends, prepend=-1))
        for low in range(0, len(other), GROUP):
            group = other[low : low + GROUP]
            coded = self.tokenizer.encode_batch([" ".join(group)], add_special_tokens=False)[0]
            begins = np.cumsum([0] + [len(w) + 1 for w in group[:-1]])
            offsets = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            self._keep(np.array(coded.ids, dtype=np.int64), np.bincount(np.searchsorted(begins, offsets, side="right") - 1, minlength=len(group)))
        self._insert(hashes[order], np.arange(first, self.known, dtype=np.int32))

    def _places(self, chunk: Chunk, words: slice) -> np.ndarray:
        hashes, place = chunk.hash[words], self._find(chunk.hash[words])
        if (place >= 0).all():
            return place
        new = np.flatnonzero(place < 0)
        if self.known + len(np.unique(hashes[new])) > REMEMBERED:
            self._forget()
            new = np.arange(len(hashes))
        values, first = np.unique(hashes[new], return_index=True)
        at = new[first] + words.start
        self._learn(values, [chunk.joined[s:e].decode() for s, e in zip(chunk.starts[at].tolist(), chunk.ends[at].tolist())])
        return self._find(hashes)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text.  The tokenizer lower-cases and ignores white space, so words can be lower-cased here unless a mark may join a letter."""
        chunk = Chunk(texts, table=None if any(m in t for t in texts for m in MARKS) else LOWER, hashed=False)
        _part_stops(chunk)
        found, lengths = [np.empty(0, dtype=np.uint16)], [np.zeros(1, dtype=np.int64)]
        for low in range(0, len(chunk.hash), AT_ONCE):
            place = self._places(chunk, slice(low, low + AT_ONCE))
            starts, own = self.starts[place], self.lengths[place]
            ends = np.cumsum(own)
            found.append(self.flat[np.arange(ends[-1]) + np.repeat(starts - (ends - own), own)])
            lengths.append(own)
        ids, borders = np.concatenate(found), np.cumsum(np.concatenate(lengths))[chunk.first]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:])]


_ready: dict[str, object] = {}


def _encoder(definition) -> Encoder:
    """Built once in each worker process."""
    if _ready.get("from") is not definition.value:
        _ready.update({"from": definition.value, "encoder": Encoder(definition.value)})
    return _ready["encoder"]


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, longest: int = LONGEST, tokenizer: str = TOKENIZER) -> DataFrame:
    """Written table of part, at (place within part and length), doc_id, start, length, doc_tokens and ids (32-bit little-endian)."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(sent), TaskContext.get().partitionId(), {}
        for batch in batches:
            for first, texts in chunks([t.as_py() for t in batch.column(1)]):
                owner, places, starts, lengths, totals, blobs = [], [], [], [], [], []
                for row, ids in enumerate(encoder.encode(texts), start=first):
                    ids = np.append(ids, END).astype("<u4")
                    start = 0
                    for length in cuts(len(ids), longest):
                        owner.append(row)
                        places.append(seen.get(length, 0))
                        starts.append(start)
                        lengths.append(length)
                        totals.append(len(ids))
                        blobs.append(ids[start : start + length].tobytes())
                        seen[length] = places[-1] + 1
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(owner), pa.int32()), pa.array(places, pa.int64()), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(blobs, pa.binary())],
                    ["part", "at", "doc_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "t", "row").sortWithinPartitions("doc_id", "t", "row").select("doc_id", "text")
    made = ordered.mapInArrow(run, f"part int, at bigint, doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")
    made.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def pack(docs: DataFrame, longest: int = LONGEST, tokenizer: str = TOKENIZER) -> DataFrame:
    """bucket, sequence_id, doc_id, start, length, offset, doc_tokens and ids, one row for each sequence.

    A document is its tokens and END; a null or empty text is END alone.  The
    bucket is the length of its sequences; numbers run through the buckets,
    longest first, and within one in the order of doc_id (null first), text hash
    and start.  Repeated rows are documents of their own.  An empty table has no
    rows.  Other columns are not read.
    """
    table = pieces(docs, longest, tokenizer)
    counts = table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("many"))
    sizes = counts.groupBy("length").agg(F.sum("many").alias("all"))
    # At most twelve buckets, and one row for each bucket and partition.
    before = sizes.select(F.col("length").alias("bucket"), (F.sum("all").over(Window.orderBy(F.desc("length"))) - F.col("all")).alias("earlier"))
    within = counts.select("length", "part", (F.sum("many").over(Window.partitionBy("length").orderBy("part")) - F.col("many")).alias("ahead"))
    shifts = within.join(before, within["length"] == before["bucket"]).select("length", "part", (F.col("earlier") + F.col("ahead")).alias("shift"))
    if shifts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    return table.join(shifts, ["length", "part"]).select(
        F.col("length").alias("bucket"), (F.col("shift") + F.col("at")).alias("sequence_id"), "doc_id", "start", "length", F.lit(0).cast("bigint").alias("offset"), "doc_tokens", "ids")


def write_buckets(packed: DataFrame, folder: str) -> None:
    """One folder for each bucket, its sequences in order within each file."""
    packed.sortWithinPartitions("bucket", "sequence_id").write.partitionBy("bucket").option("compression", "zstd").parquet(folder)


def packing_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`pack`, one row for each piece."""
    crc: Column = F.crc32("ids")
    return pack(docs).select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
