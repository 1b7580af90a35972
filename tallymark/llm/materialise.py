"""Training-order token shards: a keyed Feistel permutation gives every sequence a slot.

Documents are tokenised once into fixed-length sequences and written to the
shared folder.  Sequences are numbered 0..N-1 by the file, the row and the place
in the row that they come from, through one count for each run of rows that a
task read; how Spark cuts the files does not matter.  A Feistel network over the
next even number of bits, walked until it lands below N, permutes these numbers,
either all of them or within consecutive windows, which keeps a given order of
the documents from window to window.  Slots are range-partitioned into shards
of equal stride, so slot k stands at byte (k mod shard) * stride of shard
k div shard: reading is sequential and resumes anywhere.  Shards are written in
a few passes over the sequences, each for a range of shards, and the shuffle
files of a pass go when it ends: at no time all sequences are shuffled.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.words import mix
from tallymark.session import checkpoint_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of that vocabulary: the pattern that cuts text before merging, and the first free id.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH = 512
SHARD = 4096
#: Sequences that are permuted among themselves where the order of the documents is to be kept: four shards.
WINDOW = 4 * SHARD
ROUNDS = 4
KEY = 20_240_601
#: Passes in which shards are written.
PASSES = 4
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: 16 bytes each.
BROADCAST_ROWS = 500_000

_ready: dict[str, object] = {}


def permute(index: np.ndarray, n: int, key: int = KEY, window: int | np.ndarray = 0) -> np.ndarray:
    """The slot of each index in 0..n-1: a bijection for every n, key and window number."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % 2**64), 41)
    own = mix(np.zeros(len(index), dtype=np.uint64) + np.asarray(window, dtype=np.uint64), 43)

    def once(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k ^ own, 42) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64), own)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside], own[outside])
    return out.astype(np.int64)


def slots(index: np.ndarray, n: int, window: int | None = None, key: int = KEY) -> np.ndarray:
    """The slot of each index in 0..n-1; with ``window`` an index stays among the so many that it stands with (the last window may be smaller)."""
    if window is None:
        return permute(index, n, key)
    number = index // window
    low, out = number * window, np.empty(len(index), dtype=np.int64)
    last = number == n // window
    for some, size in ((~last, window), (last, n % window)):
        if some.any():
            out[some] = low[some] + permute(index[some] - low[some], size, key, number[some])
    return out


def _encoder(ranks) -> tiktoken.Encoding:
    """Built once in each worker process."""
    if _ready.get("from") is not ranks.value:
        _ready.update({"from": ranks.value, "encoder": tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})})
    return _ready["encoder"]


def _rows_of_files(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the file and row of each row of ``docs``; what was not read from files is written first, by id and text."""
    if "_metadata" not in docs.columns:
        try:
            return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        except AnalysisException:
            pass
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).write.parquet(folder)
    return _rows_of_files(spark.read.parquet(folder))


def sequences(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER) -> DataFrame:
    """Written table of part, run, file, row, at, doc_id, seq_no, n_tokens, tokens.

    A document is its tokens and END, cut every ``length``; so a null or empty
    text is one sequence of END alone.  Tokens are 16-bit little-endian.  A run
    is what a task (``part``) read of one file without a gap; ``file`` and
    ``row`` say where it begins, ``at`` counts its sequences.
    The table lies in the shared folder: numbering and permuting read it
    without tokenising again, and a lost executor costs only its tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > END:
        raise ValueError("tokens are written in 16 bits, with END after the vocabulary")
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(sent), TaskContext.get().partitionId()
        number, begins, follows, at = -1, None, None, 0
        for batch in batches:
            owner, where, blobs = [], [], []
            for i, (text, file, row) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if (file, row) != follows:
                    number, begins, at = number + 1, (file, row), 0
                follows = (file, row + 1)
                tokens = np.array([*encoder.encode_ordinary(text.as_py() or ""), END], dtype="<u2")
                for k, low in enumerate(range(0, len(tokens), length)):
                    own = tokens[low : low + length]
                    owner.append(i)
                    where.append((number, *begins, at, k, len(own)))
                    blobs.append(own.tobytes())
                    at += 1
            if owner:
                runs, files, rows, places, numbers, counts = zip(*where)
                ids = batch.column(0).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(owner), pa.int32()), pa.array(runs, pa.int32()), pa.array(files), pa.array(rows, pa.int64()), pa.array(places, pa.int64()), ids, pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(blobs, pa.binary())],
                    ["part", "run", "file", "row", "at", "doc_id", "seq_no", "n_tokens", "tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    folder = f"{checkpoint_dir(spark).rstrip('/')}/sequences-{uuid.uuid4().hex}"
    made = _rows_of_files(docs).mapInArrow(run, f"part int, run int, file string, row bigint, at bigint, doc_id {kind}, seq_no int, n_tokens int, tokens binary")
    made.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def _placed(docs: DataFrame, length: int, key: int, tokenizer: str, window: int | None) -> tuple[DataFrame, int]:
    """doc_id, seq_no, n_tokens, tokens, slot of the written sequences of ``docs``, and their number."""
    table = sequences(docs, length, tokenizer)
    counts = table.groupBy("part", "run").agg(F.min("file").alias("file"), F.min("row").alias("row"), F.count(F.lit(1)).alias("many"))
    total, runs = counts.agg(F.coalesce(F.sum("many"), F.lit(0)), F.count(F.lit(1))).first()
    # One row of a few numbers for each split of an input file; sent along where they are few enough, joined by sorting otherwise.
    before = Window.orderBy("file", "row", "part", "run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "run", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))

    if runs <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    @F.pandas_udf("bigint")
    def slot(index):
        return index.__class__(slots(index.to_numpy(), total, window, key))

    # Named nondeterministic, a slot is not computed again for each condition on it.
    slot = slot.asNondeterministic()
    return table.join(offsets, ["part", "run"]).select("doc_id", "seq_no", "n_tokens", "tokens", slot(F.col("before") + F.col("at")).alias("slot")), total


def _in_order(placed: DataFrame, length: int, shard: int) -> DataFrame:
    stride = 2 * length
    ordered = placed.withColumn("shard", F.floor(F.col("slot") / shard)).repartitionByRange("shard").sortWithinPartitions("slot")
    padded = F.rpad("tokens", stride, F.lit(END.to_bytes(2, "little")))
    return ordered.select("shard", "slot", ((F.col("slot") % shard) * stride).alias("byte_offset"), "doc_id", "seq_no", "n_tokens", padded.alias("payload"))


def in_training_order(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, key: int = KEY, tokenizer: str = TOKENIZER, window: int | None = None) -> DataFrame:
    """shard, slot, byte_offset, doc_id, seq_no, n_tokens, payload, range-partitioned by shard and sorted by slot.

    ``payload`` has the same number of bytes in every row: tokens, then END up
    to ``length``.  Slots are 0..N-1, each once; repeated documents get slots of
    their own; null ids are kept; a very long text is as many sequences as it
    needs; other columns may have any name; an empty table gives no rows.  Equal
    input files give equal slots, whatever the cluster.  With ``window`` the
    rows of ``docs`` keep their order but for the permutation within a window.
    """
    return _in_order(_placed(docs, length, key, tokenizer, window)[0], length, shard)


def write_shards(ordered: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Write each shard as one file of fixed stride below ``folder``; returns the written index: all columns but the payload, and the path of the shard.

    ``folder`` is shared by all executors.  A task writes under names of its
    own, and the index, which Spark commits, holds the names of the attempt that
    counted: a task that is repeated after a loss leaves a file that nothing
    names.  With the mode ``append`` more shards go to the same folder.
    """
    spark = ordered.sparkSession
    root = folder.rstrip("/")
    kept = [f for f in ordered.schema.fields if f.name != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(f"{root}/payload")
        system.create_dir(base, recursive=True)
        current, out, name, at = None, None, "", len(kept)
        for batch in batches:
            names = []
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(at)):
                if shard != current:
                    if out is not None:
                        out.close()
                    current, name = shard, f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    out = system.open_output_stream(f"{base}/{name}")
                out.write(payload.as_buffer())
                names.append(f"{root}/payload/{name}")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(names, pa.string())], [*(f.name for f in kept), "path"])
        if out is not None:
            out.close()

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    ordered.select(*[f.name for f in kept], "payload").mapInArrow(run, f"{columns}, path string").write.mode(mode).parquet(f"{root}/index")
    return spark.read.parquet(f"{root}/index")


def read_shards(index: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of an index with their payload, read from the shards: neighbours of one shard in one go."""
    stride = 2 * length
    kept = [f for f in index.schema.fields if f.name != "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, system = None, None, None
        for batch in batches:
            paths, offsets = batch.column(len(kept)).to_pylist(), batch.column([f.name for f in kept].index("byte_offset")).to_numpy()
            low = 0
            while low < len(paths):
                high = low + 1
                while high < len(paths) and paths[high] == paths[low] and offsets[high] == offsets[high - 1] + stride:
                    high += 1
                if paths[low] != path:
                    if file is not None:
                        file.close()
                    path = paths[low]
                    system, at = fs.FileSystem.from_uri(path)
                    file = system.open_input_file(at)
                data = file.read_at((high - low) * stride, int(offsets[low]))
                ends = pa.py_buffer(np.arange(0, (high - low + 1) * stride, stride, dtype=np.int32))
                payload = pa.Array.from_buffers(pa.binary(), high - low, [None, ends, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in range(len(kept))), payload], [*(f.name for f in kept), "payload"])
                low = high
        if file is not None:
            file.close()

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return index.select(*[f.name for f in kept], "path").mapInArrow(run, f"{columns}, payload binary")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a write are deleted when it ends."""
    given = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if given is None else spark.conf.set(CLEANUP, given)


def token_shards(docs: DataFrame, window: int | None = None, folder: str | None = None, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write the shards of ``docs`` (below the shared folder unless ``folder`` is given) and return their rows as read back; see :func:`in_training_order`."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    placed, total = _placed(docs, length, KEY, TOKENIZER, window)
    shards = -(-total // shard)
    passes = max(1, min(PASSES, shards))
    for k in range(passes):
        own = placed.filter((F.col("slot") >= shards * k // passes * shard) & (F.col("slot") < shards * (k + 1) // passes * shard))
        with _shuffles_dropped(spark):
            index = write_shards(_in_order(own, length, shard), folder, "append")
    return read_shards(index, length)


def read_slot(index: DataFrame, slot: int, length: int = LENGTH) -> np.ndarray:
    """The tokens at a slot, read by offset alone."""
    found = index.filter(F.col("slot") == slot).select("path", "byte_offset").first()
    system, path = fs.FileSystem.from_uri(found["path"])
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_at(2 * length, found["byte_offset"]), dtype="<u2")
