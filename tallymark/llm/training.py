"""A bounded, repeatable sample of labelled documents, and a fit in one task.

Models here are fitted on at most ``rows`` labelled documents, whatever the size
of the corpus; everything they then score is the whole corpus.  The sample is
chosen by a hash of the id among the labels alone (narrow rows), so its ids are
few enough to broadcast, and only the chosen texts leave the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import chunks

TRAIN_ROWS = 12_000


def held_out(doc_id: Column) -> Column:
    """One id in five by crc32 of its text, and every null id (no label can name it)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def merged_labels(labels: DataFrame, target: Column) -> DataFrame:
    """(doc_id, target) of each labelled id outside the held-out fold; of several labels of one id the greatest counts."""
    named = labels.select("doc_id", target.cast("int").alias("target")).filter(F.col("doc_id").isNotNull() & F.col("target").isNotNull() & ~held_out(F.col("doc_id")))
    return named.groupBy("doc_id").agg(F.max("target").alias("target"))


def label_counts(labels: DataFrame, target: Column) -> DataFrame:
    """(target, count) over all labels outside the held-out fold."""
    return merged_labels(labels, target).groupBy("target").count()


def labelled_sample(docs: DataFrame, labels: DataFrame, target: Column, rows: int = TRAIN_ROWS, classes: tuple[int, ...] = ()) -> DataFrame:
    """(target int, text binary) of at most ``rows`` documents outside the held-out fold.

    With ``classes`` each of them gets an equal part of the bound at most.  Labels without an id or a target are left out; of several labels of one id
    the greatest counts; of several texts of one id the smallest.
    """
    merged = merged_labels(labels, target)
    parts = [merged.filter(F.col("target") == c) for c in classes] or [merged]
    chosen = reduce(DataFrame.union, [part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // len(parts)) for part in parts])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "target").agg(F.min("text").alias("text")).select("doc_id", "target", F.col("text").cast("binary").alias("text"))


def fit(sample: DataFrame, learn: Callable[[list[int], Iterator[list[bytes]]], dict[int, float]]) -> dict[int, float]:
    """Weights by feature number from one task that reads the bounded sample in the order of a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets: list[int] = []
        texts: list[bytes | None] = []
        for batch in batches:
            targets += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        found = learn(targets, (run for _, run in chunks(texts)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.float64())], ["feature", "weight"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("target", "text")
    return {r["feature"]: r["weight"] for r in ordered.mapInArrow(run, "feature bigint, weight double").collect()}
