"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text features; ordered
thresholds cut the resulting score into grades:
P(grade > k) = logistic(score - threshold_k).  A text gets its expected grade
and the probability of reaching a grade, which is what selection goes by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.training import TRAIN_ROWS, fit, held_out, labelled_sample
from tallymark.llm.words import IN_WORD, LOWER, Chunk, bytes_of, chunks, hashes, mix, runs, spans

BITS = 18
SIZE = 1 << BITS
EPOCHS, RATE, DECAY, BATCH = 8, 0.15, 1e-6, 64
ACCEPT = 0.5

# Bytes by shape: capitals, small letters (and all of UTF-8 beyond ASCII), digits; every other byte stands for itself.
_SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def _shapes(chunk: Chunk) -> np.ndarray:
    """A hash of each word's shape with runs of one kind drawn together: ``Hello,`` and ``World,`` are both ``Aa,``."""
    kinds = np.frombuffer(chunk.joined.translate(_SHAPE), dtype=np.uint8)
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | ~IN_WORD[kinds[1:]]
    short = np.ascontiguousarray(kinds[keep])
    return hashes(short, *spans(short))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value.

    Five families, each scaled by its own count in the text: lower-cased words,
    word shapes, pairs of shapes, whether a word repeats one within the last
    two, and the text's share of distinct words and its length in steps.
    """
    chunk, shaped = Chunk(texts), Chunk(texts, table=LOWER)
    doc, h, shape = chunk.doc, shaped.hash, _shapes(chunk)
    n = len(texts)
    kinds: list[tuple[np.ndarray, np.ndarray]] = [(doc, mix(h, 11)), (doc, mix(shape, 12))]
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        kinds.append((doc[1:][same], mix(runs(shape, 2), 13)[same]))
        near = h[1:] == h[:-1]
        near[1:] |= h[2:] == h[:-2]
        kinds.append((doc[1:][same], mix(near[same].astype(np.uint64), 14)))
    docs, numbers, values = [], [], []
    for d, v in kinds:
        keys, counts = np.unique((d.astype(np.int64) << np.int64(BITS)) | (v >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        owner = keys >> np.int64(BITS)
        total = np.bincount(d, minlength=n)
        docs.append(owner)
        numbers.append(keys & np.int64(SIZE - 1))
        values.append(np.sqrt(counts / total[owner]))
    distinct = np.bincount(docs[0], minlength=n)
    count = np.maximum(chunk.counts, 1)
    for seed, step in ((15, (10 * distinct // count).astype(np.uint64)), (16, np.log2(chunk.counts + 1).astype(np.uint64))):
        docs.append(np.arange(n))
        numbers.append((mix(step, seed) >> np.uint64(64 - BITS)).astype(np.int64))
        values.append(np.full(n, 0.5))
    return np.concatenate(docs), np.concatenate(numbers), np.concatenate(values)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def learn(targets: list[int], texts: Iterator[list[bytes]]) -> dict[int, float]:
    """Shared weights by feature number, thresholds from number SIZE on.

    Adaptive gradient steps on the ordinal likelihood.  Grades are the distinct
    targets in order; thresholds are kept in order after each step.
    """
    grades = sorted(set(targets))
    if len(grades) < 2:
        return {}
    y = np.searchsorted(grades, targets)
    cuts = len(grades) - 1
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for run in texts:
        doc, number, value = features(run)
        order = np.argsort(doc, kind="stable")
        doc, number, value = doc[order], number[order], value[order]
        at = np.searchsorted(doc, np.arange(len(run) + 1))
        rows += [(number[a:b].astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(at[:-1], at[1:])]
    reached = np.array([np.mean(y > k) for k in range(cuts)])
    theta = -np.log(reached / (1 - reached))
    w, seen, seen_theta = np.zeros(SIZE), np.full(SIZE, 1e-6), np.full(cuts, 1e-6)
    for _ in range(EPOCHS):
        for low in range(0, len(rows), BATCH):
            some = rows[low : low + BATCH]
            sizes = [len(i) for i, _ in some]
            index, value = np.concatenate([i for i, _ in some]), np.concatenate([v for _, v in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            score = np.bincount(owner, weights=w[index] * value, minlength=len(some))
            above = np.column_stack([np.ones(len(some)), _logistic(score[:, None] - theta), np.zeros(len(some))])
            own = y[low : low + BATCH]
            at = np.arange(len(some))
            upper, lower = above[at, own], above[at, own + 1]
            chance = np.maximum(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            slope = -(d_upper - d_lower) / len(some)
            gradient = np.bincount(index, weights=slope[owner] * value, minlength=SIZE)
            touched = np.unique(index)
            g = gradient[touched] + DECAY * w[touched]
            seen[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(seen[touched])
            for k in range(cuts):
                # threshold k is the lower bound of grade k + 1 and the upper bound of grade k
                gt = (np.sum(d_upper[own == k + 1]) - np.sum(d_lower[own == k])) / len(some)
                seen_theta[k] += gt * gt
                theta[k] -= RATE * gt / np.sqrt(seen_theta[k])
            theta = np.maximum.accumulate(theta)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)} | {SIZE + k: float(t) for k, t in enumerate(theta)}


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two marks: 0 poor, 1 readable but toxic, 2 good (null where quality is null)."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, rated: DataFrame, rows: int = TRAIN_ROWS) -> dict[int, float]:
    return fit(labelled_sample(docs, rated, F.col("grade"), rows), learn)


def rate(docs: DataFrame, model: dict[int, float], *, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), expected_grade and tail_probability of every row.

    tail_probability is that of a grade above the lowest; expected_grade counts
    grades from 0.  A text without words has features of length and share
    alone.  Without a model (one grade or no labels) both are 1: all is kept.
    """
    cuts = np.array([model[k] for k in sorted(model) if k >= SIZE])
    numbers = np.array([k for k in model if k < SIZE], dtype=np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((numbers, np.array([model[int(k)] for k in numbers]), cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, theta = sent.value
        w = np.zeros(SIZE)
        w[index] = weight
        for batch in batches:
            texts = bytes_of(batch, "_text")
            score = np.zeros(len(texts))
            for first, part in chunks(texts):
                doc, number, value = features(part)
                score[first : first + len(part)] = np.bincount(doc, weights=w[number] * value, minlength=len(part))
            tails = _logistic(score[:, None] - theta[None, :]) if len(theta) else np.ones((len(texts), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0])], ["row", "expected_grade", "tail_probability"])

    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    schema = T.StructType([T.StructField("row", row), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("binary").alias("_text")).mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept for every row of ``docs``."""
    rated = rate(docs.select("doc_id", "text"), train(docs, grades(labels)))
    return rated.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= ACCEPT).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose chance of a grade above the lowest is at least ACCEPT, unchanged."""
    return rate(docs, train(docs, grades(labels))).filter(F.col("tail_probability") >= ACCEPT).select("row.*")
