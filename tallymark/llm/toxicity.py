"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning rates are kept for each coordinate and L1 drives most weights to
exactly zero, so the model is a short list of (feature, weight) that any worker
can hold: at most 2^BITS + 1 numbers, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.decontaminate import NORMAL
from tallymark.llm.training import TRAIN_ROWS, fit, held_out, label_counts, labelled_sample
from tallymark.llm.words import Chunk, bytes_of, chunks, mix, runs

BITS = 20
BIAS = 1 << BITS
EPOCHS = 6
ALPHA, BETA, L2 = 1.0, 1.0, 0.1
#: L1 grows with the sample, as the sums that it holds back do.
L1_LEAST, L1_PER_ROW = 0.5, 5e-4
#: A feature is let in when this many texts of the sample have it.
MET = 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of every word, word pair and pair with one word between, repeats included.

    A word is a run of letters and digits, A-Z lower-cased.
    """
    chunk = Chunk(texts, table=NORMAL)
    h, doc = chunk.hash, chunk.doc
    kinds = [(doc, h)]
    if len(h) > 1:
        kinds.append((doc[:-1], np.where(doc[1:] == doc[:-1], runs(h, 2), h[:-1])))
    if len(h) > 2:
        skip = mix(h[:-2] * np.uint64(3) + mix(h[2:], 7), 5)
        kinds.append((doc[:-2], np.where(doc[2:] == doc[:-2], skip, h[:-2])))
    return np.concatenate([d for d, _ in kinds]), (np.concatenate([v for _, v in kinds]) >> np.uint64(64 - BITS)).astype(np.int64)


def learn(targets: list[int], texts: Iterator[list[bytes]]) -> dict[int, float]:
    """FTRL-proximal over the sample, one text at a time, in the given order."""
    rows: list[np.ndarray] = []
    for run in texts:
        doc, number = features(run)
        keys = np.unique((doc << np.int64(BITS)) | number)
        cut = np.searchsorted(keys >> np.int64(BITS), np.arange(len(run) + 1))
        rows += [np.append((keys[a:b] & np.int64(BIAS - 1)), BIAS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
    met = np.bincount(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), minlength=BIAS + 1)
    rows = [row[(met[row] >= MET) | (row == BIAS)] for row in rows]
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    l1 = max(L1_LEAST, L1_PER_ROW * len(rows))

    def weights(at) -> np.ndarray:
        held = z[at]
        w = -(held - np.sign(held) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(held) <= l1, 0.0, w)

    for _ in range(EPOCHS if len(set(targets)) > 1 else 1):
        for at, target in zip(rows, targets):
            w = weights(at)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - target
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    every = weights(np.arange(BIAS + 1))
    return {int(i): float(every[i]) for i in np.flatnonzero(every)}


def base_rate_shift(population: dict[int, int], sample: dict[int, int]) -> float:
    """What the bias of a model fitted on ``sample`` lacks where classes 0 and 1 come as in ``population``: the log ratio of their odds (0 where a class is missing)."""
    if not all(counts.get(c) for counts in (population, sample) for c in (0, 1)):
        return 0.0
    return math.log(population[1] / population[0]) - math.log(sample[1] / sample[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict[int, float]:
    """The non-zero weights, learnt from at most ``rows`` labelled documents outside the held-out fold (none: no weights, all scores 0.5).

    Half of the sample may be toxic, so that rare words of abuse are seen often
    enough; the bias is then moved to the shares of the two classes among all
    labels outside the held-out fold.
    """
    sample = labelled_sample(docs, labels, F.col("toxic"), rows, classes=(0, 1))
    shares = [{r["target"]: r["count"] for r in counts.filter("target in (0, 1)").collect()} for counts in (label_counts(labels, F.col("toxic")), sample.groupBy("target").count())]
    weights = fit(sample, learn)
    return weights | {BIAS: weights.get(BIAS, 0.0) + base_rate_shift(*shares)} if weights else weights


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """doc_id and score (0..1) of every row; the texts are all that is read.

    A feature counts once in a text.  Null, empty and wordless texts score by
    the bias alone; repeated rows score alike.
    """
    dense = np.zeros(BIAS + 1)
    dense[list(weights)] = list(weights.values())
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(dense).astype(np.int32), dense[dense != 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BIAS + 1)
        full[sent.value[0]] = sent.value[1]
        for batch in batches:
            texts = bytes_of(batch, "text")
            sums = np.full(len(texts), full[BIAS])
            for first, part in chunks(texts):
                doc, number = features(part)
                active = full[number] != 0
                keys = np.unique((doc[active] << np.int64(BITS)) | number[active])
                sums[first : first + len(part)] += np.bincount(keys >> np.int64(BITS), weights=full[keys & np.int64(BIAS - 1)], minlength=len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
