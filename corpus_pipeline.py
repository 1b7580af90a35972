"""The corpus pipeline: five stages over ``documents``, each an operator of the llm subpackage.

Every stage takes what its predecessor kept, is written as Parquet and read
again.  All but the last return the columns of ``documents``.

* quality: documents whose chance of a grade above the lowest is under one half go.
* near_duplicates: of each group of near duplicates the smallest id stays.
* decontamination: documents in which a window of the benchmark occurs go.
* mixing: documents in training order, once for each pass that takes them, so a
  document can come twice; those that no pass takes go.
* token_shards: every sequence of every document at its slot, written as shards
  and read back.  Slots follow the order of the mix but for a permutation within
  windows of four shards.

Rows without an id or a text pass through the stages by each operator's rules;
a row that mixing counts with no word is never taken.  Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import curriculum, decontaminate, materialise, near_duplicates, quality
from tallymark.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs, COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.materialise(docs, COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialise.token_shards(docs, window=materialise.WINDOW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]

#: A trained classifier and a tokenizer cannot be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
