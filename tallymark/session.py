"""Session settings shared by the jobs, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "tallymark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session.  Cluster settings win: nothing is forced unless given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as the cluster names it.

    Only where the setting is absent (tests on one machine) a fresh local
    folder is chosen.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getConf().get("spark.checkpoint.dir")
    if configured is None:
        existing = context.getCheckpointDir()
        if existing is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = existing or tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that an iterative job survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a narrow, CPU-heavy job out over all cores of the session.

    The bytes of a table say little about such work: labels cost a thousand
    times their reading, and a file of few row groups is read by few tasks,
    however many it is split into.  Rows are dealt out in
    ``tallymark.spread`` parts if that is set, else in as many as
    ``spark.sql.shuffle.partitions`` says, four for each core at least.
    """
    session = df.sparkSession
    parts = session.conf.get("tallymark.spread", None)
    return df.repartition(int(parts) if parts else max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism))


def spread_wide(df: DataFrame) -> DataFrame:
    """:func:`spread` for long texts, which are only sent around when fewer tasks than two for each core read them."""
    few = df.rdd.getNumPartitions() < 2 * df.sparkSession.sparkContext.defaultParallelism
    return spread(df) if few or df.sparkSession.conf.get("tallymark.spread", None) else df
