"""Late panels, pipeline states, audit feeds and live counters as streams.

The stream jobs reuse the batch operators: a stream is only another way to feed
the same frames, so batch and stream agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark.operators import analytics as an
from tallymark.operators import carry
from tallymark.sources.dockets import latest_per_id

# fixed values: states of a scan and the legal moves between them
STATES = (
    "CREATED", "IMAGE_RECEIVED", "QUALITY_ANALYZED", "IMAGE_RECOVERED", "OCR_COMPLETED", "SEMANTIC_ANALYSIS_COMPLETED", "PRODUCT_IDENTIFIED",
    "PRODUCT_SCHEMA_COMPLETED", "PANELS_MERGED", "RULES_EVALUATED", "VIOLATIONS_EVALUATED", "FINALIZED", "FAILED", "PARTIAL", "NEEDS_REVIEW",
)
MAIN_PATH = STATES[:12]
PARTIAL_FROM = ("VIOLATIONS_EVALUATED", "QUALITY_ANALYZED", "OCR_COMPLETED", "PRODUCT_IDENTIFIED", "PANELS_MERGED")
REVIEW_FROM = ("VIOLATIONS_EVALUATED", "RULES_EVALUATED")
FAILED_FROM = STATES[:10]


def transitions() -> list[tuple[str, str]]:
    moves = list(zip(MAIN_PATH, MAIN_PATH[1:], strict=False))
    moves += [(s, "FAILED") for s in FAILED_FROM] + [(s, "PARTIAL") for s in PARTIAL_FROM] + [(s, "NEEDS_REVIEW") for s in REVIEW_FROM]
    return moves


def can_transition(old: Column, new: Column) -> Column:
    """Legal move, or no move at all."""
    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in transitions()])
    return (old == new) | F.array_contains(legal, F.concat_ws(">", old, new))


def check_transitions(events: DataFrame, scan: str, segment: str, order: list[str], state: str = "state") -> DataFrame:
    """Mark each state change of a scan as legal or not (first state counts from CREATED)."""
    seen = carry.lag_across(events, [scan], segment, order, [state])
    old = F.coalesce(F.col(f"prev_{state}"), F.lit("CREATED"))
    return seen.withColumn("from_state", old).withColumn("legal", can_transition(old, F.col(state))).drop(f"prev_{state}")


def audit_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Audit events with an id from their content, so replays do not duplicate."""
    return rows.withColumn("audit_id", F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws(":", *keys), 256), 1, 16)))


def distinct_events(events: DataFrame, delay: str = "1 day", id_col: str = "audit_id", ts: str = "ts") -> DataFrame:
    """Drop repeated deliveries.  A stream keeps ids only within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])
    return events.dropDuplicates([id_col])


def session_state(panels: DataFrame) -> DataFrame:
    """State of a session from its panels, in any order of arrival.

    Every part is a commutative aggregate (count, min, max, first by order), so
    late and out-of-order panels lead to the state a batch would give.
    """
    return panels.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("panels"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("panel", F.struct("ts", "image_id")).alias("first_panel"), F.max_by("panel", F.struct("ts", "image_id")).alias("last_panel"),
        F.sum(F.when(F.col("panel") == "FRONT", 1).otherwise(0)).cast("bigint").alias("front_panels"))


def live_kpis(dockets: DataFrame) -> DataFrame:
    """Dashboard counters kept up to date (complete mode when streaming)."""
    return an.kpi_card(dockets)


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    src = events.withWatermark(ts, delay) if events.isStreaming else events
    g = src.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "events", "total")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop.  The sink sees whole micro-batches."""
    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _held(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Folders of the table as of the last version (before batch ``before``)."""
    try:
        versions = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    if before is not None:
        versions = versions.filter(F.col("version") < before)
    last = versions.agg(F.max_by("folders", "version")).first()[0]  # one row for each version
    return list(last or [])


def upsert_sink(path: str, key: str, seq: str, most: int = 8) -> Callable[[DataFrame, int], None]:
    """Latest-wins docket table as folders that a manifest names.

    A batch writes a folder of level 0; as soon as a level has more than
    ``most`` folders they are merged into one of the next, so a row is rewritten
    once for each level and a reader opens few folders, however many batches
    came.  Every batch then writes its own version of the manifest.  A retry
    starts from the version before it and overwrites exactly what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, level: int) -> str:
            folder = f"level{level}-{batch_id}"
            latest_per_id(df, key, F.col(seq)).write.mode("overwrite").parquet(f"{path}/data/{folder}")
            return folder

        held, level = [*_held(spark, path, batch_id), put(batch, 0)], 0
        while len(full := [f for f in held if f.startswith(f"level{level}-")]) > most:
            merged = put(spark.read.parquet(*[f"{path}/data/{f}" for f in full]), level + 1)
            held, level = [f for f in held if f not in full] + [merged], level + 1
        spark.createDataFrame([(held,)], "folders array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={batch_id}")

    return write


def read_upserts(spark: SparkSession, path: str, key: str, seq: str) -> DataFrame:
    """The table as of the last whole version: a reader never sees half a batch or half a merge."""
    return latest_per_id(spark.read.parquet(*[f"{path}/data/{f}" for f in _held(spark, path)]), key, F.col(seq))


def rerun_guard(requests: DataFrame, finished: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Scans that still have to run: a finished scan is not computed again."""
    return requests.join(finished.select(scan).distinct(), scan, "left_anti")


def distinct_requests(requests: DataFrame, keys: list[str], delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Requests with the fingerprint of ``keys``, each fingerprint once: the first of a stream within the watermark, the earliest of a batch."""
    text = F.concat_ws(":", *[F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys])
    marked = requests.withColumn("fingerprint", F.substring(F.sha2(text, 256), 1, 32))
    if marked.isStreaming:
        return distinct_events(marked, delay, "fingerprint", ts)
    row = F.struct(*[F.col(c) for c in marked.columns if c != "fingerprint"])
    return marked.groupBy("fingerprint").agg(F.min_by(row, F.struct(ts, *keys)).alias("r")).select("r.*", "fingerprint")
