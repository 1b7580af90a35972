"""Ordered computations per key that survive a key with a third of all rows.

A plain window puts a whole key into one task.  Here a key is cut into
segments, the window runs inside (key, segment), and only one edge row per
segment travels between segments.  ``segment`` must never fall when the order
rises (a day or hour of a timestamp, a band of a coordinate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import cut_lineage


# Rows that one task holds together.
ROWS_TOGETHER = 200_000


def crowded(df: DataFrame, key: str, most: int) -> tuple[DataFrame | None, int]:
    """(key) of more than ``most`` rows, None if there are none: only these need to be cut into segments.  Also the number of rows with a key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_many"))
    rows, largest = counts.agg(F.coalesce(F.sum("_many"), F.lit(0)), F.coalesce(F.max("_many"), F.lit(0))).first()
    return cut_lineage(counts.filter(F.col("_many") > most).select(key)) if largest > most else None, rows


def together(df: DataFrame, key: str, rows: int) -> DataFrame:
    """All rows of a key in one task, in so many tasks that none has to spill ``rows`` divided among them."""
    parts = rows // ROWS_TOGETHER + 1
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def _edges(df: DataFrame, keys: Sequence[str], segment: str, agg: Column, name: str) -> DataFrame:
    return df.groupBy(*keys, segment).agg(agg.alias(name))


def _attach(df: DataFrame, edges: DataFrame, keys: Sequence[str], segment: str) -> DataFrame:
    return df.join(edges, [*keys, segment], "left")


def lag_across(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Previous row's ``columns`` within the key, over segment borders."""
    inner = Window.partitionBy(*keys, segment).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(segment)
    body = F.struct(*columns)
    edges = _edges(df, keys, segment, F.max_by(body, F.struct(*order)), "_edge")
    edges = edges.select(*keys, segment, F.lag("_edge").over(across).alias("_edge"))
    out = df.withColumn("_prev", F.lag(body).over(inner))
    out = _attach(out, edges, keys, segment).withColumn("_prev", F.coalesce("_prev", "_edge"))
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in columns])


def max_before_across(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], value: Column, out_col: str) -> DataFrame:
    """Greatest value among the earlier rows of the key; null on its first row."""
    df = df.withColumn("_v", value)
    before = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    edges = _edges(df, keys, segment, F.max("_v"), "_edge").select(*keys, segment, F.max("_edge").over(across).alias("_edge"))
    out = _attach(df.withColumn("_own", F.max("_v").over(before)), edges, keys, segment)
    # greatest() skips nulls, as a first row and a first segment have.
    return out.withColumn(out_col, F.greatest("_own", "_edge")).drop("_v", "_own", "_edge")


def running_sum_across(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], value: Column, out_col: str) -> DataFrame:
    """Inclusive running sum within the key: local sum plus the sum of earlier segments."""
    inner = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    src = df.withColumn("_v", value)
    edges = _edges(src, keys, segment, F.sum("_v"), "_edge")
    edges = edges.select(*keys, segment, F.coalesce(F.sum("_edge").over(across), F.lit(0)).alias("_edge"))
    out = src.withColumn("_local", F.sum("_v").over(inner))
    return _attach(out, edges, keys, segment).select(*df.columns, (F.col("_local") + F.coalesce("_edge", F.lit(0))).alias(out_col))


def row_number_across(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], out_col: str = "position") -> DataFrame:
    return running_sum_across(df, keys, segment, order, F.lit(1), out_col)


def fill_across(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], value: str, out_col: str) -> DataFrame:
    """Last non-null ``value`` at or before each row of the key."""
    inner = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    edges = _edges(df, keys, segment, last, "_edge")
    edges = edges.select(*keys, segment, F.last("_edge", ignorenulls=True).over(across).alias("_edge"))
    out = df.withColumn("_local", F.last(value, ignorenulls=True).over(inner))
    return _attach(out, edges, keys, segment).select(*df.columns, F.coalesce("_local", "_edge").alias(out_col))
