"""Labels and documents that lie in one small file are worked on by all cores."""

from pyspark.sql import functions as F

from tallymark.operators import fuse as fu
from tallymark.operators import layout as ly
from tallymark.plans.labels import labels, texts
from tallymark.sources import transcripts as tr


def _tables(spark, folder):
    k = F.col("id")
    spark.range(500).select(
        k.alias("p_partkey"), F.concat(F.lit("part "), k).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), (k % 50).cast("int").alias("p_size"),
        (900 + k / 10).alias("p_retailprice")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.range(300).select(k.alias("doc_id"), F.concat(F.lit("text "), k).alias("text")).coalesce(1).write.parquet(f"{folder}/documents.parquet")


def test_one_file_is_dealt_out_over_the_cores(spark, tmp_path):
    _tables(spark, tmp_path)
    cores = spark.sparkContext.defaultParallelism
    rendered, both = labels(spark, str(tmp_path)), texts(spark, str(tmp_path))
    for df, rows in ((rendered, 500), (both, 800)):
        held = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(held) >= 4 * cores
        assert sum(r["count"] for r in held) == rows
        assert max(r["count"] for r in held) < rows / 4
    assert rendered.select("doc_id").distinct().count() == 500


def test_repeated_lines_are_counted_in_many_tasks(spark, tmp_path):
    _tables(spark, tmp_path)
    lines = tr.explode_lines(texts(spark, str(tmp_path)), ["doc_id"])
    assert lines.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    found = {r["line_key"]: r for r in fu.repeated_lines(lines, ["doc_id", "line_index"]).collect()}
    assert found["gurugramharyana"]["occurrences"] == len([k for k in range(500) if k % 3 == 1])
    assert found["text299"]["first"]["doc_id"] == "D299"


def test_cells_are_not_sent_whole_to_every_task(spark):
    words = spark.createDataFrame([(1, 1, 10.0, 10.0, 4.0, 4.0), (2, 1, 300.0, 10.0, 4.0, 4.0), (3, 2, 10.0, 10.0, 4.0, 4.0), (4, None, 10.0, 10.0, 4.0, 4.0)], "id int, image_id int, x double, y double, w double, h double")
    cells = spark.createDataFrame([(7, 1, 0.0, 0.0, 90.0, 70.0), (8, 1, 0.0, 0.0, 400.0, 70.0), (9, None, 0.0, 0.0, 90.0, 70.0)], "cell_id int, image_id int, x double, y double, w double, h double")
    found = ly.words_in_cells(words, cells)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r["id"], r["cell_id"]) for r in found.collect()) == [(1, 7), (1, 8), (2, 8)]
