"""Knowledge entries of notices."""

from pyspark.sql import functions as F

from tallymark.sources import notices as no


def test_mentions_are_looked_for_once(spark):
    """A search filters by what is read from a paragraph; the reading stands in the plan once, not once for each filter."""
    text = "The packages named in the Second Schedule bear a license number.\n\nRule 6(1) asks for a license, too, and for the name of the maker.\n\nshort Rule 7\n\nNothing here is about it, and nothing is kept of it."
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", None)], "doc_id int, text string, source string")
    entries = no.knowledge_entries(docs, ["doc_id"])
    found = no.search_text(no.merge_knowledge(entries, no.advisory_entries(docs, ["doc_id"])), " License ")
    plan = found.groupBy("product_category").agg(F.count(F.lit(1)).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Seventh") == 1
    got = sorted((r["doc_id"], r["paragraph"], r["rule_number"]) for r in found.collect())
    assert got == [(1, 0, "Rule 6(1)"), (1, 0, "Second Schedule"), (1, 1, "Rule 6(1)")]
    assert sorted(set(entries.columns) & {"_rule", "_schedule", "_tags", "raw"}) == []
