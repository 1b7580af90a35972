"""Phrases of a vocabulary file against regular expressions, one a phrase."""

import re

from tallymark.operators import vocabulary as vo

TEXTS = {1: "Green Tea 100 g. green tea, GREEN  TEA; greentea", 2: "Non-veg snack & non-veg", 3: "", 4: None, 5: "tea", 6: "led bulb led LED leds imported by Acme", 7: "serum serum serum face wash face  wash wash", 8: "shampoo " * 400}
ROWS = [("FOOD", "keyword", "", "tea"), ("FOOD", "keyword", "", "Green Tea"), ("FOOD", "keyword", "", "non-veg"), ("FOOD", "sub", "TEA", "ea"), ("FOOD", "sub", "SNACK", "snack"), ("FOOD", "keyword", "", "tea"),
        ("ELECTRICAL", "keyword", "", "led"), ("ELECTRICAL", "keyword", "", "led bulb"), ("COSMETIC", "keyword", "", "serum"), ("COSMETIC", "keyword", "", "face wash"), ("COSMETIC", "keyword", "", "shampoo"), ("HAIR", "keyword", "", "shampoo"), ("COSMETIC", "keyword", "", "--")]


def test_categories_of_a_vocabulary_file(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_text("category,kind,subcategory,phrase\n" + "".join(",".join(r) + "\n" for r in ROWS))
    vocabulary = vo.read_vocabulary(spark, str(path))
    docs = spark.createDataFrame(list(TEXTS.items()), "id int, text string")
    hits = {(r["id"], r["phrase"]): r["hits"] for r in vo.phrase_hits(docs, vocabulary.filter("kind = 'keyword'"), "id").collect()}
    phrases = {r[3].lower() for r in ROWS if r[1] == "keyword" and r[3][0].isalpha()}
    want = {(i, p): len(re.findall(rf"\b{re.escape(p)}\b", (t or "").lower())) for i, t in TEXTS.items() for p in phrases}
    assert hits == {k: n for k, n in want.items() if n}
    got = {r["id"]: (r["category"], r["subcategory"], r["confidence"], r["status"], r["runner_up"]) for r in vo.vocabulary_categories(docs, vocabulary, "id").collect()}
    assert got[1] == ("FOOD", "TEA", 0.54, "NEEDS_REVIEW", None) and got[3] == got[4] == ("UNKNOWN", None, 0.0, "NEEDS_REVIEW", None)
    assert got[2] == ("UNKNOWN", None, 0.3, "NEEDS_REVIEW", None) and got[5] == got[3]
    assert got[6] == ("UNKNOWN", None, 0.39, "NEEDS_REVIEW", "IMPORTED_PRODUCT")
    assert got[7] == ("COSMETIC", None, 0.55, "CONFIRMED", None) and got[8] == ("UNKNOWN", None, 0.4, "NEEDS_REVIEW", "HAIR")
    assert vo.vocabulary_categories(docs, vocabulary.limit(0), "id").filter("category <> 'UNKNOWN'").count() == 0


def test_words_are_not_sent_around(spark, monkeypatch):
    """Only hits are shuffled, whatever the planner takes the vocabulary for; a larger one is joined by sorting, with the same hits."""
    docs = spark.createDataFrame([(i, f"green tea {i} green green tea blue") for i in range(20)], "id int, text string")
    phrases = spark.createDataFrame([("Green Tea",), ("green",), ("tea",), ("green tea 7 green",), ("green tea zzz",)], "phrase string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hits = vo.phrase_hits(docs, phrases, "id")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
        want = sorted(map(tuple, hits.collect()))
        assert (7, "green tea 7 green", 1) in want and (3, "green", 3) in want and len(want) == 61
        monkeypatch.setattr(vo, "SENT_BYTES", -1)
        assert sorted(map(tuple, vo.phrase_hits(docs, phrases, "id").collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
