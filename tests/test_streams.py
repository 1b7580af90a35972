"""Files, sinks and streams: the stream gives what the batch gives."""

from pyspark.sql import functions as F

from tallymark.sources import dockets as store
from tallymark.streaming import sessions as st

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_upsert_equals_batch(spark, tmp_path):
    src = spark.read.parquet(EVENTS).select("user_id", "event_id", "event_type")
    # Panels arrive late and twice: three files, out of order.
    for i, part in enumerate([src.filter("event_id % 3 = 2"), src.filter("event_id % 3 = 0"), src.filter("event_id % 3 <> 2")]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    st.run_available(stream, st.upsert_sink(str(tmp_path / "out"), "user_id", "event_id"), str(tmp_path / "cp"))
    got = st.read_upserts(spark, str(tmp_path / "out"), "user_id", "event_id")
    want = store.latest_per_id(src, "user_id", F.col("event_id"))
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "event_id", "event_type").collect())
    assert key(got) == key(want)


def test_upserts_are_merged_by_levels_and_survive_a_retry(spark, tmp_path):
    path, rows = str(tmp_path / "t"), []
    sink = st.upsert_sink(path, "id", "seq", most=2)
    for batch in range(9):
        new = [(k, batch * 10 + k % 3, f"b{batch}") for k in range(batch % 4, 6)]
        rows += new
        for _ in range(1 + (batch == 5)):
            sink(spark.createDataFrame(new, "id int, seq int, v string"), batch)
    want = {k: max((s, v) for i, s, v in rows if i == k) for k in range(6)}
    assert {r["id"]: (r["seq"], r["v"]) for r in st.read_upserts(spark, path, "id", "seq").collect()} == want
    held = st._held(spark, path)
    assert held == ["level2-8"] or (len(held) <= 6 and any(f.startswith("level1-") for f in held))
    assert st._held(spark, path, 3) == ["level1-2"]


def test_session_state_ignores_arrival_order(spark, tmp_path):
    e = spark.read.parquet(EVENTS).selectExpr("user_id as session_id", "event_id as image_id", "cast(ts as timestamp) as ts", "upper(event_type) as panel")
    e.repartition(3, "image_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []

    def sink(batch, _):
        out.append(sorted(map(tuple, batch.collect())))

    st.run_available(st.session_state(stream), sink, str(tmp_path / "cp"), "complete")
    assert out[-1] == sorted(map(tuple, st.session_state(e).collect()))


def test_repeated_deliveries_are_dropped_in_a_stream(spark, tmp_path):
    e = st.audit_events(spark.read.parquet(EVENTS).selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts"), ["user_id", "event_id"])
    e.unionByName(e.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    seen = []
    st.run_available(st.distinct_events(stream, "60 days"), lambda b, _: seen.extend(r.audit_id for r in b.collect()), str(tmp_path / "cp"))
    assert len(seen) == len(set(seen)) == e.select("audit_id").distinct().count()


def test_audit_csv_and_search_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi"'), (2, "plain")], "id int, details string")
    store.export_audit_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert '"1","say ""hi"""' in text
    docs = spark.createDataFrame([("s", "n", "m", "t", "COMPLIANT", 100, "2024")], "scan_id string, product_name string, manufacturer string, ocr_text string, overall_status string, compliance_score int, ts string")
    for _ in range(2):
        store.append_search_rows(docs, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).count() == 2


def test_bad_json_becomes_an_empty_docket(spark):
    raw = spark.createDataFrame([('{"scan_id":"a","compliance_score":0}',), ("{oops",)], "docket_json string")
    got = store.docket_row(store.parse_dockets(raw)).collect()
    assert [(r.id, r.compliance_score, r.product_name) for r in got] == [("a", 0, "Packaged Commodity"), (None, 100, "Packaged Commodity")]


def test_illegal_skip_is_marked(spark):
    rows = [("s", 1, "IMAGE_RECEIVED"), ("s", 2, "OCR_COMPLETED"), ("s", 3, "FAILED"), ("s", 4, "FAILED")]
    df = spark.createDataFrame(rows, "scan string, o int, state string").withColumn("seg", F.floor(F.col("o") / 2))
    got = {r.o: r.legal for r in st.check_transitions(df, "scan", "seg", ["o"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_requests_of_one_fingerprint_pass_once(spark, tmp_path):
    e = spark.read.parquet(EVENTS).selectExpr("user_id", "event_type", "cast(ts as timestamp) as ts").orderBy("ts")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    seen = []
    st.run_available(st.distinct_requests(stream, ["user_id", "event_type"], "4000 days"), lambda b, _: seen.extend(r["fingerprint"] for r in b.collect()), str(tmp_path / "cp"))
    batch = [r["fingerprint"] for r in st.distinct_requests(e, ["user_id", "event_type"]).collect()]
    assert sorted(seen) == sorted(batch) and len(set(batch)) == e.select("user_id", "event_type").distinct().count()
