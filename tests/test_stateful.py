"""Keyed state on streams equals the batch answer, over restarts and files in any order."""

import pytest
from pyspark.sql import functions as F

from tallymark.streaming import sessions as st
from tallymark.streaming import stateful as sf

EVENTS = "/root/testdata/sf0.001/events.parquet"
T0 = "timestamp'2024-01-01 00:00:00'"


def feed(spark, tmp_path, frames, make, mode):
    """Each frame is a file and a run of its own, so every run restarts from the checkpoint."""
    out = []
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        st.run_available(make(stream), lambda b, _: out.extend(b.collect()), str(tmp_path / "cp"), mode)
    return out


def panels(spark, rows):
    return spark.createDataFrame(rows, "session_id string, image_id string, hour double, panel string").select("session_id", "image_id", (F.expr(T0) + F.expr("make_interval(0, 0, 0, 0, 0, 0, hour * 3600)")).alias("ts"), "panel")


def test_a_session_closes_and_takes_a_late_panel(spark, tmp_path):
    frames = [
        panels(spark, [("s", "front", 0.0, "FRONT"), ("t", "x", 0.5, None), ("s", "front", 0.0, "FRONT")]),
        panels(spark, [("clock", "a", 10.0, "FRONT")]),
        panels(spark, [("s", "back", 9.5, "BACK"), ("t", "x", 9.2, "LEFT")]),
        panels(spark, [("clock", "b", 40.0, "BACK")]),
    ]
    out = feed(spark, tmp_path, frames, lambda s: sf.late_panels(s, "1 hour", "1 hour"), "update")
    seen = [(r["version"], r["status"], r["panels"], r["last_panel"]) for r in sorted((r for r in out if r["session_id"] == "s"), key=lambda r: r["version"])]
    assert seen == [(1, "OPEN", 1, "FRONT"), (2, "CLOSED", 1, "FRONT"), (3, "OPEN", 2, "BACK"), (4, "CLOSED", 2, "BACK")]
    last = {}
    for r in out:
        last[r["session_id"]] = max(last.get(r["session_id"], r), r, key=lambda x: x["version"])
    everything = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    want = {tuple(r) for r in sf.sessions_of(everything).collect()}
    assert {(r["session_id"], r["panels"], r["first_seen"], r["last_seen"], r["first_panel"], r["last_panel"], r["front_panels"]) for r in last.values()} == want


def test_stage_changes_of_shuffled_files_equal_the_batch(spark, tmp_path):
    states = F.array(*[F.lit(s) for s in st.STATES])
    e = spark.read.parquet(EVENTS).select(F.col("user_id").cast("string").alias("scan_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.element_at(states, (1 + F.col("event_id") % 15).cast("int")).alias("state"))
    end = spark.createDataFrame([("end", -1, "CREATED")], "scan_id string, event_id bigint, state string").select("scan_id", "event_id", F.expr("timestamp'2100-01-01'").alias("ts"), "state")
    parts = [e.filter(f"event_id % 3 = {k}") for k in (2, 0, 1)]
    out = feed(spark, tmp_path, [*parts, end], lambda s: sf.stage_changes(s, "4000 days"), "append")
    batch = st.check_transitions(e.withColumn("day", F.to_date("ts")), "scan_id", "day", ["ts", "event_id"])
    want = {tuple(r) for r in batch.select("scan_id", "event_id", "from_state", "state", "legal").collect()}
    got = [(r["scan_id"], r["event_id"], r["from_state"], r["state"], r["legal"]) for r in out if r["scan_id"] != "end"]
    assert set(got) == want and len(got) == len(want)


def test_scans_share_calls_into_the_state(spark, tmp_path, monkeypatch):
    """The state is asked for buckets of scans; scans of one bucket keep apart, also over runs and without an id."""
    calls = str(tmp_path / "calls")

    class Counted(sf.ChangeProcessor):
        def handleInputRows(self, key, rows, timerValues):
            with open(calls, "a") as out:
                out.write("x")
            return super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(sf, "ChangeProcessor", Counted)
    monkeypatch.setattr(sf, "BUCKETS", 6)
    rows = [(f"s{k % 200}" if k % 200 else None, k, float(k * 7 % 1_200), st.STATES[k * k % len(st.STATES)]) for k in range(1_200)]
    make = lambda some: spark.createDataFrame(some, "scan_id string, event_id bigint, hour double, state string").select("scan_id", "event_id", (F.expr(T0) + F.expr("make_interval(0, 0, 0, 0, 0, 0, hour * 60)")).alias("ts"), "state")
    frames = [make(rows[:600]), make(rows[600:]), make([("end", -1, 1e6, "CREATED")])]
    out = feed(spark, tmp_path, frames, lambda s: sf.stage_changes(s, "30 days"), "append")
    want, last = [], {}
    for scan, event, _, state in sorted(rows, key=lambda r: (r[2], r[1])):
        before = last.get(scan, "CREATED")
        want.append((scan, event, before, state, before == state or (before, state) in set(st.transitions())))
        last[scan] = state
    got = [(r["scan_id"], r["event_id"], r["from_state"], r["state"], r["legal"]) for r in out if r["scan_id"] != "end"]
    assert sorted(got, key=str) == sorted(want, key=str) and len(open(calls).read()) <= 2 * 6 + 1


@pytest.fixture(autouse=True)
def _state_store(spark):
    before = spark.conf.get(sf.PROVIDER, None)
    yield
    spark.conf.unset(sf.PROVIDER) if before is None else spark.conf.set(sf.PROVIDER, before)
