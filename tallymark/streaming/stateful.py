"""Keyed state on streams: sessions that take late panels, and stage changes in event order.

Both jobs need the RocksDB state store, which keeps large state on disk and
writes only what changed; :func:`use_state_store` sets it where the session
names none.  A restart from the checkpoint goes on where the run before ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallymark.streaming.sessions import session_state, transitions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SESSION = "session_id string, version bigint, status string, panels bigint, first_seen timestamp, last_seen timestamp, first_panel string, last_panel string, front_panels bigint"
CHANGE = "scan_id string, event_id bigint, ts timestamp, from_state string, state string, legal boolean"
#: Events that wait, in the order of judging within a scan.
PART = pa.schema([("scan_id", pa.string()), ("ts", pa.int64()), ("event_id", pa.int64()), ("state", pa.string())])
#: Scans are dealt into so many keys of the state.
BUCKETS = 1_024


def use_state_store(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


def _ts(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class SessionProcessor(StatefulProcessor):
    """A session's panels by image; closes after an idle time, and opens again when a panel comes late.

    The state is one entry for each image and one summary, so a new panel
    touches two small rows however many the session has.  The panel of an image
    that comes twice is its earliest; only then the images are read again.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.images = handle.getMapState("images", "image_id string", "ts bigint, panel string")
        self.summary = handle.getValueState("summary", "version bigint, panels bigint, front bigint, first_ts bigint, first_image string, first_panel string, last_ts bigint, last_image string, last_panel string, timer bigint")

    def _row(self, key, status: str, s: list) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "version": [s[0]], "status": [status], "panels": [s[1]], "first_seen": [_ts(s[3])], "last_seen": [_ts(s[6])], "first_panel": [s[5]], "last_panel": [s[8]], "front_panels": [s[2]]})

    @staticmethod
    def _add(s: list, image: str, ts: int, panel: str) -> None:
        s[1] += 1
        s[2] += panel == "FRONT"
        if s[1] == 1 or (ts, image) < (s[3], s[4]):
            s[3:6] = [ts, image, panel]
        if s[1] == 1 or (ts, image) > (s[6], s[7]):
            s[6:9] = [ts, image, panel]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = list(self.summary.get()) if self.summary.exists() else [0, 0, 0, 0, "", "", 0, "", "", 0]
        changed = False
        for frame in rows:
            for image, ts, panel in zip(frame["image_id"], frame["ts"], frame["panel"]):
                image, ts = str(image), _micros(ts)
                known = tuple(self.images.getValue((image,))) if self.images.containsKey((image,)) else None
                if known is not None and known <= (ts, panel):
                    continue
                changed = True
                self.images.updateValue((image,), (ts, panel))
                if known is None:
                    self._add(s, image, ts, panel)
                else:
                    s[1:9] = [0, 0, 0, "", "", 0, "", ""]
                    for (other,), (when, shown) in self.images.iterator():
                        self._add(s, other, when, shown)
        if changed:
            s[0] += 1
            if s[9]:
                self.handle.deleteTimer(s[9])
            s[9] = s[6] // 1000 + self.idle_ms
            self.handle.registerTimer(s[9])
            self.summary.update(tuple(s))
            yield self._row(key, "OPEN", s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = list(self.summary.get())
        s[0], s[9] = s[0] + 1, 0
        self.summary.update(tuple(s))
        yield self._row(key, "CLOSED", s)

    def close(self) -> None:
        pass


def late_panels(panels: DataFrame, idle: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Versions of each session of a stream (session_id, image_id, ts, panel); the highest version counts.

    A session is CLOSED once the watermark is ``idle`` past its last panel.  A
    panel that comes after that is merged into the same session, which is OPEN
    again with a higher version.
    """
    use_state_store(panels.sparkSession)
    src = panels.select(F.col("session_id").cast("string").alias("session_id"), F.col("image_id").cast("string").alias("image_id"), "ts", F.coalesce("panel", F.lit("UNKNOWN")).alias("panel")).withWatermark("ts", delay)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return src.groupBy("session_id").transformWithStateInPandas(SessionProcessor(idle_ms), SESSION, "Update", "EventTime")


def sessions_of(panels: DataFrame) -> DataFrame:
    """What :func:`late_panels` comes to, in batch: each image counts once, with its earliest panel."""
    once = panels.groupBy(F.col("session_id").cast("string").alias("session_id"), F.col("image_id").cast("string").alias("image_id")).agg(F.min(F.struct("ts", F.coalesce("panel", F.lit("UNKNOWN")).alias("panel"))).alias("p"))
    return session_state(once.select("session_id", "image_id", "p.ts", "p.panel"))


def _packed(part: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(part, schema=PART, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PART) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class ChangeProcessor(StatefulProcessor):
    """Judges the stage changes of scans in event order; what the watermark has not passed waits.

    A key is a bucket of scans, so that calls into the state store are made for
    each bucket and not for each event.  Events wait in parts as they came, by
    their first time: only parts that have events to judge are read and, where
    some of these go on waiting, written again.  The last state of each scan is
    an entry of its own.
    """

    def __init__(self):
        self.moves = set(transitions())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "named boolean, scan_id string", "state string")
        self.waiting = handle.getMapState("waiting", "first bigint, number bigint", "rows binary")
        self.next = handle.getValueState("next", "timer bigint, number bigint")

    def _wait(self, part: pd.DataFrame, number: int) -> int:
        """Keep a part under a number; returns the time of its timer."""
        first = int(part["ts"].min())
        self.waiting.updateValue((first, number), (_packed(part),))
        return first // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, number = self.next.get() if self.next.exists() else (0, 0)
        firsts = []
        for frame in rows:
            micros = np.array([_micros(ts) for ts in frame["ts"]], dtype=np.int64) if frame["ts"].hasnans else frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            part = pd.DataFrame({"scan_id": frame["scan_id"].to_numpy(), "ts": micros, "event_id": frame["event_id"].astype("int64").to_numpy(), "state": frame["state"].to_numpy()})
            if len(part):
                firsts.append(self._wait(part, number))
                number += 1
        if firsts:
            first = min(firsts)
            if not timer or first < timer:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            self.next.update((timer, number))
        return iter(())

    def _state_of(self, scan: tuple[bool, str]) -> str:
        return self.last.getValue(scan)[0] if self.last.containsKey(scan) else "CREATED"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, number = self.next.get()
        parts = [tuple(k) for k in self.waiting.keys()]
        reached, timers = [k for k in parts if k[0] < passed], [k[0] // 1000 + 1 for k in parts if k[0] >= passed]
        tables = []
        for part in reached:
            tables.append(pa.ipc.open_stream(bytes(self.waiting.getValue(part)[0])).read_all())
            self.waiting.removeKey(part)
        events = pa.concat_tables(tables) if tables else PART.empty_table()
        # Order is that of scan, time, event and state.
        events = events.sort_by([(c, "ascending") for c in PART.names])
        due = pc.less(events["ts"], passed)
        rest = events.filter(pc.invert(due)).to_pandas()
        if len(rest):
            timers.append(self._wait(rest, number))
            number += 1
        timer = min(timers, default=0)
        if timer:
            self.handle.registerTimer(timer)
        self.next.update((timer, number))
        events = events.filter(due)
        scans, states = events["scan_id"].to_pylist(), events["state"].to_pylist()
        before, legal = [], []
        for i, (scan, state) in enumerate(zip(scans, states)):
            before.append(states[i - 1] if i and scans[i - 1] == scan else self._state_of((scan is not None, scan or "")))
            legal.append(before[i] == state or (before[i], state) in self.moves)
            if i + 1 == len(scans) or scans[i + 1] != scan:
                self.last.updateValue((scan is not None, scan or ""), (state,))
        if scans:
            yield pd.DataFrame({"scan_id": scans, "event_id": events["event_id"].to_numpy(), "ts": events["ts"].to_numpy().astype("datetime64[us]"), "from_state": before, "state": states, "legal": legal})

    def close(self) -> None:
        pass


def stage_changes(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stage events of a stream (scan_id, event_id, ts, state), each with the state before it and whether the move is legal.

    Order is that of ts and event_id, whatever the order of arrival; an event
    is judged once the watermark has passed it, and one older than the
    watermark is dropped.  State is kept by buckets of scans, whose number a
    checkpoint relies on.
    """
    use_state_store(events.sparkSession)
    src = events.select(F.col("scan_id").cast("string").alias("scan_id"), F.col("event_id").cast("bigint").alias("event_id"), "ts", "state").withWatermark("ts", delay)
    bucketed = src.withColumn("bucket", F.pmod(F.xxhash64("scan_id"), F.lit(BUCKETS)))
    return bucketed.groupBy("bucket").transformWithStateInPandas(ChangeProcessor(), CHANGE, "Append", "EventTime")
