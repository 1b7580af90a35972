"""Stream-shaped queries over the events table, answered in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymark.plans import sqltext as q
from tallymark.plans.registry import query, table
from tallymark.session import checkpoint_dir
from tallymark.streaming import sessions as st
from tallymark.streaming import stateful as sf


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("session_states", "ST1", """
select user_id as session_id, count(*) as panels, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen,
  arg_min(case event_type when 'click' then 'FRONT' else upper(event_type) end, strftime(ts, '%Y%m%d%H%M%S.%f') || lpad(cast(event_id as varchar), 12, '0')) as first_panel,
  arg_max(case event_type when 'click' then 'FRONT' else upper(event_type) end, strftime(ts, '%Y%m%d%H%M%S.%f') || lpad(cast(event_id as varchar), 12, '0')) as last_panel, count(*) filter (event_type = 'click') as front_panels from events group by 1""")
def session_states(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("image_id"), "ts", F.when(F.col("event_type") == "click", "FRONT").otherwise(F.upper("event_type")).alias("panel"))
    s = st.session_state(e)
    for c in ("first_seen", "last_seen"):
        s = s.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return s


_LEGAL = "[" + ", ".join(q.lit(f"{a}>{b}") for a, b in st.transitions()) + "]"


@query("state_transitions", "ST2", f"""
with s as (select *, ({q.array(st.STATES)})[1 + event_id % 15] as state from events), p as (select *, coalesce(lag(state) over (partition by user_id order by ts, event_id), 'CREATED') as from_state from s)
select event_id, user_id, from_state, state, from_state = state or list_contains({_LEGAL}, from_state || '>' || state) as legal from p""")
def state_transitions(spark, d):
    e = events(spark, d).withColumn("state", F.element_at(F.array(*[F.lit(s) for s in st.STATES]), (1 + F.col("event_id") % 15).cast("int"))).withColumn("day", F.to_date("ts"))
    return st.check_transitions(e, "user_id", "day", ["ts", "event_id"]).select("event_id", "user_id", "from_state", "state", "legal")


@query("audit_feed", "ST3", """
select user_id, count(*) as events, min('evt_' || substr(sha256(cast(user_id as varchar) || ':' || cast(event_id as varchar)), 1, 16)) as first_id from events group by 1""")
def audit_feed(spark, d):
    e = st.audit_events(events(spark, d), ["user_id", "event_id"])
    once = st.distinct_events(e.unionByName(e.filter("event_id % 3 = 0")))
    return once.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.min("audit_id").alias("first_id"))


@query("open_requests", "ST4", """
select user_id, count(*) as requests from events where user_id not in (select c_custkey from customer where c_mktsegment = 'MACHINERY') group by 1""")
def open_requests(spark, d):
    done = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("scan_id"))
    r = st.rerun_guard(events(spark, d).withColumn("scan_id", F.col("user_id")), done)
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"))


@query("distinct_requests", "ST4", """
select 'F' || substr(sha256(cast(user_id as varchar) || ':' || lower(event_type) || ':' || cast(event_id % 50 as varchar)), 1, 32) as mark, user_id, lower(event_type) as kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen
from events group by user_id, lower(event_type), event_id % 50""")
def distinct_requests(spark, d):
    e = events(spark, d).select("user_id", F.lower("event_type").alias("kind"), (F.col("event_id") % 50).alias("part"), "ts")
    once = st.distinct_requests(e, ["user_id", "kind", "part"])
    return once.select(F.concat(F.lit("F"), "fingerprint").alias("mark"), "user_id", "kind", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("daily_event_counts", "ST5", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 3) as total from events group by 1, 2")
def daily_event_counts(spark, d):
    w = st.windowed_counts(events(spark, d), "ts", "event_type")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 3).alias("total"))


@query("live_kpis", "ST5 A1", """
select count(*) as total_scans, count(*) filter (o_orderstatus = 'F') as compliant_count, count(*) filter (o_orderstatus = 'O') as non_compliant_count, count(*) filter (o_orderstatus = 'P') as review_count,
  cast(count(*) filter (o_orderstatus = 'O') as bigint) as violations_count, round(count(*) filter (o_orderstatus = 'F') * 100.0::double / count(*), 1) as compliance_rate from orders""")
def live_kpis(spark, d):
    s = F.col("o_orderstatus")
    o = table(spark, d, "orders").select(F.when(s == "F", "COMPLIANT").when(s == "O", "NON_COMPLIANT").otherwise("NEEDS_REVIEW").alias("overall_status"), F.when(s == "O", 1).otherwise(0).alias("violation_count"))
    return st.live_kpis(o)


def _streamed(spark, d, shape, make, mode):
    """Run a stream over the events to their end and read what it wrote; files and checkpoint lie in the shared folder.

    The path is a pattern, which a stream takes whether the table is a file or a folder.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    st.run_available(make(shape(source.withColumn("ts", F.col("ts").cast("timestamp")))), write, f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("late_panel_sessions", "ST1", """
with p as (select cast(user_id as varchar) as session_id, cast(event_id as varchar) as image_id, ts, case event_type when 'click' then 'FRONT' else upper(event_type) end as panel from events)
select session_id, count(*) as panels, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, arg_min(panel, strftime(ts, '%Y%m%d%H%M%S.%f') || image_id) as first_panel,
  arg_max(panel, strftime(ts, '%Y%m%d%H%M%S.%f') || image_id) as last_panel, count(*) filter (panel = 'FRONT') as front_panels from p group by 1""")
def late_panel_sessions(spark, d):
    shape = lambda e: e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("image_id"), "ts", F.when(F.col("event_type") == "click", "FRONT").otherwise(F.upper("event_type")).alias("panel"))
    versions = _streamed(spark, d, shape, sf.late_panels, "update")
    last = versions.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in versions.columns if c not in ("session_id", "version", "status")]), F.col("version")).alias("s")).select("session_id", "s.*")
    for c in ("first_seen", "last_seen"):
        last = last.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return last


@query("streamed_transitions", "ST2", f"""
with s as (select *, ({q.array(st.STATES)})[1 + event_id % 15] as state from events), p as (select *, coalesce(lag(state) over (partition by user_id order by ts, event_id), 'CREATED') as from_state from s)
select cast(user_id as varchar) as scan_id, event_id, from_state, state, from_state = state or list_contains({_LEGAL}, from_state || '>' || state) as legal from p where epoch_ms(ts) < (select epoch_ms(max(ts)) - 60000 from events)""")
def streamed_transitions(spark, d):
    """The changes that the watermark, one minute behind the last event, has passed."""
    states = F.array(*[F.lit(s) for s in st.STATES])
    shape = lambda e: e.select(F.col("user_id").alias("scan_id"), "event_id", "ts", F.element_at(states, (1 + F.col("event_id") % 15).cast("int")).alias("state"))
    return _streamed(spark, d, shape, lambda e: sf.stage_changes(e, "1 minute"), "append").select("scan_id", "event_id", "from_state", "state", "legal")
