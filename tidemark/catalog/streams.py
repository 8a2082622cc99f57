"""STR: the stream operators, run on the data available now."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import jobs
from tidemark.catalog.kpis import catalog as kpis
from tidemark.operators import kpi
from tidemark.session import scratch_path
from tidemark.streaming import ingest, keyed, live, state

catalog = Catalog()
query = catalog.query
TREND_SQL = kpis.sql["kpi3_daily_trend"]


def _stream(t: Tables, name: str):
    """A given table as a stream: its file, or the files of its folder."""
    return ingest.read_parquet(t.spark, f"{t.folder}/{name}*.parquet")


@query("str1_once", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(t: Tables):
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    replayed = _stream(t, "events").select(*columns).unionByName(_stream(t, "events").select(*columns))
    return ingest.to_table(ingest.once(replayed, "event_id"), "once")


@query(
    "str1_event_id",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'given-' || event_id ELSE 'callback:' || user_id || ':' || sha256('[{"key":"event","value":"' || event_type || '"},{"key":"props","value":"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"}]') END AS id FROM events""",
)
def _(t: Tables):
    given = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("given-"), "event_id")).otherwise(F.lit(" "))
    payload = F.create_map(F.lit("props"), F.col("props"), F.lit("event"), F.col("event_type"))
    events = _stream(t, "events").select("event_id", ingest.event_id(given, F.col("user_id"), payload).alias("id"))
    return ingest.to_table(events, "event-id")


@query(
    "str2_latest_state",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k FROM events GROUP BY 1""",
)
def _(t: Tables):
    from tidemark.functions.jsons import as_map

    state_of = keyed.latest_fields(_stream(t, "events"), "user_id", "ts", "event_id", F.col("event_type"), as_map(F.col("props")))
    return state_of.select("user_id", F.col("state")["status"].alias("status"), F.col("state")["k"].alias("k"))


@query(
    "str2_merged_state",
    """SELECT user_id, 'intent_id=kept' || chr(10) || 'k=' || arg_max(json_extract_string(props, '$.k'), (ts, event_id)) || chr(10) || 'status=' || arg_max(event_type, (ts, event_id)) AS summary
  FROM events GROUP BY 1""",
)
def _(t: Tables):
    from tidemark.functions.jsons import as_map, stable_text

    payload = F.map_concat(as_map(F.col("props")), F.create_map(F.lit("intent_id"), F.lit("overwritten")))
    state_of = keyed.latest_fields(_stream(t, "events"), "user_id", "ts", "event_id", F.col("event_type"), payload)
    stored = t.events.select("user_id").distinct().withColumn(
        "summary", F.create_map(F.lit("intent_id"), F.lit("kept"), F.lit("status"), F.lit("old"))
    )
    return keyed.merged_state(state_of, stored, "user_id").select("user_id", stable_text(F.col("summary")).alias("summary"))


@query(
    "str3_route",
    """SELECT 'review' AS target, event_id FROM events WHERE event_type = 'signup' UNION ALL SELECT 'dead', event_id FROM events WHERE event_type = 'error'""",
)
def _(t: Tables):
    review, dead = scratch_path(t.spark, "review"), scratch_path(t.spark, "dead")
    status = F.when(F.col("event_type") == "signup", "quarantined").when(F.col("event_type") == "error", "failed").otherwise("done")
    events = _stream(t, "events").withColumn("status", status).select("event_id", "status")
    writer = events.writeStream.option("checkpointLocation", scratch_path(t.spark, "route-checkpoint")).foreachBatch(
        lambda batch, batch_id: state.route(batch, batch_id, review, dead, "event_id", "status")
    )
    ingest.run(writer)
    read = lambda path, name: t.spark.read.parquet(path).select(F.lit(name).alias("target"), "event_id")
    return read(review, "review").unionByName(read(dead, "dead"))


SESSIONS = """s AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS session_id, min(ts) AS opened_at, min(ts) FILTER (event_type = 'purchase') AS answered_at
  FROM events GROUP BY 1),
  e AS (SELECT session_id, opened_at, coalesce(answered_at <= opened_at + INTERVAL 30 MINUTE, false) AS ok, answered_at, opened_at + INTERVAL 30 MINUTE AS deadline FROM s)
  SELECT session_id, opened_at, CASE WHEN ok THEN answered_at ELSE deadline END AS ended_at, CASE WHEN ok THEN 'resolved' ELSE 'quarantined' END AS outcome,
  CASE WHEN NOT ok THEN 'Clarification session timed out' END AS reason FROM e"""


def _session_events(df):
    key = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMddHH"))
    return df.select(key.alias("session_id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("answer"))


@query("str4_sessions", f"WITH {SESSIONS}")
def _(t: Tables):
    return state.sessions(_session_events(t.events))


@query(
    "str4_session_timeouts",
    f"WITH {SESSIONS} WHERE deadline <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
)
def _(t: Tables):
    return ingest.to_table(keyed.session_timeouts(_session_events(_stream(t, "events")), packs=keyed.PACKS), "sessions")


@query("str5_live_daily", TREND_SQL)
def _(t: Tables):
    """Every job arrives queued, a day early, then with its own day and status; records arrive beside."""
    found = kpi.with_status(jobs(SimpleNamespace(orders=_stream(t, "orders"))))
    event = lambda seq, day, status: found.select("id", F.col("uploaded_at").alias("at"), F.lit(seq).alias("seq"), day.alias("day"), status.alias("status"))
    day = F.to_date("uploaded_at")
    events = event(0, F.date_sub(day, 1), F.lit("queued")).unionByName(event(1, day, F.col("canonical_status")))
    records = _stream(t, "lineitem").select(F.col("l_orderkey").alias("id"))
    return live.live_daily(events, records).current()


@query(
    "str6_live_alerts",
    """SELECT user_id, event_type AS alert_type, max(ts) AS created_at, false AS is_read, arg_max(value, (ts, event_id)) AS difference FROM events GROUP BY ALL""",
)
def _(t: Tables):
    alerts = _stream(t, "events").select(
        "user_id", F.col("event_type").alias("alert_type"), F.col("ts").alias("created_at"), "event_id",
        F.col("value").alias("difference"), F.lit(False).alias("is_read"),
    )
    return keyed.newest_rows(alerts, ["user_id", "alert_type"], "created_at", "event_id").drop("event_id")


STREAM_OPS = [
    {"type": "trim_whitespace", "columns": ["event_type"]},
    {"type": "normalize_text_case", "columns": ["event_type"], "case": "upper"},
    {"type": "filter", "conditions": [{"column": "value", "operator": "gt", "value": 20}, {"column": "event_type", "operator": "neq", "value": "error"}]},
]


@query(
    "str7_stream_clean",
    """SELECT event_id, upper(event_type) AS event_type, value, CASE WHEN value > 50 THEN 'value:numeric_range' ELSE '' END AS errors FROM events
  WHERE value > 20 AND event_type <> 'error'""",
)
def _(t: Tables):
    cleaned = live.clean(_stream(t, "events"), STREAM_OPS)
    flagged = live.flag(cleaned, [{"column": "value", "rule": "numeric_range", "max_value": 50}])
    shown = flagged.select("event_id", "event_type", "value", F.array_join("errors", "|").alias("errors"))
    return ingest.to_table(shown, "clean")


@query(
    "str8_late_events",
    """SELECT count(*) FILTER (ts >= newest - INTERVAL 7 DAY) AS kept, count(*) FILTER (ts < newest - INTERVAL 7 DAY) AS dropped
  FROM events, (SELECT max(ts) AS newest FROM events)""",
)
def _(t: Tables):
    """Events in a second wave that is older than the watermark are dropped and counted."""
    path = scratch_path(t.spark, "late")
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    newest = events.agg(F.max("ts")).scalar()
    old = F.col("ts") < newest - F.make_dt_interval(days=F.lit(7))
    events.filter(~old).write.parquet(f"{path}/wave=1")
    checkpoint, out = scratch_path(t.spark, "late-checkpoint"), scratch_path(t.spark, "late-out")

    def wave():
        stream = t.spark.readStream.schema(events.schema).parquet(f"{path}/wave=*")
        return ingest.run(
            ingest.once_within(stream, "event_id", "ts", "1 hour").writeStream.format("parquet").option("checkpointLocation", checkpoint), out
        )

    wave()
    events.filter(old).write.parquet(f"{path}/wave=2")
    dropped = ingest.dropped_late(wave())
    kept = t.spark.read.schema(events.schema).parquet(out)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.lit(dropped).cast("bigint").alias("dropped"))
