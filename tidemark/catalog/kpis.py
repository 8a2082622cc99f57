"""KPI: dashboard figures over jobs, rows, users, events and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import COMMENTS, JOBS, USERS, comments, job_rows, jobs, users
from tidemark.operators import kpi as ops

catalog = Catalog()
query = catalog.query


@query("kpi1_canonical_status", f"WITH {JOBS} SELECT id, cstatus AS canonical_status FROM staged")
def _(t: Tables):
    return ops.with_status(jobs(t)).select("id", "canonical_status")


@query("kpi2_status_counts", f"WITH {JOBS} SELECT cstatus AS status, count(*) AS n FROM staged GROUP BY 1")
def _(t: Tables):
    return ops.status_counts(jobs(t))


def _n(status: str) -> str:
    return f"count(*) FILTER (cstatus = '{status}')"


TREND = ", ".join(f"{_n(s)} AS {s}" for s in ops.TREND_STATUSES if s != "failed")


@query(
    "kpi2_totals",
    f"""WITH {JOBS} SELECT count(*) AS uploads, {TREND}, {_n('failed')} + {_n('callback_failed')} AS failed,
  {_n('queued')} + {_n('planning')} AS pending, round_even(100.0::DOUBLE * {_n('succeeded')} / count(*), 1) AS completion_rate FROM staged""",
)
def _(t: Tables):
    return ops.totals(jobs(t))


@query(
    "kpi3_daily_trend",
    f"""WITH {JOBS} SELECT CAST(uploaded_at AS DATE) AS day, cstatus AS status, count(DISTINCT id) AS uploads, count(l_orderkey) AS records
  FROM staged LEFT JOIN lineitem ON l_orderkey = id GROUP BY 1, 2""",
)
def _(t: Tables):
    return ops.daily(jobs(t), job_rows(t)).withColumn("records", F.col("records").cast("bigint"))


def _pivot_sql(limit: str) -> str:
    statuses = ", ".join(f"CAST(coalesce(sum(uploads) FILTER (status = '{s}'), 0) AS BIGINT) AS {s}" for s in ops.TREND_STATUSES if s != "failed")
    return f"""WITH {JOBS}, d AS (SELECT CAST(uploaded_at AS DATE) AS day, cstatus AS status, count(DISTINCT id) AS uploads, count(l_orderkey) AS records
    FROM staged LEFT JOIN lineitem ON l_orderkey = id GROUP BY 1, 2)
  SELECT day, CAST(sum(uploads) AS BIGINT) AS uploads, {statuses},
    CAST(coalesce(sum(uploads) FILTER (status IN ('failed', 'callback_failed')), 0) AS BIGINT) AS failed,
    CAST(coalesce(sum(uploads) FILTER (status IN ('queued', 'planning')), 0) AS BIGINT) AS pending,
    CAST(sum(records) AS BIGINT) AS records FROM d GROUP BY day ORDER BY day {limit}"""


@query("kpi4_trend_pivot", _pivot_sql(""))
def _(t: Tables):
    return ops.daily_pivot(ops.daily(jobs(t), job_rows(t)), None)


@query("kpi4_trend_report", _pivot_sql("LIMIT 90"))
def _(t: Tables):
    return ops.daily_pivot(ops.daily(jobs(t), job_rows(t)), 90)


@query(
    "kpi5_average_seconds",
    f"WITH {JOBS} SELECT round(avg(epoch(completed_at - uploaded_at)), 4) AS average_review_seconds FROM jobs WHERE completed_at IS NOT NULL",
)
def _(t: Tables):
    return ops.average_seconds(jobs(t)).withColumn("average_review_seconds", F.round("average_review_seconds", 4))


@query("kpi6_formats", f"WITH {JOBS} SELECT coalesce(output_format, 'Unknown') AS output_format, count(*) AS n FROM jobs GROUP BY 1")
def _(t: Tables):
    return ops.formats(jobs(t))


@query(
    "kpi7_latest_rows",
    f"""WITH {JOBS} SELECT l_orderkey AS submission_id, l_linenumber AS record_index FROM lineitem
  WHERE l_orderkey = (SELECT id FROM jobs WHERE id IN (SELECT l_orderkey FROM lineitem) ORDER BY uploaded_at DESC, id DESC LIMIT 1)
  ORDER BY l_linenumber LIMIT 10""",
)
def _(t: Tables):
    stored = jobs(t).join(t.lineitem, F.col("l_orderkey") == F.col("id"), "left_semi")
    return ops.latest_rows(stored, job_rows(t)).select("submission_id", "record_index")


@query(
    "kpi8_planner_facts",
    f"""WITH {JOBS}, p AS (SELECT id, coalesce(completed_at, uploaded_at) AS planned FROM jobs WHERE contains(summary, 'Orchestrator'))
  SELECT count(*) AS total_runs, max(planned) AS last_run_at, 'Plan ' || arg_max(id, (planned, id)) AS latest_summary FROM p""",
)
def _(t: Tables):
    return ops.planner_facts(jobs(t))


@query(
    "kpi8_recent_planner_runs",
    f"""WITH {JOBS} SELECT id AS upload_id, file_name AS filename, 'Plan ' || id AS plan_summary, coalesce(completed_at, uploaded_at) AS planned_at
  FROM jobs WHERE contains(summary, 'Orchestrator') ORDER BY completed_at DESC NULLS FIRST, uploaded_at DESC, id DESC LIMIT 5""",
)
def _(t: Tables):
    return ops.recent_planner_runs(jobs(t), 5)


@query(
    "kpi9_failure_reasons",
    f"""WITH {JOBS}, {COMMENTS}, c AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, message DESC) AS rn FROM comments)
  SELECT id AS upload_id, file_name AS filename, status, message AS reason, created_at FROM jobs JOIN c ON submission_id = id AND rn = 1
  WHERE status IN ('failed', 'callback_failed', 'declined') ORDER BY uploaded_at DESC, id DESC LIMIT 5""",
)
def _(t: Tables):
    return ops.failure_reasons(jobs(t), comments(t), 5)


_LIST = f"""WITH {JOBS} SELECT id, status, uploaded_at, greatest(coalesce(n, 0), CASE WHEN o_orderpriority LIKE '%I%' THEN user_id % 12 ELSE 0 END, id % 9) AS total_rows
  FROM jobs JOIN orders ON o_orderkey = id LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = id"""


def _profiles(t: Tables):
    return t.orders.filter("o_orderpriority like '%I%'").selectExpr("o_orderkey as submission_id", "o_custkey % 12 as row_count")


@query("kpi10_job_rows", _LIST)
def _(t: Tables):
    return ops.job_list(jobs(t), job_rows(t), _profiles(t), None)


@query("kpi10_job_list", _LIST + " ORDER BY uploaded_at DESC, id DESC LIMIT 100")
def _(t: Tables):
    return ops.job_list(jobs(t), job_rows(t), _profiles(t), 100)


@query(
    "kpi11_quarantined",
    f"""WITH {JOBS} SELECT id, uploaded_at FROM jobs WHERE status IN ('quarantined', 'queued')
  AND json_extract_string(summary, '$.status') IN ('pending_agent_availability', 'rejected')""",
)
def _(t: Tables):
    return ops.quarantined(jobs(t)).select("id", "uploaded_at")


@query(
    "kpi12_timeline",
    f"""WITH {JOBS}, {COMMENTS} SELECT id, uploaded_at AS occurred_at, 'upload created' AS action, file_name AS detail FROM staged
  UNION ALL SELECT id, dispatched_at, 'agent dispatched', 'Workflow dispatched to the agent queue.' FROM staged WHERE dispatched_at IS NOT NULL
  UNION ALL SELECT id, completed_at, 'workflow completed', 'The workflow finished successfully.' FROM staged WHERE completed_at IS NOT NULL AND cstatus = 'succeeded'
  UNION ALL SELECT id, completed_at, 'workflow failed', CASE WHEN id % 6 = 0 THEN 'Bad column' ELSE 'Agent execution failed.' END FROM staged
    WHERE completed_at IS NOT NULL AND cstatus IN ('failed', 'callback_failed')
  UNION ALL SELECT id, created_at, CASE WHEN position('7' IN message) > 0 THEN 'upload approved' ELSE 'note added' END, message FROM comments JOIN staged ON id = submission_id
    WHERE NOT (position('7' IN message) > 0 AND completed_at IS NOT NULL)""",
)
def _(t: Tables):
    action = F.when(F.instr("message", "7") > 0, "upload_approved").otherwise("note_added")
    audit = comments(t).select("submission_id", "created_at", action.alias("action"), F.col("message").alias("detail"))
    return ops.timeline(jobs(t), audit)


_MINUTES = "greatest(floor(epoch(completed_at - uploaded_at) / 60.0 + 0.5), 0)"


@query(
    "kpi13_completion_minutes",
    f"WITH {JOBS} SELECT CAST(floor(avg({_MINUTES}) + 0.5) AS BIGINT) AS minutes FROM staged WHERE cstatus = 'succeeded' AND completed_at IS NOT NULL",
)
def _(t: Tables):
    return ops.completion_minutes(jobs(t))


@query(
    "kpi14_seven_day_trend",
    f"""WITH {JOBS}, m AS (SELECT CAST(completed_at AS DATE) AS day, CAST(floor(avg({_MINUTES}) + 0.5) AS BIGINT) AS minutes FROM staged
    WHERE cstatus = 'succeeded' AND completed_at IS NOT NULL GROUP BY 1)
  SELECT CAST(d AS DATE) AS day, coalesce(minutes, 0) AS minutes FROM range(DATE '2001-07-29', DATE '2001-08-05', INTERVAL 1 DAY) r(d) LEFT JOIN m ON day = CAST(d AS DATE)""",
)
def _(t: Tables):
    return ops.completion_trend(jobs(t), "2001-08-04")


_WORK = f"""WITH {JOBS} SELECT coalesce(c_name, 'Unknown owner') AS name, count(*) AS jobs, count(*) FILTER (cstatus = 'succeeded') AS completed,
  max(uploaded_at) AS latest_submitted_at, CAST(floor(100.0::DOUBLE * count(*) FILTER (cstatus = 'succeeded') / count(*) + 0.5) AS BIGINT) || '%' AS success_rate
  FROM staged LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0 GROUP BY 1"""


def _owned(t: Tables):
    from tidemark.operators.tables import lookup

    return lookup(jobs(t), t.customer.filter("c_acctbal > 0"), "user_id", "c_custkey", {"c_name": "owner"})


@query("kpi15_workload", _WORK)
def _(t: Tables):
    return ops.workload(_owned(t), n=None)


@query("kpi15_busiest_owners", _WORK + " ORDER BY jobs DESC, name LIMIT 6")
def _(t: Tables):
    return ops.workload(_owned(t), n=6)


@query(
    "kpi16_periods",
    f"""WITH {JOBS} SELECT count(*) FILTER (CAST(uploaded_at AS DATE) >= DATE '2001-07-25') AS today,
  count(*) FILTER (CAST(uploaded_at AS DATE) >= DATE '2001-07-19') AS last_7_days,
  count(*) FILTER (CAST(uploaded_at AS DATE) >= DATE '2001-07-01') AS month_to_date FROM jobs""",
)
def _(t: Tables):
    return ops.period_counts(jobs(t), "2001-07-25")


@query(
    "kpi17_assignment",
    f"""WITH {USERS} SELECT count(*) FILTER (manager_id IS NOT NULL) AS assigned, count(*) FILTER (manager_id IS NULL) AS unassigned
  FROM users WHERE role = 'employee'""",
)
def _(t: Tables):
    return ops.assignment(users(t))


def _agents(t: Tables):
    return t.supplier.selectExpr(
        "s_name as name", "s_suppkey % 50 as total_invocations",
        "element_at(array('active', 'idle', 'degraded', 'retired'), cast(s_suppkey % 4 as int) + 1) as status",
    )


AGENTS = "agents AS (SELECT s_name AS name, s_suppkey % 50 AS total_invocations, ['active', 'idle', 'degraded', 'retired'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS status FROM supplier)"


@query(
    "kpi18_fleet",
    f"""WITH {AGENTS} SELECT count(*) AS agents, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'degraded') AS degraded,
  CAST(sum(total_invocations) AS BIGINT) AS total_invocations FROM agents""",
)
def _(t: Tables):
    return ops.fleet(_agents(t))


@query("kpi18_watchlist", f"WITH {AGENTS} SELECT * FROM agents")
def _(t: Tables):
    return ops.fleet_watchlist(_agents(t))


@query("kpi19_event_counters", "SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    return ops.event_counters(t.events, "event_type")


@query(
    "kpi20_agreement",
    """SELECT count(*) AS comparisons, count(*) FILTER (toxic IS NOT NULL AND (n_chars > 1000) = (toxic = 1)) AS agree,
  count(*) FILTER (toxic IS NULL) AS unavailable, count(*) FILTER (toxic IS NOT NULL AND (n_chars > 1000) = (toxic = 1)) / count(*)::DOUBLE AS agreement_rate
  FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t: Tables):
    checks = t.documents.join(t.labels, "doc_id", "left").select(
        (F.col("n_chars") > 1000).alias("first"), (F.col("toxic") == 1).alias("second")
    )
    return ops.agreement(checks)


def _calls(t: Tables):
    """Events as a call log: every event opens an attempt, and most end it some seconds later."""
    kind = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    started = t.events.select(
        F.col("event_id").alias("physical_attempt_id"), F.lit("started").alias("event"), F.col("event_type").alias("operation"),
        "ts", F.lit(None).cast("bigint").alias("total_tokens"), F.lit(None).cast("string").alias("error_type"),
    )
    ended = t.events.filter("value > 5").select(
        F.col("event_id").alias("physical_attempt_id"), kind.alias("event"), F.lit(None).cast("string").alias("operation"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(event_id % 60 as int))").alias("ts"),
        F.when(kind == "completed", F.col("user_id") * 10).alias("total_tokens"),
        F.when(kind == "failed", F.lit("timeout")).alias("error_type"),
    )
    return started.unionByName(ended)


@query(
    "kpi21_calls",
    """SELECT event_id AS physical_attempt_id, event_type AS operation, CASE WHEN value <= 5 THEN NULL WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS outcome,
  CASE WHEN value > 5 AND event_type <> 'error' THEN user_id * 10 END AS total_tokens, CASE WHEN value > 5 AND event_type = 'error' THEN 'timeout' END AS error_type,
  CASE WHEN value > 5 THEN (event_id % 60) * 1000.0::DOUBLE END AS duration_ms FROM events""",
)
def _(t: Tables):
    return ops.calls(_calls(t)).drop("started_at", "ended_at")


@query(
    "kpi21_call_stats",
    """SELECT event_type AS operation, count(*) AS attempts, count(*) FILTER (value > 5 AND event_type <> 'error') AS completed,
  count(*) FILTER (value > 5 AND event_type = 'error') AS failed, count(*) FILTER (value <= 5) AS open,
  CAST(coalesce(sum(user_id * 10) FILTER (value > 5 AND event_type <> 'error'), 0) AS BIGINT) AS total_tokens,
  round(avg((event_id % 60) * 1000.0) FILTER (value > 5), 4) AS mean_ms FROM events GROUP BY 1""",
)
def _(t: Tables):
    return ops.call_stats(_calls(t)).drop("p50_p95_ms").withColumn("mean_ms", F.round("mean_ms", 4))


@query(
    "kpi22_run_status",
    """SELECT l_orderkey AS run_id, CASE WHEN bool_or(l_linenumber <= 5 AND l_returnflag = 'R' AND l_discount > 0.07) THEN 'failed'
  WHEN bool_or(l_linenumber > 5 AND l_returnflag = 'A') THEN 'completed_with_warnings' ELSE 'complete' END AS job_status,
  count(*) FILTER (l_linenumber > 5 AND l_returnflag = 'A') AS failed_charts FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    steps = t.lineitem.selectExpr(
        "l_orderkey as run_id",
        "case when l_linenumber <= 5 then 'calc' else 'chart' end as kind",
        """case when l_linenumber <= 5 and l_returnflag = 'R' and l_discount > 0.07 then if(l_tax > 0.04, 'failed', 'partial')
           when l_linenumber > 5 and l_returnflag = 'A' then 'failed' else 'succeeded' end as status""",
    )
    return ops.run_status(steps)


_PAUSED = "(cstatus = 'quarantined')"


@query(
    "kpi23_job_steps",
    f"""WITH {JOBS}, s AS (SELECT id, unnest([1, 2, 3, 4]) AS step, cstatus, dispatched_at IS NOT NULL AS sent, {_PAUSED} AS paused FROM staged)
  SELECT id, step, ['Ingestion', 'Workflow routing', 'Agent execution', 'Output preparation'][step] AS name, CASE step WHEN 1 THEN 'complete'
   WHEN 2 THEN CASE WHEN NOT paused AND cstatus = 'queued' THEN 'running' WHEN sent THEN 'complete' ELSE 'running' END
   WHEN 3 THEN CASE WHEN paused THEN 'blocked' WHEN cstatus = 'succeeded' THEN 'complete' WHEN cstatus IN ('failed', 'callback_failed') THEN 'failed' ELSE 'running' END
   ELSE CASE WHEN paused OR cstatus IN ('failed', 'callback_failed') THEN 'blocked' WHEN cstatus = 'succeeded' THEN 'complete' ELSE 'running' END END AS state FROM s""",
)
def _(t: Tables):
    return ops.job_steps(jobs(t))


@query(
    "kpi24_message_stats",
    """SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER (role = 'system'), 0) AS BIGINT) AS system_characters,
  CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS user_characters, count(*) AS message_count,
  count(*) OVER (PARTITION BY string_agg(turn || ':' || role || ':' || text, chr(1) ORDER BY turn, role, text)) AS same_content
  FROM conversations GROUP BY conv_id""",
)
def _(t: Tables):
    stats = ops.message_stats(t.conversations)
    same = stats.groupBy("content_hash").agg(F.count(F.lit(1)).alias("same_content"))
    return stats.join(same, "content_hash").drop("content_hash")
