"""Operational KPIs over jobs (submissions), their rows, comments, users, events and logs.

Jobs: ``id, user_id, file_name, output_format, status, summary (JSON), uploaded_at, dispatched_at,
completed_at``. Rows: ``submission_id, record_index``. Comments: ``submission_id, message,
created_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, jsons, numbers
from tidemark.operators import ordered, tables

# Status names, old names and their present ones, and groups of them.
STATUSES = (
    "queued", "planning", "running", "succeeded", "failed", "quarantined", "callback_failed",
    "awaiting_schema_approval", "awaiting_confirmation", "declined", "awaiting_clarification",
)
STATUS_ALIASES = {
    "pending": "queued",
    "processing": "running",
    "complete": "succeeded",
    "success": "succeeded",
    "partial": "failed",
    "rejected": "quarantined",
}
TREND_STATUSES = STATUSES[:-1]
WAITING = ("pending", "queued", "quarantined")
WAITING_PAYLOAD = ("pending_agent_availability", "rejected")
FAILED = ("failed", "callback_failed")
NOT_DELIVERED = (*FAILED, "declined")


def canonical_status(status: Column, summary: Column) -> Column:
    """Present status name; waiting jobs whose summary waits or is rejected are quarantined."""
    out = status
    for old, new in STATUS_ALIASES.items():
        out = F.when(status == old, new).otherwise(out)
    waiting = status.isin(*WAITING) & jsons.field(summary, "status").isin(*WAITING_PAYLOAD)
    return F.when(waiting, "quarantined").otherwise(out)


def with_status(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("canonical_status", canonical_status(F.col("status"), F.col("summary")))


def status_counts(jobs: DataFrame) -> DataFrame:
    return with_status(jobs).groupBy(F.col("canonical_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def totals(jobs: DataFrame) -> DataFrame:
    """One row: jobs per status, the combined buckets, and the completion rate in percent."""
    s = F.col("canonical_status")
    agg = with_status(jobs).agg(
        F.count(F.lit(1)).alias("uploads"), *[F.count_if(s == name).alias(name) for name in TREND_STATUSES]
    )
    return agg.select(
        "uploads",
        *[n for n in TREND_STATUSES if n != "failed"],
        (F.col("failed") + F.col("callback_failed")).alias("failed"),
        (F.col("queued") + F.col("planning")).alias("pending"),
        F.coalesce(numbers.percent(F.col("succeeded"), F.col("uploads"), 1), F.lit(0.0)).alias("completion_rate"),
    )


def daily(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs and stored rows per day and status.

    Rows are counted per job before the join, so the join has one row per job and the number of jobs
    is a plain count instead of a distinct count over multiplied rows.
    """
    counted = tables.with_child_count(
        with_status(jobs).select("id", "uploaded_at", "canonical_status"), rows, "id", "submission_id", "__rows"
    )
    return counted.groupBy(
        F.to_date("uploaded_at").alias("day"), F.col("canonical_status").alias("status")
    ).agg(F.count(F.lit(1)).alias("uploads"), F.sum("__rows").alias("records"))


def daily_pivot(by_status: DataFrame, max_days: int | None = None) -> DataFrame:
    """One row per day with a column per status; ``by_status`` is the result of ``daily``.

    A report that shows the first days only asks for ``max_days``.
    """
    count = lambda name: F.coalesce(F.sum(F.when(F.col("status") == name, F.col("uploads"))), F.lit(0))
    out = by_status.groupBy("day").agg(
        F.sum("uploads").alias("uploads"),
        *[count(n).alias(n) for n in TREND_STATUSES if n != "failed"],
        (count("failed") + count("callback_failed")).alias("failed"),
        (count("queued") + count("planning")).alias("pending"),
        F.sum("records").alias("records"),
    ).orderBy("day")
    return out.limit(max_days) if max_days else out


def average_seconds(jobs: DataFrame) -> DataFrame:
    """Mean seconds from upload to completion of completed jobs; 0 when there are none."""
    took = dates.seconds_between(F.col("completed_at"), F.col("uploaded_at"))
    return jobs.agg(F.coalesce(F.avg(took), F.lit(0.0)).alias("average_review_seconds"))


def formats(jobs: DataFrame) -> DataFrame:
    """Jobs per output format, largest first; no format is ``Unknown``."""
    name = F.when(F.coalesce("output_format", F.lit("")) == "", "Unknown").otherwise(F.col("output_format"))
    return jobs.groupBy(name.alias("output_format")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "output_format")


def latest_rows(jobs: DataFrame, rows: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows of the newest job: a top-1 joined to the rows."""
    latest = tables.newest(jobs, [F.desc("uploaded_at"), F.desc("id")], 1).select(F.col("id").alias("submission_id"))
    return rows.join(F.broadcast(latest), "submission_id", "left_semi").orderBy("record_index").limit(n)


def planner_runs(jobs: DataFrame, agent: str = "orchestrator") -> DataFrame:
    """Jobs with a summary of the planning agent."""
    return (
        jobs.withColumn("plan_summary", jsons.agent_summary(F.col("summary"), agent))
        .filter("plan_summary <> ''")
        .withColumn("planned_at", F.coalesce("completed_at", "uploaded_at"))
    )


def planner_facts(jobs: DataFrame, agent: str = "orchestrator") -> DataFrame:
    """One row: number of planner runs, the newest time and its summary."""
    return planner_runs(jobs, agent).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.max("planned_at").alias("last_run_at"),
        F.max_by("plan_summary", F.struct("planned_at", "id")).alias("latest_summary"),
    )


def recent_planner_runs(jobs: DataFrame, n: int | None = None) -> DataFrame:
    order = [F.col("completed_at").desc_nulls_first(), F.desc("uploaded_at"), F.desc("id")]
    ordered = planner_runs(jobs).orderBy(*order)
    return (ordered.limit(n) if n else ordered).select(
        F.col("id").alias("upload_id"), F.col("file_name").alias("filename"), "plan_summary", "planned_at"
    )


def failure_reasons(jobs: DataFrame, comments: DataFrame, n: int | None = None) -> DataFrame:
    """Newest failed jobs that have a comment, each with its newest comment."""
    failed = jobs.filter(F.col("status").isin(*NOT_DELIVERED))
    with_comment = tables.with_first_child(
        failed, comments, "id", "submission_id", [F.desc("created_at"), F.desc("message")], ["message", "created_at"]
    )
    ordered = with_comment.orderBy(F.desc("uploaded_at"), F.desc("id"))
    return (ordered.limit(n) if n else ordered).select(
        F.col("id").alias("upload_id"), F.col("file_name").alias("filename"), "status",
        F.col("message").alias("reason"), "created_at",
    )


def job_list(jobs: DataFrame, rows: DataFrame, profiles: DataFrame, n: int | None = None) -> DataFrame:
    """Newest jobs with the largest of stored, profiled (``submission_id, row_count``) and reported
    row counts."""
    out = tables.with_child_count(jobs, rows, "id", "submission_id", "stored")
    out = tables.lookup(out, profiles, "id", "submission_id", {"row_count": "profiled"})
    reported = F.coalesce(jsons.field(F.col("summary"), "record_count").try_cast("bigint"), F.lit(0))
    total = F.greatest("stored", F.coalesce("profiled", F.lit(0)), reported).cast("bigint")
    listed = out.select("id", "status", "uploaded_at", total.alias("total_rows"))
    return tables.newest(listed, [F.desc("uploaded_at"), F.desc("id")], n) if n else listed


def quarantined(jobs: DataFrame) -> DataFrame:
    """Jobs waiting for review, newest first."""
    waits = F.col("status").isin("quarantined", "queued") & jsons.field(F.col("summary"), "status").isin(*WAITING_PAYLOAD)
    return jobs.filter(waits).orderBy(F.desc("uploaded_at"), F.desc("id"))


def timeline(jobs: DataFrame, audit: DataFrame) -> DataFrame:
    """Events of every job: created, dispatched, outcome, and audit entries (``submission_id,
    created_at, action, detail``) that do not repeat these."""
    s = with_status(jobs)
    status = F.col("canonical_status")
    error = jsons.field(F.col("summary"), "error")
    event = lambda at, action, detail: F.struct(
        at.alias("occurred_at"), F.lit(action).alias("action"), detail.alias("detail")
    )
    done = F.col("completed_at").isNotNull()
    # The names and sentences of the events.
    events = F.array(
        event(F.col("uploaded_at"), "upload created", F.col("file_name")),
        F.when(
            F.col("dispatched_at").isNotNull(),
            event(F.col("dispatched_at"), "agent dispatched", F.lit("Workflow dispatched to the agent queue.")),
        ),
        F.when(done & (status == "succeeded"), event(F.col("completed_at"), "workflow completed", F.lit("The workflow finished successfully."))),
        F.when(
            done & status.isin(*FAILED),
            event(F.col("completed_at"), "workflow failed", F.when(error != "", error).otherwise("Agent execution failed.")),
        ),
        F.when(
            done & (status == "quarantined"),
            event(
                F.col("completed_at"), "workflow quarantined",
                F.when(error != "", error).otherwise("Part of the workflow is quarantined pending review."),
            ),
        ),
    )
    own = s.select("id", F.inline(F.filter(events, lambda e: e.isNotNull())))
    action = F.translate(F.col("action"), "_", " ")
    a = audit.withColumn("action", action).join(
        jobs.select("id", "file_name", "completed_at"), F.col("submission_id") == F.col("id")
    )
    detail = F.coalesce("detail", "file_name")
    repeats = ((F.col("action") == "upload created") & (detail.isin("workflow_created") | (detail == F.col("file_name")))) | (
        F.col("action").isin("upload approved", "upload declined") & F.col("completed_at").isNotNull()
    )
    logged = a.filter(~F.coalesce(repeats, F.lit(False))).select("id", F.col("created_at").alias("occurred_at"), "action", detail.alias("detail"))
    return own.unionByName(logged)


def completion_minutes(jobs: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Mean whole minutes from submission to completion of succeeded jobs, never below 0."""
    done = with_status(jobs).filter("canonical_status = 'succeeded' and completed_at is not null and uploaded_at is not null")
    minutes = dates.seconds_between(F.col("completed_at"), F.col("uploaded_at")) / 60
    each = F.greatest(F.floor(minutes + 0.5), F.lit(0))
    mean = F.floor(F.avg(each) + 0.5)
    value = F.coalesce(mean, F.lit(0)).cast("bigint").alias("minutes")
    return done.groupBy(*by).agg(value) if by else done.agg(value)


def completion_trend(jobs: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Mean minutes per completion day over the last days; days without jobs are 0."""
    last = F.to_date(F.lit(today))
    calendar = jobs.sparkSession.range(days).select(F.date_sub(last, F.lit(days - 1) - F.col("id").cast("int")).alias("day"))
    first = F.date_sub(last, days - 1)
    recent = jobs.filter((F.to_date("completed_at") >= first) & (F.to_date("completed_at") <= last))
    by_day = completion_minutes(recent, [F.to_date("completed_at").alias("day")])
    return calendar.join(F.broadcast(by_day), "day", "left").select("day", F.coalesce("minutes", F.lit(0)).alias("minutes"))


def workload(jobs: DataFrame, owner: str = "owner", n: int | None = None) -> DataFrame:
    """Jobs, completed jobs, newest submission and success percentage per owner; the busiest ``n``."""
    name = F.coalesce(F.col(owner), F.lit("Unknown owner"))
    out = with_status(jobs).groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("canonical_status") == "succeeded").alias("completed"),
        F.max("uploaded_at").alias("latest_submitted_at"),
    )
    share = F.floor(numbers.ratio(F.col("completed"), F.col("jobs")) * 100 + 0.5).cast("string")
    out = out.withColumn("success_rate", F.concat(share, F.lit("%")))
    return out.orderBy(F.desc("jobs"), "name").limit(n) if n else out


def period_counts(jobs: DataFrame, today: str) -> DataFrame:
    """Jobs submitted today, in the last seven days and in the month so far."""
    day, at = F.to_date(F.lit(today)), F.to_date("uploaded_at")
    return jobs.agg(
        F.count_if(at >= day).alias("today"),
        F.count_if(at >= F.date_sub(day, 6)).alias("last_7_days"),
        F.count_if(at >= F.trunc(day, "month")).alias("month_to_date"),
    )


def assignment(users: DataFrame) -> DataFrame:
    """Employees with and without a manager."""
    employees = users.filter(F.col("role") == "employee")
    return employees.agg(
        F.count_if(F.col("manager_id").isNotNull()).alias("assigned"),
        F.count_if(F.col("manager_id").isNull()).alias("unassigned"),
    )


def fleet(agents: DataFrame) -> DataFrame:
    """Active and degraded agents and all their invocations (``status, total_invocations``)."""
    return agents.agg(
        F.count(F.lit(1)).alias("agents"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "degraded").alias("degraded"),
        F.coalesce(F.sum("total_invocations"), F.lit(0)).cast("bigint").alias("total_invocations"),
    )


def fleet_watchlist(agents: DataFrame) -> DataFrame:
    """Agents that need attention first: degraded, idle, active, others."""
    return agents.orderBy(tables.listed_first(F.col("status"), ["degraded", "idle", "active"]), "name")


# --- logs ---------------------------------------------------------------------------------------


def event_counters(log: DataFrame, event: str = "event") -> DataFrame:
    return log.groupBy(F.col(event).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def agreement(checks: DataFrame) -> DataFrame:
    """How often two checkers agree: ``first`` and ``second`` are booleans, ``second`` null when the
    checker was unavailable. The rate is over all comparisons."""
    agree = F.count_if(F.col("second").isNotNull() & (F.col("first") == F.col("second")))
    return checks.agg(
        F.count(F.lit(1)).alias("comparisons"),
        agree.alias("agree"),
        F.count_if(F.col("second").isNull()).alias("unavailable"),
        F.coalesce(numbers.ratio(agree, F.count(F.lit(1))), F.lit(0.0)).alias("agreement_rate"),
    )


def calls(log: DataFrame) -> DataFrame:
    """One row per call attempt from its started, completed and failed entries.

    The entries are folded by one aggregation on the attempt id instead of joined to each other.
    """
    e = F.col("event")
    ended = e.isin("completed", "failed")
    return log.groupBy("physical_attempt_id").agg(
        F.max(F.when(e == "started", F.col("operation"))).alias("operation"),
        F.min(F.when(e == "started", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("ended_at"),
        F.max(F.when(ended, e)).alias("outcome"),
        F.max(F.when(e == "completed", F.col("total_tokens"))).alias("total_tokens"),
        F.max(F.when(e == "failed", F.col("error_type"))).alias("error_type"),
    ).withColumn("duration_ms", dates.seconds_between(F.col("ended_at"), F.col("started_at")) * 1000)


def call_stats(log: DataFrame) -> DataFrame:
    """Per operation: attempts, completed, failed, open, tokens, mean duration and its percentiles
    (from a sketch of bounded size)."""
    o = F.col("outcome")
    return calls(log).filter("operation is not null").groupBy("operation").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(o == "completed").alias("completed"),
        F.count_if(o == "failed").alias("failed"),
        F.count_if(o.isNull()).alias("open"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.avg("duration_ms").alias("mean_ms"),
        F.percentile_approx("duration_ms", [0.5, 0.95], 10_000).alias("p50_p95_ms"),
    )


def run_status(steps: DataFrame) -> DataFrame:
    """Status of every run from its steps (``run_id, kind calc|chart, status``): a failed or partial
    calculation fails the run, a failed chart only adds a warning."""
    calc = (F.col("kind") == "calc") & F.col("status").isin("failed", "partial")
    chart = (F.col("kind") == "chart") & (F.col("status") == "failed")
    return steps.groupBy("run_id").agg(
        F.when(F.bool_or(calc), "failed").when(F.bool_or(chart), "completed_with_warnings").otherwise("complete").alias("job_status"),
        F.count_if(chart).alias("failed_charts"),
    )


def job_steps(jobs: DataFrame) -> DataFrame:
    """Four steps per job with their state: ingestion, routing, execution (or review), output."""
    s = F.col("canonical_status")
    sent = F.col("dispatched_at").isNotNull()
    review = s.isin("awaiting_confirmation", "awaiting_clarification", "awaiting_schema_approval")
    paused = (s == "quarantined") & jsons.field(F.col("summary"), "status").isin(*WAITING_PAYLOAD)
    failed, done = s.isin(*FAILED), s == "succeeded"
    routing = F.when(paused, F.when(sent, "complete").otherwise("running")).when(review, "complete").when(s == "queued", "running")
    routing = routing.otherwise(F.when(sent, "complete").otherwise("running"))
    running = F.when(paused | review, "blocked").when(done, "complete").when(failed, "failed").otherwise("running")
    output = F.when(paused | review | failed, "blocked").when(done, "complete").otherwise("running")
    step = lambda i, name, state: F.struct(F.lit(i).alias("step"), name.alias("name"), state.alias("state"))
    # The names of the steps.
    steps = F.array(
        step(1, F.lit("Ingestion"), F.lit("complete")),
        step(2, F.lit("Workflow routing"), routing),
        step(3, F.when(review, "Interpretation review").otherwise("Agent execution"), running),
        step(4, F.lit("Output preparation"), output),
    )
    return with_status(jobs).select("id", F.inline(steps))


def message_stats(messages: DataFrame) -> DataFrame:
    """Per conversation (``conv_id, turn, role, text``): characters per role, messages, and a hash
    that is equal for equal conversations.

    Each message is hashed where it lies and only the fixed-size hashes are summed, with the turn
    mixed in, so a conversation of any length is a small aggregate.
    """
    chars = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.length("text"))), F.lit(0)).cast("bigint")
    digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), "turn", "role", "text").cast("decimal(20,0)"))
    return messages.groupBy("conv_id").agg(
        chars("system").alias("system_characters"),
        chars("user").alias("user_characters"),
        F.count(F.lit(1)).alias("message_count"),
        F.sha2(F.concat_ws(":", digest(1).cast("string"), digest(2).cast("string")), 256).alias("content_hash"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The newest row of every key."""
    return ordered.first_per_key(df, keys, order_by)
