"""Routing of events, and sessions of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.keyed import EXPIRED


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Store one micro-batch; replays overwrite it."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def route(batch: DataFrame, batch_id: int, review: str, dead: str, key: str, status: str) -> None:
    """Quarantined events to the review table, failed ones to the dead letters, one row per event.

    The batch is stored as it is evaluated twice; a replayed batch overwrites its own folders.
    """
    rows = batch.dropDuplicates([key]).persist()
    try:
        write_batch(rows.filter(F.col(status) == "quarantined"), batch_id, review)
        write_batch(rows.filter(F.col(status) == "failed"), batch_id, dead)
    finally:
        rows.unpersist()


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions that end a fixed time after their first event, of a whole table.

    ``events``: ``session_id, at, answer`` (boolean). An answer within the time resolves a session; without one it
    expires and is quarantined. ``keyed.session_timeouts`` gives the same outcomes while a stream runs.
    """
    first = events.groupBy("session_id").agg(F.min("at").alias("opened_at"), F.min(F.when(F.col("answer"), F.col("at"))).alias("answered_at"))
    deadline = F.col("opened_at") + F.make_dt_interval(mins=F.lit(minutes))
    resolved = F.coalesce(F.col("answered_at") <= deadline, F.lit(False))
    return first.select(
        "session_id", "opened_at",
        F.when(resolved, F.col("answered_at")).otherwise(deadline).alias("ended_at"),
        F.when(resolved, "resolved").otherwise("quarantined").alias("outcome"),
        F.when(~resolved, EXPIRED).alias("reason"),
    )
