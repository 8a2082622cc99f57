"""Live KPIs and stateless cleaning on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import PlanError
from tidemark.operators import cleaning, rules
from tidemark.plans import registry
from tidemark.plans.run import transform_of
from tidemark.session import hadoop_path, path_exists, scratch_path
from tidemark.streaming import keyed
from tidemark.streaming.ingest import run


def daily_counts(events: DataFrame, time: str, by: list[str], lateness: str, span: str = "1 day") -> DataFrame:
    """Events per tumbling window and key, refreshed with every event (update mode). Events later than
    ``lateness`` are dropped; ``ingest.dropped_late`` counts them."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.window(time, span), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), *by, "n")
    )


class Cells:
    """A small table of sums that follows a change log: a version per micro-batch, of which two are kept.

    A version is the one before plus the batch's changes, so a batch that runs again after a failure writes
    the same version again. The table has a row per cell, whatever the number of events.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str]):
        self.spark, self.path, self.keys, self.sums = spark, path, keys, sums

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        fs, folder = hadoop_path(self.spark, self.path)
        if not fs.exists(folder):
            return []
        found = [(int(s.getPath().getName().split("=")[1]), s.getPath().toString()) for s in fs.listStatus(folder)]
        return sorted(n for n, path in found if path_exists(self.spark, f"{path}/_SUCCESS"))

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Add one micro-batch of the change log."""
        before = [n for n in self.versions() if n < batch_id]
        both = changes.select(*self.keys, *self.sums)
        if before:
            both = both.unionByName(self.spark.read.parquet(f"{self.path}/version={before[-1]}"))
        now = both.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))
        now = now.where(F.greatest(*(F.abs(c) for c in self.sums)) != 0)
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        for n in before[:-1]:
            fs, folder = hadoop_path(self.spark, f"{self.path}/version={n}")
            fs.delete(folder, True)

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self.versions()[-1]}")


def live_daily(jobs: DataFrame, records: DataFrame, path: str | None = None, checkpoint: str | None = None) -> Cells:
    """Run streams of job events and records into the daily trend: jobs and records per day and status, as of
    the newest event of every job. ``current()`` of the result is the table."""
    spark = jobs.sparkSession
    cells = Cells(spark, path or scratch_path(spark, "trend"), ["day", "status"], ["uploads", "records"])
    writer = keyed.cell_changes(jobs, records).writeStream.outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint or scratch_path(spark, "trend-checkpoint"))
    run(writer.foreachBatch(cells.apply))
    return cells


def clean(stream: DataFrame, ops: list[dict]) -> DataFrame:
    """The stateless ops on a stream. Ops that need statistics of the whole table are refused; give
    them their values beforehand, for example ``fill_nulls`` with a constant from a saved profile."""
    for op in ops:
        constant = op["type"] == "fill_nulls" and op.get("strategy") in ("zero", "empty_string", "constant")
        if registry.OP_ALIASES.get(op["type"], op["type"]) in registry.DATA_DEPENDENT and not constant:
            raise PlanError(f"{op['type']} needs the whole table and cannot run on a stream")
    return transform_of(ops)(stream)


def flag(stream: DataFrame, constraints: list[dict], now=None) -> DataFrame:
    """Per-row validation on a stream: every rule but ``unique``."""
    if any(k.get("rule") == "unique" for k in constraints):
        raise PlanError("unique needs the whole table and cannot run on a stream")
    return rules.flag_rows(stream, constraints, now)


def convert_with_profile(stream: DataFrame, rates: dict[str, dict[str, float]]) -> DataFrame:
    """The preparation's conversions decided by a saved profile instead of the stream's own data."""
    out = cleaning.numeric_when_confident(stream, list(rates), rates)
    return cleaning.dates_when_confident(out, [c for c in rates if out.schema[c].dataType.typeName() == "string"], rates)
