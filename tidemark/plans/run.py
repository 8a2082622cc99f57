"""Apply a list of ops as one chain of transforms, and count the rows of its steps.

Nothing is executed here except the small statistics some ops need. The audit counts rows by itself
when it is asked for, so it is exact whatever part of the result has been read: one aggregate for the
input and one for each step that may change the number of rows, all in one query. Counters inside the
result's own plan would cost no pass, but they count what happened to be read, and a limit ends the
reading of all steps before it. Warnings of steps come from the same query.

An op is planned when it is applied and runs with the result, so its times are those of its planning,
the statistics it needed included.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import cleaning
from tidemark.operators.columns import modified_columns
from tidemark.plans import registry
from tidemark.sources import sinks


def params_hash(op: dict) -> str:
    """SHA-256 of the op with its keys sorted."""
    return hashlib.sha256(json.dumps(op, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Step:
    op: dict
    before: list[str]
    after: list[str]
    df: DataFrame
    keeps_rows: bool
    warner: DataFrame | None = None
    started_at: int = 0
    finished_at: int = 0

    def entry(self, number: int, rows_in: int, rows_out: int, warnings: list[str]) -> dict:
        return {
            "operation_id": f"step_{number}",
            "operation_type": self.op["type"],
            "type": self.op["type"],
            "input_row_count": rows_in,
            "output_row_count": rows_out,
            "input_columns": self.before,
            "output_columns": self.after,
            "columns_modified": modified_columns(self.before, self.after),
            "warnings": warnings,
            "started_at": self.started_at,
            "finished_at": self.finished_at,
            "duration_ms": self.finished_at - self.started_at,
            "params_hash": params_hash(self.op),
            "changed_values": rows_in - rows_out,
            **({"origin": "filter_prep"} if self.op["type"] == "filter_prep" else {}),
        }


@dataclass
class StepResult:
    """The lazy result table, and the audit of its steps."""

    df: DataFrame
    source: DataFrame | None = None
    steps: list[Step] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def entries(self) -> list[dict]:
        """The audit entries; counts the rows and gathers the warnings, in one query. ``warnings`` has those of
        all steps afterwards."""
        if not self.steps:
            return []
        none = F.lit(None)
        counted = [self.source, *[s.df for s in self.steps if not s.keeps_rows]]
        queries = [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n", none.cast("string").alias("warning"))
            for i, df in enumerate(counted)
        ]
        queries += [
            s.warner.select(F.lit(i).alias("i"), none.cast("bigint").alias("n"), "warning") for i, s in enumerate(self.steps) if s.warner is not None
        ]
        rows = reduce(DataFrame.unionAll, queries).collect()
        counts = {r["i"]: r["n"] for r in rows if r["warning"] is None}
        said = [sorted(r["warning"] for r in rows if r["warning"] is not None and r["i"] == i) for i in range(len(self.steps))]
        self.warnings = [w for step in said for w in step]
        out, at = [], 0
        for number, step in enumerate(self.steps, 1):
            before, at = at, at if step.keeps_rows else at + 1
            out.append(step.entry(number, counts[before], counts[at], said[number - 1]))
        return out

    def audit(self) -> DataFrame:
        return sinks.audit_rows(self.df.sparkSession, self.entries())


def apply_ops(df: DataFrame, ops: list[dict], auto_prep: bool = False, audit: bool = True) -> StepResult:
    """Run ops in order. ``auto_prep`` puts the safe preparation before the first filter when the
    list has no cleaning op. ``audit=False`` keeps no steps, for plans that are never audited."""
    ops = with_auto_prep(ops) if auto_prep else ops
    result, current = StepResult(df, df), df
    for op in ops:
        before, started = current, time.time_ns() // 1_000_000
        current = registry.find(op["type"])(before, op)
        if audit:
            keeps, warner = registry.keeps_rows(op["type"]), registry.warnings_of(before, op)
            finished = time.time_ns() // 1_000_000
            result.steps.append(Step(op, before.columns, current.columns, current, keeps, warner, started, finished))
    result.df = current
    return result


def with_auto_prep(ops: list[dict]) -> list[dict]:
    first = next((i for i, o in enumerate(ops) if o["type"] == "filter"), None)
    if first is None or any(o["type"] in registry.CLEANING for o in ops):
        return ops
    return ops[:first] + [{"type": "filter_prep"}] + ops[first:]


def filter_prepared(df: DataFrame, conditions: list[dict], logic: str = "and") -> DataFrame:
    """Filter on prepared values but return the rows as they were."""
    kept = F.struct(*[names.col(c) for c in df.columns]).alias("keptrow")
    prepared = cleaning.prepare_for_filter(df.select("*", kept))
    fixed = [{**c, "column": names.styled(c["column"])} for c in conditions]
    return registry.ACTIONS["filter"](prepared, {"conditions": fixed, "logic": logic}).select("keptrow.*")


def transform_of(ops: list[dict]):
    """A function for ``DataFrame.transform``."""
    return lambda df: apply_ops(df, ops, audit=False).df
