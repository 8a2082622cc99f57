"""Fingerprints that tell whether a schema, a profile or a file has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered, profile

PROFILER_VERSION = "1.0"
#: Rows of one state of a path that are made at a time.
PIECE = 4096


def _digest_of(rows: DataFrame, parts: list[Column], order: str, name: str) -> DataFrame:
    """SHA-256 over one text per row, in order. The rows number as many as the table's columns, so
    gathering them is bounded by the schema."""
    line = F.concat_ws(":", *parts)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    whole = F.concat_ws("\n", F.transform(pairs, lambda p: p["line"]), F.lit(f"version:{PROFILER_VERSION}"))
    return rows.agg(F.sha2(whole, 256).alias(name))


def schema_fingerprint(df: DataFrame) -> DataFrame:
    """One row: hash of sorted lower-case names, types, and whether nulls occur."""
    stats = profile.column_stats(df, ["null_count"]).select(
        F.lower("column").alias("name"), "data_type", (F.col("null_count") > 0).cast("string").alias("nullable")
    )
    return _digest_of(stats, [F.col("name"), F.col("data_type"), F.col("nullable")], "name", "schema_fingerprint")


def profile_fingerprint(df: DataFrame, values: int = 3) -> DataFrame:
    """One row: hash of each column's distinct count and the hashes of its frequent values, so that
    no value itself is part of it."""
    counts = profile.value_counts(df)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    top = ordered.first_per_key(counts, ["column"], [F.desc("n"), F.col("key")], values)
    top = profile.with_values(df, top.select("column", "key", "n"))
    hashed = top.groupBy("column").agg(
        F.concat_ws(
            ",",
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))),
                lambda p: F.sha2(p["value"], 256),
            ),
        ).alias("hashes")
    )
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    rows = every.join(F.broadcast(distinct), "column", "left").join(F.broadcast(hashed), "column", "left")
    parts = [F.col("column"), F.coalesce("distinct_count", F.lit(0)).cast("string"), F.coalesce("hashes", F.lit(""))]
    return _digest_of(rows, parts, "column", "profile_fingerprint")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Compare two inventories (``path, sha256``): ``unchanged``, ``changed``, ``new`` or ``gone``.

    A path may have several rows, one per version. Equal contents are paired first, each row once, and are unchanged;
    what is left of a path on both sides is changed, and what only one side has is new or gone. So every row of an
    inventory is in one row of the result, and the result never has more rows than both inventories. A path or
    content that is null is a value like others.
    """
    sides = now.select("path", "sha256", F.lit(1).alias("now"), F.lit(0).alias("before")).unionByName(
        before.select("path", "sha256", F.lit(0).alias("now"), F.lit(1).alias("before"))
    )
    contents = sides.groupBy("path", "sha256").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    same = F.least("now", "before")
    paths = contents.groupBy("path").agg(
        F.sum(same).alias("unchanged"), F.sum(F.col("now") - same).alias("now"), F.sum(F.col("before") - same).alias("before")
    )
    changed = F.least("now", "before")
    counts = paths.select("path", "unchanged", changed.alias("changed"), (F.col("now") - changed).alias("new"), (F.col("before") - changed).alias("gone"))
    states = F.array(*(F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in ("unchanged", "changed", "new", "gone")))
    found = counts.select("path", F.inline(states)).where("n > 0")
    # In pieces, so that no array grows with the versions of a path.
    pieces = found.select("path", "state", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("at"))
    return pieces.select("path", F.explode(F.array_repeat("state", F.least(F.col("n") - F.col("at"), F.lit(PIECE)).cast("int"))).alias("state"))
