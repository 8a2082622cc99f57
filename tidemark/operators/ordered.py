"""Running values over groups of any size.

A window function puts a whole group into one task. Here the rows are range-partitioned by key and
order instead, so a large group spreads over many slices. The slices are stored once; a summary of
each slice's first and last key (at most one row per slice) gives what earlier slices carry over;
the window then runs inside a slice, whose size is bounded, and adds the carry.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.session import materialize

SLICE_BYTES = 128 * 2**20
UNKNOWN_BYTES = 2**62


@dataclass(frozen=True)
class Running:
    """A running value: ``sum``, ``count``, ``last`` (non-null up to this row) or ``last_before``."""

    kind: str
    column: str | None = None


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; columns that hold a map are hashed by their JSON text."""
    hashable = [F.to_json(_c(f.name)) if "map<" in f.dataType.simpleString() else _c(f.name) for f in df.schema.fields]
    return F.xxhash64(*hashable)


def slice_count(df: DataFrame) -> int:
    """The session's shuffle partitions, or more where the sources of ``df`` hold more than
    ``SLICE_BYTES`` for each. Sizes come from the plan, so no row is read for them; a source of
    unknown size does not count."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(partitions, math.ceil(sum(s for s in sizes if s < UNKNOWN_BYTES) / SLICE_BYTES))


def running(
    df: DataFrame, partition_by: list[str], order_by: list[str], values: dict[str, Running],
    slices: int | None = None,
) -> DataFrame:
    """Add running values per group in ascending order; ``slices`` defaults to ``slice_count``.
    Rows that are equal in ``order_by`` are ordered by a hash of the whole row, so the result does
    not depend on the run and many equal rows still spread over slices."""
    names.require(df, partition_by + order_by)
    n = slices or slice_count(df)
    tied = df.withColumn("__tie", row_hash(df))
    order_by = [*order_by, "__tie"]
    sort = [_c(c) for c in partition_by + order_by]
    sliced = materialize(
        tied.repartitionByRange(n, *sort).withColumn("__slice", F.spark_partition_id()), "slices"
    )
    key = F.struct(F.lit(0).alias("z"), *[_c(c).alias(f"k{i}") for i, c in enumerate(partition_by)])
    carry = _carry(sliced.withColumn("__key", key), order_by, values)
    rows = sliced.withColumn("__key", key).join(
        F.broadcast(carry), on=["__slice", "__key"], how="left"
    )
    within = Window.partitionBy("__slice", "__key").orderBy(*[_c(c) for c in order_by])
    to_here = within.rowsBetween(Window.unboundedPreceding, 0)
    to_before = within.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name, r in values.items():
        carried = F.col(f"__c_{name}")
        if r.kind == "sum":
            local = F.sum(_c(r.column)).over(to_here)
            out[name] = F.when(
                local.isNotNull() | carried.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
            )
        elif r.kind == "count":
            out[name] = F.row_number().over(within).cast("bigint") + F.coalesce(carried, F.lit(0))
        elif r.kind == "last":
            out[name] = F.coalesce(F.last(_c(r.column), ignorenulls=True).over(to_here), carried)
        else:
            out[name] = F.coalesce(F.last(_c(r.column), ignorenulls=True).over(to_before), carried)
    return rows.withColumns(out).select(*df.columns, *values)


def _carry(sliced: DataFrame, order_by: list[str], values: dict[str, Running]) -> DataFrame:
    """Per slice and key that started in an earlier slice: the values carried in.

    Only the last key of a slice can go on in the next one, so the summary has one row per slice.
    """
    edges = sliced.groupBy("__slice").agg(F.max("__key").alias("__last"))
    tails = sliced.join(F.broadcast(edges), "__slice").filter(F.col("__key") == F.col("__last"))
    order = F.struct(*[_c(c) for c in order_by])
    sums = []
    for name, r in values.items():
        if r.kind == "sum":
            sums.append(F.sum(_c(r.column)).alias(f"__t_{name}"))
        elif r.kind == "count":
            sums.append(F.count(F.lit(1)).alias(f"__t_{name}"))
        else:
            sums.append(F.max_by(_c(r.column), F.when(_c(r.column).isNotNull(), order)).alias(f"__t_{name}"))
    tail = tails.groupBy("__slice", "__key").agg(*sums)
    # One row per slice from here on. Every slice is offered the tail of the nearest earlier slice
    # that has one, and what had already been carried into that.
    earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    carried = []
    for name, r in values.items():
        t = F.col(f"__t_{name}")
        total = F.sum(t).over(earlier) if r.kind in ("sum", "count") else F.last(t, ignorenulls=True).over(earlier)
        carried.append(total.alias(f"__c_{name}"))
    upto = tail.select("__key", F.col("__slice").alias("__from"), *carried)
    # A key's tails lie in consecutive slices, so the slice behind each tail is the one that
    # receives it; empty slices hold no rows and receive nothing.
    order_of = Window.orderBy("__slice")
    following = edges.select(
        F.col("__slice").alias("__from"), F.lead("__slice").over(order_of).alias("__slice")
    ).filter("__slice is not null")
    return upto.join(F.broadcast(following), "__from").select("__slice", "__key", *[f"__c_{n}" for n in values])


def row_index(df: DataFrame, partition_by: list[str], order_by: list[str], name: str = "record_index") -> DataFrame:
    """Number the rows of each group from 1 in order."""
    return running(df, partition_by, order_by, {name: Running("count")})


def first_per_key(df: DataFrame, keys: list[str], order_by: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps only ``n`` rows per key and task before the
    shuffle, so a key with a third of all rows sends a handful."""
    window = Window.partitionBy(*[_c(k) for k in keys]).orderBy(*order_by)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n).drop("__rank")
