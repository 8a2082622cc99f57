"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

Every document gets a virtual finish time: the words that its source has given up to and including it,
in a shuffled order, divided by the words that its source shall give. Documents are taken in the order
of their finish times until the budget is spent, so all sources run out of budget together. A source
that shall give more than it has goes through its documents again, ``max_repeats`` times at most.

No sum runs through one task. Running sums are split into buckets of the shuffled order, about as many
as the square root of the rows, so both a bucket and the table of bucket sums stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, words


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[float, ...], budget: float, max_repeats: int) -> DataFrame:
    """Add ``rank`` and ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, null last, weigh the values of ``cycle`` in turn. The budget is a share of all
    sizes; a target stops at ``max_repeats`` times its source's size and the excess is shared again by
    weight. That is water filling: sources fill up in the order of size over weight, and the first that
    does not ends it, so one sorted pass over the sources settles it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), F.col("rank") % len(cycle) + 1))
    cap = max_repeats * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), "rank")
    filled = (
        ranked.withColumn("cap", cap.cast("double"))
        .withColumn("goal", budget * F.sum("source_size").over(everything))
        .withColumn("full_before", F.sum("cap").over(order) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight"))
        .withColumn("full", (F.col("goal") - F.col("full_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    )
    full = F.col("full")
    share = (F.col("goal") - F.coalesce(F.sum(F.when(full, F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(
        F.when(~full, F.col("weight"))
    ).over(everything)
    return filled.select(
        "source", "source_size", "rows", "goal", "rank",
        F.when(full, F.col("cap")).otherwise(F.col("weight") * share).alias("target"),
    )


def mix(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None,
    cycle: tuple[float, ...] = (1, 2, 3), budget: float = 1.0, max_repeats: int = 3, seed: int = 17,
) -> DataFrame:
    """(id, size, source_size, target, taken) for every row; ``taken`` counts repeats.

    ``size`` is the number of words unless given. Null sources are one source, the last; null and empty
    texts have size 0 and nothing is taken of them; equal finish times are settled by source, round,
    shuffle key and id; repeated rows are queued one after another; an empty table gives no rows.
    """
    n = F.coalesce(size, F.lit(0)).cast("long") if size is not None else word_count(F.col(text))
    slim = docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), n.alias("size"), F.xxhash64(F.col(id), F.lit(seed)).alias("key")
    )
    slim = materialize(slim, "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = materialize(targets(sizes, cycle, budget, max_repeats), "targets")

    # Place every document in the shuffled order of its source: bucket by bucket, by key inside a bucket.
    part = F.shiftrightunsigned("key", 11) * F.lit(2.0**-53)
    placed = slim.join(sources, slim["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn(
        "bucket", F.floor(part * F.ceil(F.sqrt("rows")))
    )
    before = (
        placed.groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
        .withColumn("before", F.sum("in_bucket").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("in_bucket"))
        .drop("in_bucket")
    )
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(
        placed.withColumn("inside", F.sum("size").over(inside)).join(before, ["rank", "bucket"])
        .select("id", "size", "key", "rank", "source_size", "target", "goal", (F.col("before") + F.col("inside")).alias("until")),
        "queue",
    )

    # Finish times of all rounds, and the item at which the budget is spent.
    def finish(k: int) -> Column:
        return (F.col("until") + k * F.col("source_size")) / F.col("target")

    def place(k: int) -> Column:
        return F.struct(
            finish(k).alias("finish"), F.col("rank"), F.lit(k).alias("round"), F.col("key"), F.col("id"), F.col("until")
        )

    def rounds(df: DataFrame) -> DataFrame:
        return df.where("size > 0").select("size", "goal", F.explode(F.array(*(place(k) for k in range(max_repeats)))).alias("at"))

    rows = slim.count()
    steps = max(1, int(rows**0.5))  # buckets of one unit of virtual time
    items = rounds(placed).withColumn("bucket", F.floor(F.col("at.finish") * steps))
    spent = Window.orderBy("bucket")
    edge = (
        items.groupBy("bucket").agg(F.sum("size").alias("in_bucket"), F.first("goal").alias("goal"))
        .withColumn("after", F.sum("in_bucket").over(spent)).where("after > goal")
        .orderBy("bucket").select("bucket", (F.col("after") - F.col("in_bucket")).alias("before")).limit(1).first()
    )
    if edge is None:
        taken = F.lit(max_repeats).cast("long") * F.col("size")  # the budget covers all rounds
    else:
        running = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        first_left = (
            items.where(F.col("bucket") == edge["bucket"])
            .withColumn("after", F.sum("size").over(running) + edge["before"])
            .where("after > goal").select("at").orderBy("at").limit(1).first()["at"]
        )
        kinds = {f.name: f.dataType for f in placed.schema} | {"finish": "double", "round": "int"}
        stop = F.struct(*(F.lit(first_left[c]).cast(kinds[c]).alias(c) for c in ("finish", "rank", "round", "key", "id", "until")))
        taken = sum(
            (F.when((F.col("size") > 0) & (place(k) < stop), F.col("size")).otherwise(F.lit(0).cast("long")) for k in range(max_repeats)),
            F.lit(0).cast("long"),
        )
    return placed.select(
        F.col("id").alias(id), "size", "source_size", "target", taken.alias("taken")
    )
