"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names

HOT_SHARE = 1_000
SPREAD = 4_096


def join_counted(df: DataFrame, key: Column, counted: DataFrame, flag: str) -> DataFrame:
    """Add a boolean: does the row's key occur in ``counted`` (columns ``value, count``)?

    ``counted`` holds how many rows of ``df`` have each value. Values with at least a thousandth of
    the counted rows are hot: there can be at most a thousand of them, so they are broadcast. All
    others are joined by shuffle, where no key has more than a thousandth of the rows. Rows that
    need no shuffle join (hot or null key) get a spread-out key that matches nothing.
    """
    total = counted.agg(F.sum("count").alias("total"))
    shared = counted.filter(F.col("count") * HOT_SHARE >= total.scalar()).select(F.col("value").alias("__hot"))
    cold = counted.filter(F.col("count") * HOT_SHARE < total.scalar()).select(F.col("value").alias("__cold"))
    rows = df.withColumn("__key", key)
    rows = rows.join(F.broadcast(shared), F.col("__key") == F.col("__hot"), "left")
    aside = F.col("__hot").isNotNull() | F.col("__key").isNull()
    spread = F.pmod(F.xxhash64(*[names.col(c) for c in df.columns]), F.lit(SPREAD)).cast("string")
    probe = F.when(aside, F.concat(F.lit("\u0000"), spread)).otherwise(F.col("__key"))
    rows = rows.withColumn("__probe", probe).join(cold, F.col("__probe") == F.col("__cold"), "left")
    return rows.withColumn(flag, F.col("__hot").isNotNull() | F.col("__cold").isNotNull()).select(*df.columns, flag)
