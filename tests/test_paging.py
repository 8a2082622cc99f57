"""Deep pages, and functions over groups of any size."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.plans import registry
from tidemark.plans.run import apply_ops


def test_pages_read_their_slices_only(spark):
    df = spark.range(5000).select((F.col("id") % 50).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    order = [F.desc("k"), F.asc_nulls_last("v")]
    pages = tables.Pages(df, order, slices=16)
    want = sorted(((i % 50, i if i % 7 else None) for i in range(5000)), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert pages.rows == 5000 and len(pages.starts) > 8
    for number, size in ((0, 10), (3, 333), (41, 100), (49, 100), (15, 333), (99, 100)):
        got = pages.page(number, size)
        assert [tuple(r) for r in got.collect()] == want[number * size : (number + 1) * size]
    held = [k for k, low, high in pages.starts if low < 4110 and 4100 < high]
    plan = pages.page(410, 10)._jdf.queryExecution().executedPlan().toString()
    assert len(held) <= 2 and "PartitionFilters" in plan and all(str(k) in plan for k in held)


def test_pages_of_an_empty_table_and_of_equal_rows(spark):
    assert tables.Pages(spark.range(0), [F.col("id")]).page(0, 5).collect() == []
    same = spark.range(30).select(F.lit(1).alias("k"), F.col("id"))
    pages = tables.Pages(same, [F.col("k")], slices=4)
    seen = [r["id"] for n in range(4) for r in pages.page(n, 8).collect()]
    assert sorted(seen) == list(range(30))


def test_merged_groups_spread(spark):
    """A group with most rows, a null key, and states that merge from any cut."""
    registry.merged_op(
        "spread", lambda p: {"low": int(p["v"].min()), "high": int(p["v"].max())}, "low bigint, high bigint",
        lambda s: {"range": int(s["high"].max() - s["low"].min()), "states": len(s)}, "range bigint, states bigint",
    )
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("g"), F.col("id").alias("v"))
    got = {r["g"]: (r["range"], r["states"]) for r in apply_ops(df.repartition(6), [{"type": "spread", "group_by": ["g"]}]).df.collect()}
    plain = pd.DataFrame({"id": range(4000)})
    plain["g"] = ["hot" if i % 3 else "cold" if i % 2 == 0 else None for i in plain["id"]]
    for g, part in plain.groupby("g", dropna=False):
        g = None if pd.isna(g) else g
        assert got[g][0] == part["id"].max() - part["id"].min() and got[g][1] >= 6
