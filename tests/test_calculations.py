import datetime
import random

import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from tidemark.errors import PlanError, UnknownOperatorError
from tidemark.operators import calculations as k
from tidemark.operators import ordered
from tidemark.operators import quantiles
from tidemark.operators.quantiles import exact_quantile, exact_quantiles


@pytest.fixture(scope="module")
def employees(spark):
    data = [(i, "Female" if i <= 5 else "male", s) for i, s in enumerate(["single", "Single ", "married", "divorced", "divorced", "single", "single", "married", "married", "married"], 1)]
    return spark.createDataFrame(data, "id int, gender string, marital_status string")


@pytest.fixture(scope="module")
def revenue(spark):
    amounts = [10000, 12000, 15000, 11000, 13000, 14000, 16000, 15500, 17000, 18000, 19000, 20000]
    data = [(i, datetime.datetime(2026, i, 15), a) for i, a in enumerate(amounts, 1)]
    return spark.createDataFrame(data, "id int, date timestamp_ntz, revenue int")


def test_group_sum_replaces_the_column(spark):
    df = spark.createDataFrame([("A", 10), ("A", 20), ("B", 30), (None, 5), ("C", None)], "Cat string, Val int")
    assert rows(k.group(df, "sum", "Val", ["Cat"], "TotalVal")) == [("A", 30), ("B", 30), ("C", 0)]
    assert rows(k.group(df, "mean", "Val", ["Cat"])) == [("A", 15.0), ("B", 30.0), ("C", None)]
    assert rows(k.group(df, "count", "Val", ["Cat"])) == [("A", 2), ("B", 1), ("C", 1)]


def test_conditional_percentage(employees):
    one = lambda df: tuple(df.first())
    assert one(k.conditional_percentage(employees, "marital_status", "single", "gender", "female")) == (40.0, 2, 5)
    assert one(k.conditional_percentage(employees, "marital_status", "married")) == (40.0, 4, 10)
    assert one(k.conditional_percentage(employees, "marital_status", "divorced", "gender", "FEMALE")) == (40.0, 2, 5)
    with pytest.raises(Exception, match="no row in the denominator"):
        k.conditional_percentage(employees, "gender", "female", "gender", "nobody").collect()


def test_quarters(revenue):
    first = k.quarterly(revenue, "sum", "revenue", "date").collect()
    assert [r["quarter"] for r in first] == ["2026Q1", "2026Q2", "2026Q3", "2026Q4"]
    assert (first[0]["quarterly_sum_revenue"], first[0]["period_start"]) == (37000, "2026-01-01")
    assert k.quarterly(revenue, "mean", "revenue", "date").first()["quarterly_mean_revenue"] == 12333.33
    assert column(k.quarterly(revenue, "count", "revenue", "date"), "quarterly_count_revenue") == [3, 3, 3, 3]


def test_quarters_of_text_skip_what_is_no_date(spark):
    df = spark.createDataFrame([("2024-02-01", 1.0), ("later", 2.0), (None, 3.0)], "d string, x double")
    assert rows(k.quarterly(df, "sum", "x", "d", "s")) == [("2024Q1", 1.0, "2024-01-01")]


def test_scalars(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.125,)], "x double")
    got = k.scalars(df, [(f, "x", None) for f in ("sum", "mean", "median", "min", "max", "count", "count_distinct", "variance")]).first().asDict()
    assert got["sum_x"] == 7.12 and got["median_x"] == 2.0 and got["count_x"] == 3 and got["count_distinct_x"] == 3
    empty = k.scalars(df.filter("x > 100"), [("sum", "x", None), ("mean", "x", None), ("median", "x", None)]).first()
    assert tuple(empty) == (0.0, None, None)
    one = k.scalars(df.filter("x = 1"), [("variance", "x", None), ("standard_deviation", "x", None)]).first()
    assert tuple(one) == (None, None)
    with pytest.raises(PlanError):
        k.scalar(spark.createDataFrame([("a",)], "s string"), "sum", "s")


def test_exact_quantile_against_brute_force(spark):
    rng = random.Random(5)
    for values in (
        [rng.gauss(0, 100) for _ in range(3001)],
        [7.0] * 900 + [rng.random() for _ in range(1100)],
        [1.0, 2.0] * 500,
        [3.0],
    ):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ranked = sorted(values)
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            at = (len(ranked) - 1) * p
            low, high = ranked[int(at)], ranked[min(int(at) + 1, len(ranked) - 1)]
            expected = low + (high - low) * (at - int(at))
            assert exact_quantile(df, "v", p, final_values=20) == pytest.approx(expected, abs=1e-9)


def test_medians_of_many_columns_take_few_scans(spark, monkeypatch):
    """Ties, infinities, nulls, NaN and a far outlier, side by side."""
    rng, inf = random.Random(2), float("inf")
    made = {
        "normal": [rng.gauss(0, 1) for _ in range(4000)], "tied": [rng.choice([1.0, 2.0]) for _ in range(4000)],
        "far": [rng.random() for _ in range(3999)] + [1e300], "ends": [-inf] * 900 + [inf] * 900 + [rng.random() for _ in range(2200)],
        "gaps": [None if i % 3 else float(i) for i in range(4000)], "nan": [float("nan") if i % 2 else -float(i) for i in range(4000)],
        "none": [None] * 4000, "inf": [inf] * 4000, "a`b": [float(i % 7) for i in range(4000)],
    }
    df = spark.createDataFrame(list(zip(*made.values())), ", ".join(f"`{c.replace('`', '``')}` double" for c in made)).repartition(4).persist()
    want = {}
    for c, values in made.items():
        kept = sorted(x for x in values if x is not None and x == x)
        middle = (len(kept) - 1) // 2
        want[c] = None if not kept else kept[middle] if kept[middle] == kept[len(kept) // 2] else (kept[middle] + kept[len(kept) // 2]) / 2
    scans = []
    row, between = quantiles._row, quantiles._between
    monkeypatch.setattr(quantiles, "_row", lambda *a: scans.append(1) or row(*a))
    monkeypatch.setattr(quantiles, "_between", lambda *a: scans.append(1) or between(*a))
    got = exact_quantiles(df, list(made), 0.5, final_values=100)
    assert {c: None if v is None else pytest.approx(v) for c, v in got.items()} == want
    assert len(scans) <= 5
    df.unpersist()


def brute_running(data, by_key):
    """Running sum, count and change of (key, order, value) rows, plainly."""
    out, state = {}, {}
    for key, order, value in sorted(data, key=lambda r: (r[0] or "", r[1])):
        total, n, last = state.get(key if by_key else 0, (0, 0, None))
        n += 1
        now = value if value is not None else last
        change = None if now is None or last in (None, 0) else now / last - 1
        total += value or 0
        out[order] = (total if value is not None else None, n, change)
        state[key if by_key else 0] = (total, n, now)
    return out


@pytest.mark.parametrize("slices", [1, 3, 17])
def test_running_values_with_a_hot_key(spark, slices):
    rng = random.Random(slices)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}"
        data.append((key, i, None if rng.random() < 0.2 else rng.randrange(1, 50)))
    df = spark.createDataFrame(data, "key string, o int, v int")
    expected = brute_running(data, True)
    wanted = {
        "total": ordered.Running("sum", "v"), "n": ordered.Running("count"),
        "now": ordered.Running("last", "v"), "before": ordered.Running("last_before", "v"),
    }
    got = ordered.running(df, ["key"], ["o"], wanted, slices).collect()
    assert len(got) == 600
    for r in got:
        total, n, change = expected[r["o"]]
        assert r["n"] == n
        if r["v"] is not None:
            assert r["total"] == total
        assert (None if r["now"] is None or not r["before"] else r["now"] / r["before"] - 1) == change


def test_running_total_over_one_single_key(spark):
    df = spark.range(1000).selectExpr("cast(id as int) as o", "1 as v", "'a' as key")
    out = k.running_total(df, "v", ["o"], ["key"])
    assert rows(out.filter("running_total_v <> o + 1")) == []


def test_null_partition_key_gives_null(spark):
    df = spark.createDataFrame([(None, 1, 5), ("a", 2, 5), ("a", 3, None), ("a", 4, 7)], "key string, o int, v int")
    out = k.running_total(df, "v", ["o"], ["key"], "t")
    assert column(out, "t", "o") == [None, 5, None, 12]
    change = k.percentage_change(df, "v", ["o"], ["key"], "c")
    assert column(change.withColumn("c", F.round("c", 6)), "c", "o") == [None, None, 0.0, 0.4]


def test_row_wise(spark):
    df = spark.createDataFrame([(10.0, 4.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    assert column(k.ratio(df, "a", "b", "r"), "r") == [2.5, None, None]
    assert column(k.difference(df, "a", "b", "d"), "d") == [6.0, 1.0, None]
    assert df.agg(k.zero_denominators("b")).first()[0] == 1


def test_every_calculation_is_reachable(spark):
    assert len(k.CALCULATIONS) == 24
    with pytest.raises(UnknownOperatorError):
        k.calculate(spark.range(1), {"type": "mystery"})
    with pytest.raises(PlanError, match="sort_by"):
        k.calculate(spark.range(1), {"type": "running_total", "column": "id"})
    with pytest.raises(PlanError, match="two dimensions"):
        k.calculate(spark.range(1), {"type": "cross_tab_sum", "column": "id", "group_by": ["id"]})


def test_first_per_key_is_cut_before_the_shuffle(tables):
    df = ordered.first_per_key(tables.lineitem, ["l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
