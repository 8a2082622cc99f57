"""AGG: scalar, grouped, quarterly, cross-tab and conditional calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, LEDGER, dirty, ledger
from tidemark.operators import calculations as ops
from tidemark.plans import contract

catalog = Catalog()
query = catalog.query

SCALARS = {
    "agg1_sum": ("sum", "l_extendedprice", "round_even(sum(l_extendedprice), 2)"),
    "agg2_mean": ("mean", "l_quantity", "avg(l_quantity)"),
    "agg3_median": ("median", "l_extendedprice", "round_even(median(l_extendedprice), 2)"),
    "agg4_min": ("min", "l_extendedprice", "min(l_extendedprice)"),
    "agg5_max": ("max", "l_extendedprice", "max(l_extendedprice)"),
    "agg6_count": ("count", "l_shipdate", "count(l_shipdate)"),
    "agg7_count_distinct": ("count_distinct", "l_partkey", "count(DISTINCT l_partkey)"),
    "agg8_variance": ("variance", "l_extendedprice", "round_even(var_samp(l_extendedprice), 2)"),
    "agg9_standard_deviation": ("standard_deviation", "l_extendedprice", "round_even(stddev_samp(l_extendedprice), 2)"),
}

for _name, (_fn, _column, _sql) in SCALARS.items():

    @query(_name, f"SELECT {_sql} AS {_fn}_{_column} FROM lineitem")
    def _(t: Tables, fn=_fn, column=_column):
        return ops.scalar(t.lineitem, fn, column)


@query(
    "agg_scalars_with_nulls",
    f"""WITH {DIRTY} SELECT round_even(sum(score), 2) AS sum_score, round(avg(score), 6) AS mean_score, count(score) AS count_score,
  count(DISTINCT segment) AS count_distinct_segment, median(score) AS median_score FROM dirty""",
)
def _(t: Tables):
    wanted = [("sum", "score", None), ("mean", "score", None), ("count", "score", None), ("count_distinct", "segment", None), ("median", "score", None)]
    return ops.scalars(dirty(t), wanted).withColumn("mean_score", F.round("mean_score", 6))


@query("agg1_sum_empty", "SELECT 0.0::DOUBLE AS sum_o_totalprice FROM (SELECT sum(o_totalprice) FROM orders)")
def _(t: Tables):
    return ops.scalar(t.orders.filter("o_totalprice < 0"), "sum", "o_totalprice")


@query(
    "agg10_group_sum",
    f"WITH {DIRTY} SELECT segment, round_even(coalesce(sum(score), 0), 2) AS sum_score FROM dirty WHERE segment IS NOT NULL GROUP BY segment",
)
def _(t: Tables):
    return ops.group(dirty(t), "sum", "score", ["segment"])


@query("agg10_group_sum_orders", "SELECT l_orderkey, round_even(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1")
def _(t: Tables):
    return ops.group(t.lineitem, "sum", "l_extendedprice", ["l_orderkey"])


@query(
    "agg11_group_mean",
    f"WITH {DIRTY} SELECT gender, round(avg(score), 6) AS mean_score FROM dirty WHERE gender IS NOT NULL GROUP BY gender",
)
def _(t: Tables):
    return ops.group(dirty(t), "mean", "score", ["gender"]).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "agg12_group_count",
    f"WITH {DIRTY} SELECT segment, gender, count(*) AS count_score FROM dirty WHERE segment IS NOT NULL AND gender IS NOT NULL GROUP BY ALL",
)
def _(t: Tables):
    return ops.group(dirty(t), "count", "score", ["segment", "gender"])


@query(
    "agg13_cross_tab_sum",
    "SELECT l_returnflag, l_linestatus, round_even(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY ALL",
)
def _(t: Tables):
    return ops.cross_tab(t.lineitem, "sum", "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query(
    "agg13_cross_tab_wide",
    """SELECT o_orderpriority, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0)::DECIMAL(18, 2)::DOUBLE AS F,
  coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0)::DECIMAL(18, 2)::DOUBLE AS O FROM orders GROUP BY 1""",
)
def _(t: Tables):
    wide = ops.cross_tab_wide(t.orders, "sum", "o_totalprice", "o_orderpriority", "o_orderstatus", ["F", "O"])
    return wide.select("o_orderpriority", F.bround("F", 2).alias("F"), F.bround("O", 2).alias("O"))


@query(
    "agg14_cross_tab_mean",
    "SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY ALL",
)
def _(t: Tables):
    return ops.cross_tab(t.lineitem, "mean", "l_quantity", ["l_returnflag", "l_linenumber"], "mean_qty").withColumn(
        "mean_qty", F.round("mean_qty", 6)
    )


@query("agg15_cross_tab_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(t: Tables):
    return ops.cross_tab(t.orders, "count", "o_orderkey", ["o_orderstatus", "o_orderpriority"], "n")


QUARTER = """SELECT year({d}) || 'Q' || quarter({d}) AS quarter, {v} AS {n},
  strftime(date_trunc('quarter', {d}), '%Y-%m-%d') AS period_start FROM {t} WHERE {d} IS NOT NULL GROUP BY ALL"""


@query(
    "agg16_quarterly_sum",
    QUARTER.format(d="o_orderdate", v="round_even(sum(o_totalprice), 2)", n="quarterly_sum_o_totalprice", t="orders"),
)
def _(t: Tables):
    return ops.quarterly(t.orders, "sum", "o_totalprice", "o_orderdate")


@query("agg17_quarterly_mean", QUARTER.format(d="l_shipdate", v="round(avg(l_quantity), 6)", n="mean_qty", t="lineitem"))
def _(t: Tables):
    return ops.quarterly(t.lineitem, "mean", "l_quantity", "l_shipdate", "mean_qty").withColumn("mean_qty", F.round("mean_qty", 6))


@query(
    "agg18_quarterly_count_text_dates",
    f"WITH {LEDGER}, d AS (SELECT idx, TRY_CAST(voucher_date AS DATE) AS vd FROM ledger) "
    + QUARTER.format(d="vd", v="count(*)", n="quarterly_count_idx", t="d"),
)
def _(t: Tables):
    return ops.quarterly(ledger(t), "count", "idx", "voucher_date")


_PCT = "SELECT round_even(100.0 * n / d, 2) AS {n}, n AS {n}_numerator, d AS {n}_denominator FROM (SELECT {s} FROM {t})"


@query(
    "agg19_conditional_percentage_of_all",
    _PCT.format(n="pct_o_orderstatus_f", t="orders", s="count(*) FILTER (o_orderstatus = 'F') AS n, count(*) AS d"),
)
def _(t: Tables):
    return ops.conditional_percentage(t.orders, "o_orderstatus", "F")


@query(
    "agg19_conditional_percentage_of_part",
    f"WITH {DIRTY} "
    + _PCT.format(
        n="female_share", t="dirty",
        s="count(*) FILTER (lower(trim(gender)) = 'female' AND lower(trim(segment)) = 'building') AS n, "
        "count(*) FILTER (lower(trim(segment)) = 'building') AS d",
    ),
)
def _(t: Tables):
    return ops.conditional_percentage(dirty(t), "gender", "Female", "segment", " BUILDING", "Female Share")


@query(
    "agg20_plan_independent",
    """SELECT (SELECT round_even(sum(l_extendedprice), 2) FROM lineitem) AS sum_l_extendedprice,
  (SELECT count(*) FROM (SELECT DISTINCT l_returnflag FROM lineitem)) AS groups, (SELECT max(l_quantity) FROM lineitem) AS max_l_quantity""",
)
def _(t: Tables):
    plan = [
        {"type": "sum", "column": "l_extendedprice"},
        {"type": "group_sum", "column": "l_quantity", "group_by": ["l_returnflag"]},
        {"type": "max", "column": "l_quantity"},
    ]
    _table, (total, grouped, most) = ops.calculate_all(t.lineitem, plan)
    groups = grouped.df.agg(F.count(F.lit(1)).alias("groups")).scalar()
    return total.df.select("*", groups.alias("groups"), most.df.scalar().alias("max_l_quantity"))


@query(
    "agg20_plan_chained",
    """SELECT round_even(max(s), 2) AS max_sum_o_totalprice FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)""",
)
def _(t: Tables):
    plan = [
        {"type": "group_sum", "column": "o_totalprice", "group_by": ["o_custkey"]},
        {"type": "max", "column": "sum_o_totalprice"},
    ]
    return ops.calculate_all(t.orders, plan, chained=True)[1][1].df


@query(
    "agg21_result_contract",
    """SELECT * FROM (VALUES
  (0, 'o_orderpriority', 'O Orderpriority', 'string', 'dimension', NULL, NULL, 'series', 'categorical_series', (SELECT count(*) < 0 FROM orders)),
  (1, 'sum_o_totalprice', 'Sum O Totalprice', 'number', 'measure', 'INR', 'group_sum', 'series', 'categorical_series', false))
  AS v(position, id, label, data_type, role, unit, aggregation, result_kind, data_shape, nullable)""",
)
def _(t: Tables):
    op = {"type": "group_sum", "column": "o_totalprice", "group_by": ["o_orderpriority"]}
    return contract.result_fields(ops.calculate(t.orders, op).df, op)


@query(
    "agg21_result_preview",
    "SELECT count(*) AS n FROM (SELECT l_orderkey, sum(l_quantity) FROM lineitem GROUP BY 1 LIMIT 1000)",
)
def _(t: Tables):
    grouped = ops.group(t.lineitem, "sum", "l_quantity", ["l_orderkey"])
    return contract.preview(grouped).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg22_units",
    "SELECT 'INR' AS o_totalprice, NULL::VARCHAR AS o_custkey, 'percent' AS discount_rate, count(*) AS n FROM orders",
)
def _(t: Tables):
    from tidemark.functions.names import unit_of

    shown = [F.lit(unit_of(c)).cast("string").alias(c) for c in ("o_totalprice", "o_custkey", "discount_rate")]
    return t.orders.agg(*shown, F.count(F.lit(1)).alias("n"))
