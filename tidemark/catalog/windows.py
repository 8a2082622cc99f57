"""WIN: ordered and row-wise calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, dirty
from tidemark.operators import calculations as ops
from tidemark.operators import ordered

catalog = Catalog()
query = catalog.query

_RUN = "sum({v}) OVER (PARTITION BY {p} ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "win1_running_total_partitioned",
    "SELECT o_orderkey, round_even(" + _RUN.format(v="o_totalprice", p="o_orderstatus", o="o_orderdate, o_orderkey")
    + ", 2) AS running_total_o_totalprice FROM orders",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    out = ops.running_total(df, "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    return out.select("o_orderkey", "running_total_o_totalprice")


@query(
    "win1_running_total_global",
    "SELECT o_orderkey, round_even(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return ops.running_total(df, "o_totalprice", ["o_orderdate", "o_orderkey"], output="total").select("o_orderkey", "total")


@query(
    "win1_running_total_nulls",
    f"""WITH {DIRTY} SELECT cust_id, CASE WHEN score IS NOT NULL AND segment IS NOT NULL THEN
  round_even(sum(score) OVER (PARTITION BY segment ORDER BY cust_id ROWS UNBOUNDED PRECEDING), 2) END AS total FROM dirty""",
)
def _(t: Tables):
    return ops.running_total(dirty(t).select("cust_id", "segment", "score"), "score", ["cust_id"], ["segment"], "total").select(
        "cust_id", "total"
    )


_FILLED = "last_value({v} IGNORE NULLS) OVER (PARTITION BY {p} ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND {e})"


@query(
    "win2_percentage_change",
    f"""WITH {DIRTY}, f AS (SELECT cust_id, segment, {_FILLED.format(v='score', p='segment', o='cust_id', e='CURRENT ROW')} AS now,
  {_FILLED.format(v='score', p='segment', o='cust_id', e='1 PRECEDING')} AS before FROM dirty)
  SELECT cust_id, CASE WHEN segment IS NOT NULL THEN round(now / nullif(before, 0) - 1, 9) END AS change FROM f""",
)
def _(t: Tables):
    df = dirty(t).select("cust_id", "segment", "score")
    out = ops.percentage_change(df, "score", ["cust_id"], ["segment"], "change")
    return out.select("cust_id", F.round("change", 9).alias("change"))


@query(
    "win2_percentage_change_global",
    "SELECT o_orderkey, round(o_totalprice / lag(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey) - 1, 9) AS change FROM orders",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    out = ops.percentage_change(df, "o_totalprice", ["o_orderdate", "o_orderkey"], output="change")
    return out.select("o_orderkey", F.round("change", 9).alias("change"))


@query("win3_difference", f"WITH {DIRTY} SELECT cust_id, round_even(balance - score, 2) AS balance_gap FROM dirty")
def _(t: Tables):
    return ops.difference(dirty(t), "balance", "score", "balance_gap").select("cust_id", "balance_gap")


@query("win4_ratio", "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS ratio_l_tax_l_discount FROM lineitem")
def _(t: Tables):
    return ops.ratio(t.lineitem, "l_tax", "l_discount").select("l_orderkey", "l_linenumber", "ratio_l_tax_l_discount")


@query("win4_zero_denominators", "SELECT count(*) FILTER (l_discount = 0) AS zero_denominators FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(ops.zero_denominators("l_discount").alias("zero_denominators"))


@query("win5_absolute_value", "SELECT c_custkey, abs(c_acctbal) AS size FROM customer")
def _(t: Tables):
    return ops.absolute(t.customer, "c_acctbal", "size").select("c_custkey", "size")


@query(
    "win6_partition_hints",
    """SELECT column_name AS "column" FROM (SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS d, count(*) AS n FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders) WHERE d > 1 AND d < n * 0.5""",
)
def _(t: Tables):
    return ops.partition_hints(t.orders, "o_totalprice", ["o_orderdate"]).select("column")


@query(
    "win10_record_index",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS record_index FROM orders",
)
def _(t: Tables):
    df = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return ordered.row_index(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "record_index")


@query(
    "win10_record_index_hot_key",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS record_index FROM lineitem""",
)
def _(t: Tables):
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    out = ordered.row_index(t.lineitem.select("l_returnflag", *order), ["l_returnflag"], order)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "record_index")
