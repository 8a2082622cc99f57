"""COL: projection and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, dirty
from tidemark.functions import names
from tidemark.operators import columns as ops

catalog = Catalog()
query = catalog.query


@query("col1_project", "SELECT o_totalprice, o_orderkey FROM orders")
def _(t: Tables):
    return ops.project(t.orders, ["o_totalprice", "o_orderkey"])


@query("col2_drop", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(t: Tables):
    return ops.drop(t.orders, ["o_custkey", "o_orderpriority"])


@query("col3_rename", "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    return ops.rename(t.customer, {"c_custkey": "id", "c_name": "name", "absent": "x"})


@query("col4_reorder", "SELECT p_size, p_name, p_partkey, p_brand, p_type, p_retailprice FROM part")
def _(t: Tables):
    return ops.reorder(t.part, ["p_size", "absent", "p_name"])


MIXED = ["Order ID", "customerName", "  Total-Amount ", "orderDate"]


def _mixed(t: Tables):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate").toDF(*MIXED)


def _mixed_sql(new: list[str]) -> str:
    old = ["o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"]
    return "SELECT " + ", ".join(f'{a} AS "{b}"' for a, b in zip(old, new)) + " FROM orders"


@query("col5_names_snake_case", _mixed_sql(["order_id", "customer_name", "total_amount", "order_date"]))
def _(t: Tables):
    return ops.normalize_names(_mixed(t))


@query("col5_names_lowercase", _mixed_sql(["order id", "customername", "total-amount", "orderdate"]))
def _(t: Tables):
    return ops.normalize_names(_mixed(t), "lowercase")


@query("col5_names_camel_case", _mixed_sql(["orderId", "customerName", "totalAmount", "orderDate"]))
def _(t: Tables):
    return ops.normalize_names(_mixed(t), "camel_case")


@query("col5_names_pascal_case", _mixed_sql(["OrderId", "CustomerName", "TotalAmount", "OrderDate"]))
def _(t: Tables):
    return ops.normalize_names(_mixed(t), "pascal_case")


@query("col6_drop_empty_columns", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t: Tables):
    hollow = t.supplier.withColumn("notes", F.lit(None).cast("string")).withColumn(
        "rate", F.when(F.col("s_suppkey") < 0, F.col("s_acctbal"))
    )
    return ops.drop_empty(hollow)


@query(
    "col7_column_macros",
    "SELECT upper(o_orderstatus) AS o_orderstatus, upper(o_orderpriority) AS o_orderpriority, "
    "o_orderkey + 1 AS o_orderkey, o_custkey + 1 AS o_custkey, o_totalprice + 1 AS o_totalprice FROM orders",
)
def _(t: Tables):
    texts = names.expand(t.orders, names.ALL_TEXT)
    numbers = names.expand(t.orders, names.ALL_NUMERIC)
    return t.orders.select(*[F.upper(c).alias(c) for c in texts], *[(F.col(c) + 1).alias(c) for c in numbers])


@query("col8_column_family", "SELECT l_linenumber AS loan_no, l_quantity AS loan_amount, l_tax AS loans FROM lineitem")
def _(t: Tables):
    df = t.lineitem.selectExpr(
        "l_orderkey as age", "l_linenumber as loan_no", "l_quantity as loan_amount", "l_tax as loans", "l_discount as alone"
    )
    return ops.family(df, "loans")


@query(
    "col9_missing_columns",
    "SELECT 'absent, gone' AS missing, count(*) AS row_count FROM orders",
)
def _(t: Tables):
    from tidemark.errors import MissingColumnError

    try:
        ops.project(t.orders, ["o_orderkey", "absent", "gone"])
        missing = ""
    except MissingColumnError as error:
        missing = ", ".join(error.missing)
    return t.orders.agg(F.lit(missing).alias("missing"), F.count(F.lit(1)).alias("row_count"))


@query(
    "col10_hide_internal",
    f"WITH {DIRTY} SELECT full_name, segment FROM dirty WHERE full_name IS NOT NULL OR segment IS NOT NULL",
)
def _(t: Tables):
    df = dirty(t).selectExpr("full_name", "segment", "cust_id as _source", "balance as _confidence")
    return ops.hide_internal(df)


@query(
    "col10_hide_internal_keys",
    "SELECT event_id, event_type AS visible FROM events WHERE event_type <> 'error'",
)
def _(t: Tables):
    m = F.when(F.col("event_type") == "error", F.create_map(F.lit("_a"), F.lit("x"))).otherwise(
        F.create_map(F.lit("_a"), F.lit("x"), F.lit("kind"), F.col("event_type"))
    )
    df = ops.hide_internal_keys(t.events.select("event_id", m.alias("row")), "row")
    return df.select("event_id", F.array_join(F.map_values("row"), ",").alias("visible"))


@query(
    "col11_canonical_names",
    "SELECT o_orderkey AS transaction_id, o_orderstatus AS status, o_totalprice AS payment_value, "
    "o_orderdate AS transaction_date, o_orderpriority AS priority FROM orders",
)
def _(t: Tables):
    df = t.orders.selectExpr(
        "o_orderkey as txn_id", "o_orderstatus as `Order State`", "o_totalprice as total_amount",
        "o_orderdate as posting_date", "o_orderpriority as priority",
    )
    return ops.canonical_names(df)
