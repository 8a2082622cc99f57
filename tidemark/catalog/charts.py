"""CHT: chart-ready data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.operators import calculations
from tidemark.operators import charts as ops

catalog = Catalog()
query = catalog.query


@query("cht1_grouped_count", "SELECT o_orderpriority, count(*) AS count_o_orderpriority FROM orders GROUP BY 1")
def _(t: Tables):
    return ops.grouped(t.orders, "o_orderpriority")


@query("cht1_grouped_sum", "SELECT l_returnflag, round_even(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def _(t: Tables):
    df = ops.grouped(t.lineitem, "l_returnflag", "sum", "l_extendedprice", "total")
    return df.withColumn("total", F.bround("total", 2))


@query("cht1_grouped_mean", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean_p_retailprice FROM part GROUP BY 1")
def _(t: Tables):
    df = ops.grouped(t.part, "p_brand", "mean", "p_retailprice")
    return df.withColumn("mean_p_retailprice", F.round("mean_p_retailprice", 6))


FIELDS = """SELECT 0 AS position, 'order_id' AS id, 'integer' AS data_type, 'identifier' AS role
  UNION ALL SELECT 1, 'o_orderstatus', 'string', (SELECT CASE WHEN count(DISTINCT o_orderstatus) < 0.5 * count(*) THEN 'category' ELSE 'dimension' END FROM orders)
  UNION ALL SELECT 2, 'o_totalprice', 'float', 'measure' UNION ALL SELECT 3, 'o_orderdate', 'datetime', 'time'
  UNION ALL SELECT 4, 'label', 'string', (SELECT CASE WHEN count(DISTINCT o_orderkey) < 0.5 * count(*) THEN 'category' ELSE 'dimension' END FROM orders)"""


def _charted(t: Tables):
    return t.orders.selectExpr("o_orderkey as order_id", "o_orderstatus", "o_totalprice", "o_orderdate", "concat('n', o_orderkey) as label")


@query("cht2_fields", FIELDS)
def _(t: Tables):
    return ops.fields(_charted(t)).select("position", "id", "data_type", "role")


SHAPES = {
    "time_series": ["o_orderdate", "o_totalprice"],
    "categorical_series": ["o_orderstatus", "o_totalprice"],
    "histogram_bins": ["label", "o_totalprice"],
    "scalar": ["o_totalprice"],
}

for _shape, _columns in SHAPES.items():

    @query(
        f"cht3_shape_{_shape}",
        f"SELECT '{_shape}' AS data_shape, '{ops.AUTO_CHART.get(_shape, 'bar')}' AS chart FROM (SELECT count(*) FROM orders)",
    )
    def _(t: Tables, columns=_columns):
        return ops.data_shape(ops.fields(_charted(t).select(*columns)))


@query("cht3_shape_scatter_points", "SELECT 'scatter_points' AS data_shape, 'scatter' AS chart FROM (SELECT count(*) FROM lineitem)")
def _(t: Tables):
    return ops.data_shape(ops.fields(t.lineitem.select("l_quantity", "l_extendedprice")))


AXES = {"line": ("o_orderdate", "o_totalprice"), "pie": ("o_orderstatus", "o_totalprice"), "bar": ("o_orderstatus", "o_totalprice")}

for _chart, (_x, _y) in AXES.items():

    @query(f"cht4_axes_{_chart}", f"SELECT '{_chart}' AS chart, '{_x}' AS x, '{_y}' AS y FROM (SELECT count(*) FROM orders)")
    def _(t: Tables, chart=_chart):
        return ops.axes(ops.fields(_charted(t)), chart)


@query("cht4_axes_scatter", "SELECT 'scatter' AS chart, 'l_quantity' AS x, 'l_extendedprice' AS y FROM (SELECT count(*) FROM lineitem)")
def _(t: Tables):
    return ops.axes(ops.fields(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice")), "scatter")


@query(
    "cht5_line_fitness",
    "SELECT 'line' AS chart, count(DISTINCT o_orderdate) >= 2 AS valid, CASE WHEN count(DISTINCT o_orderdate) < 2 THEN 'line_incompatible_insufficient_x_values' END AS reason_code FROM orders",
)
def _(t: Tables):
    return ops.line_fitness(t.orders, "o_orderdate", "time")


@query(
    "cht5_line_refused",
    "SELECT 'line' AS chart, false AS valid, 'line_incompatible_insufficient_x_values' AS reason_code FROM (SELECT count(*) FROM orders)",
)
def _(t: Tables):
    return ops.line_fitness(t.orders.withColumn("x", F.lit(1)), "x", "dimension")


@query("cht6_bar_fitness", "SELECT 'bar' AS chart, count(*) >= 1 AS valid, NULL::VARCHAR AS reason_code FROM orders WHERE o_totalprice IS NOT NULL")
def _(t: Tables):
    return ops.bar_fitness(t.orders, ["o_orderstatus", "o_totalprice"], {"o_orderstatus": "category"})


@query(
    "cht7_pie_fitness",
    """SELECT 'pie' AS chart, min(s) >= 0 AND count(DISTINCT o_orderpriority) <= 12 AS valid, NULL::VARCHAR AS reason_code FROM (
  SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1)""",
)
def _(t: Tables):
    df = calculations.group(t.orders, "sum", "o_totalprice", ["o_orderpriority"])
    return ops.pie_fitness(df, df.columns, {"o_orderpriority": "category"})


@query(
    "cht7_pie_too_many",
    """SELECT 'pie' AS chart, count(DISTINCT o_custkey) <= 12 AS valid, CASE WHEN count(DISTINCT o_custkey) > 12 THEN 'pie_incompatible_too_many_categories' END AS reason_code FROM orders""",
)
def _(t: Tables):
    df = t.orders.select(F.col("o_custkey").cast("string").alias("customer"), "o_totalprice")
    return ops.pie_fitness(df, df.columns, {"customer": "dimension"})


@query("cht8_scatter_fitness", "SELECT 'scatter' AS chart, count(*) >= 2 AS valid, NULL::VARCHAR AS reason_code FROM lineitem")
def _(t: Tables):
    return ops.scatter_fitness(t.lineitem, ["l_quantity", "l_extendedprice"])


@query("cht9_histogram_fitness", "SELECT 'histogram' AS chart, count(l_quantity) >= 1 AS valid, NULL::VARCHAR AS reason_code FROM lineitem")
def _(t: Tables):
    return ops.histogram_fitness(t.lineitem, {"l_quantity": "measure", "l_returnflag": "category"})


@query(
    "cht9_histogram_bins",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
  c AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 10)) AS INTEGER) + 1, 10) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
  SELECT CAST(b AS INTEGER) AS bin, round(lo + (b - 1) * (hi - lo) / 10, 4) AS low, round(lo + b * (hi - lo) / 10, 4) AS high, coalesce(n, 0) AS n
  FROM range(1, 11) r(b) CROSS JOIN e LEFT JOIN c ON bin = b""",
)
def _(t: Tables):
    bins = ops.histogram_bins(t.orders, "o_totalprice", 10)
    return bins.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query(
    "cht10_newest_specs",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t: Tables):
    return ops.newest_specs(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")
