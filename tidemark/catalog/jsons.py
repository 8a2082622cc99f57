"""JSN and UDF: JSON, map and array functions, and user-defined ops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import JOBS, jobs
from tidemark.functions import jsons as ops
from tidemark.plans import registry
from tidemark.plans.run import apply_ops

catalog = Catalog()
query = catalog.query


@query("jsn1_field", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS absent FROM events")
def _(t: Tables):
    return t.events.select("event_id", ops.field(F.col("props"), "k").alias("k"), ops.field(F.col("props"), "z").alias("absent"))


def _payloads(t: Tables):
    """Line items as result payloads in all the shapes a result can have."""
    row = F.concat(
        F.lit('{"id": '), F.col("l_orderkey").cast("string"), F.lit(', "part": "'), F.col("l_partkey").cast("string"),
        F.lit('", "_line": '), F.col("l_linenumber").cast("string"), F.lit("}"),
    )
    listed = F.concat(F.lit("["), row, F.lit(", "), row, F.lit(', {"_only": 1}]'))
    shape = F.col("l_linenumber") % 7
    wrap = lambda key, more="": F.concat(F.lit("{"), F.lit(more), F.lit(f'"{key}": '), listed, F.lit("}"))
    payload = (
        F.when(shape == 0, F.concat(F.lit('{"cleaned_data": [], "rows": '), listed, F.lit("}")))
        .when(shape == 1, wrap("cleaned_data"))
        .when(shape == 2, wrap("cleaned_preview", '"record_count": 3, '))
        .when(shape == 3, wrap("cleaned_preview", '"record_count": 9, '))
        .when(shape == 4, wrap("records"))
        .when(shape == 5, F.concat(F.lit('{"records": [1, 2], "data": '), listed, F.lit("}")))
        .otherwise(F.lit('{"status": "done"}'))
    )
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", payload.alias("payload"))


@query(
    "jsn2_payload_rows",
    """SELECT l_orderkey, l_linenumber, CAST(unnest([0, 1]) AS INTEGER) AS pos, CAST(l_orderkey AS VARCHAR) AS id, CAST(l_partkey AS VARCHAR) AS part
  FROM lineitem WHERE l_linenumber % 7 IN (0, 1, 2, 4, 5)""",
)
def _(t: Tables):
    df = ops.explode_payload_rows(_payloads(t), "payload")
    return df.select("l_orderkey", "l_linenumber", "pos", F.col("row")["id"].alias("id"), F.col("row")["part"].alias("part"))


@query(
    "jsn3_merge_protected",
    """SELECT o_orderkey, 'intent_id=old' || chr(10) || 'note=' || o_orderstatus || chr(10) || 'status=new' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'zone=kept' ELSE '' END AS merged FROM orders""",
)
def _(t: Tables):
    old = F.create_map(F.lit("intent_id"), F.lit("old"), F.lit("status"), F.lit("before"))
    old = F.when(F.col("o_orderkey") % 2 == 0, F.map_concat(old, F.create_map(F.lit("zone"), F.lit("kept")))).otherwise(old)
    new = F.create_map(F.lit("intent_id"), F.lit("new"), F.lit("status"), F.lit("new"), F.lit("note"), F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", ops.stable_text(ops.merge_protected(old, new)).alias("merged"))


@query(
    "jsn4_stable_hash",
    """SELECT o_orderkey, sha256('[{"key":"a","value":"' || o_orderstatus || '"},{"key":"b"},{"key":"c","value":"' || o_custkey || '"}]') AS digest FROM orders""",
)
def _(t: Tables):
    m = F.create_map(
        F.lit("c"), F.col("o_custkey").cast("string"), F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.col("o_orderstatus"),
        F.lit("timestamp"), F.col("o_orderdate").cast("string"),
    )
    return t.orders.select("o_orderkey", ops.stable_hash(m, ("timestamp",)).alias("digest"))


@query(
    "jsn5_agent_summary",
    f"WITH {JOBS} SELECT id, CASE WHEN contains(summary, 'Orchestrator') THEN 'Plan ' || id ELSE '' END AS plan_summary FROM jobs",
)
def _(t: Tables):
    return jobs(t).select("id", ops.agent_summary(F.col("summary"), "orchestrator").alias("plan_summary"))


@query(
    "jsn6_reconcile_status",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2) AND l_discount > 0.05 THEN 'failed' WHEN l_returnflag = 'A' THEN 'quarantined'
  WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linenumber IN (1, 2) THEN 'succeeded' WHEN l_linenumber = 3 THEN 'running' ELSE NULL END AS status
  FROM lineitem WHERE l_linenumber <= 3
  UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem WHERE l_linenumber > 3""",
)
def _(t: Tables):
    code = F.expr("case l_linenumber when 1 then 'Complete' when 2 then ' succeeded ' when 3 then 'running' else 'odd' end")
    payload = F.expr("case l_returnflag when 'A' then 'quarantined' when 'R' then 'PARTIAL' else '' end")
    errors = F.when(F.col("l_discount") > 0.05, F.array(F.lit(" "), F.lit("bad"))).otherwise(F.array(F.lit(" ")))
    return t.lineitem.select("l_orderkey", "l_linenumber", ops.reconcile_status(code, payload, errors).alias("status"))


# --- user-defined ops ---------------------------------------------------------------------------


@query("udf1_registered_op", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice > 100000")
def _(t: Tables):
    registry.register_op("double_price", lambda df, o: df.withColumn("doubled", F.col(o["column"]) * 2), replace=True)
    plan = [
        {"type": "filter", "conditions": [{"column": "o_totalprice", "operator": "gt", "value": 100000}]},
        {"type": "double_price", "column": "o_totalprice"},
        {"type": "select_columns", "columns": ["o_orderkey", "doubled"]},
    ]
    return apply_ops(t.orders, plan, audit=False).df


@query("udf2_scalar_function", "SELECT c_custkey, length(c_name) - length(replace(c_name, '0', '')) AS zeros FROM customer")
def _(t: Tables):
    def zeros(names: pd.Series) -> pd.Series:
        return names.str.count("0").astype("int64")

    if "count_zeros" not in registry.known_ops():
        registry.scalar_op("count_zeros", zeros, "bigint")
    out = apply_ops(t.customer, [{"type": "count_zeros", "column": "c_name", "output": "zeros"}], audit=False).df
    return out.select("c_custkey", "zeros")


@query(
    "udf3_grouped_function",
    """SELECT conv_id, count(*) FILTER (role <> before) AS changes FROM (
  SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) GROUP BY 1""",
)
def _(t: Tables):
    def changes(pdf: pd.DataFrame) -> pd.DataFrame:
        role = pdf.sort_values(["turn", "role", "text"])["role"]
        turns = int((role != role.shift()).sum()) - 1
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "changes": [turns]})

    if "role_changes" not in registry.known_ops():
        registry.grouped_op("role_changes", changes, "conv_id bigint, changes bigint")
    return apply_ops(t.conversations, [{"type": "role_changes", "group_by": ["conv_id"]}], audit=False).df


@query(
    "plan_auto_prep",
    "SELECT lower(l_returnflag) AS l_returnflag, round_even(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem "
    "WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 45 GROUP BY 1",
)
def _(t: Tables):
    plan = [
        {
            "type": "filter",
            "conditions": [
                {"column": "l_returnflag", "operator": "in", "value": ["a", "r"]},
                {"column": "l_quantity", "operator": "between", "value": 5, "value_to": 45},
            ],
        },
        {"type": "calculate", "calculation": "group_sum", "column": "l_extendedprice", "group_by": ["l_returnflag"]},
    ]
    return apply_ops(t.lineitem, plan, auto_prep=True, audit=False).df


@query(
    "udf3_merged_function",
    """SELECT l_returnflag, count(*) AS n, round(geomean(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    """A geometric mean, as an example of a function that merges: three groups, of which none fits a task's share."""

    def partial(pdf: pd.DataFrame) -> dict:
        return {"n": len(pdf), "logs": float(np.log(pdf["l_quantity"]).sum())}

    def finish(states: pd.DataFrame) -> dict:
        n = int(states["n"].sum())
        return {"n": n, "mean": float(np.round(np.exp(states["logs"].sum() / n), 6))}

    if "geometric_mean" not in registry.known_ops():
        registry.merged_op("geometric_mean", partial, "n bigint, logs double", finish, "n bigint, mean double")
    return apply_ops(t.lineitem.select("l_returnflag", "l_quantity"), [{"type": "geometric_mean", "group_by": ["l_returnflag"]}], audit=False).df
