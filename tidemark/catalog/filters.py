"""FLT: filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, USERS, dirty, users
from tidemark.operators import filters as ops
from tidemark.plans.run import filter_prepared

catalog = Catalog()
query = catalog.query


def where(condition: str) -> str:
    return f"WITH {DIRTY} SELECT cust_id, full_name, segment, money, score, gender FROM dirty WHERE {condition}"


def filtered(t: Tables, *conditions: dict, **options):
    df = dirty(t).select("cust_id", "full_name", "segment", "money", "score", "gender")
    return ops.apply_filter(df, list(conditions), **options)


def c(column: str, operator: str, value=None, **more) -> dict:
    return {"column": column, "operator": operator, "value": value, **more}


SEG = "lower(trim(segment))"

SIMPLE = {
    "flt1_eq_text": (c("segment", "eq", " Machinery "), f"{SEG} = 'machinery'"),
    "flt1_eq_case_sensitive": (c("segment", "eq", "MACHINERY", case_sensitive=True), "segment = 'MACHINERY'"),
    "flt1_eq_number": (c("cust_id", "eq", 77), "cust_id = 77"),
    "flt2_neq_keeps_nulls": (c("segment", "neq", "machinery"), f"{SEG} <> 'machinery' OR segment IS NULL"),
    "flt3_gt": (c("score", "gt", 5000), "score > 5000"),
    "flt4_gte": (c("score", ">=", 5000.5), "score >= 5000.5"),
    "flt5_lt": (c("score", "less_than", 0), "score < 0"),
    "flt6_lte": (c("score", "lte", 100), "score <= 100"),
    "flt7_contains": (c("full_name", "contains", "#00000001"), "contains(full_name, '#00000001')"),
    "flt8_not_contains": (c("segment", "not_contains", "B"), "NOT contains(lower(segment), 'b') OR segment IS NULL"),
    "flt9_starts_with": (c("segment", "starts_with", "mach"), "starts_with(lower(segment), 'mach')"),
    "flt10_ends_with": (c("full_name", "ends_with", "7"), "suffix(lower(full_name), '7')"),
    "flt11_between": (c("score", "between", 100, value_to=2000), "score BETWEEN 100 AND 2000"),
    "flt12_in_normalized": (
        c("segment", "in", ["mach-inery", "Build ing"]),
        "regexp_replace(lower(segment), '[^a-z0-9]+', '', 'g') IN ('machinery', 'building')",
    ),
    "flt12_in_numbers": (c("cust_id", "in", [1, 5, 900, 1400]), "cust_id IN (1, 5, 900, 1400)"),
    "flt13_not_in": (
        c("segment", "not_in", ["machinery", "BUILDING"]),
        "regexp_replace(lower(segment), '[^a-z0-9]+', '', 'g') NOT IN ('machinery', 'building') OR segment IS NULL",
    ),
    "flt14_is_null": (c("full_name", "is_null"), "full_name IS NULL"),
    "flt15_is_not_null": (c("full_name", "notnull"), "full_name IS NOT NULL"),
}

for _name, (_condition, _sql) in SIMPLE.items():

    @query(_name, where(_sql))
    def _(t: Tables, condition=_condition):
        return filtered(t, condition)


@query("flt3_gt_date", "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01'")
def _(t: Tables):
    return ops.apply_filter(t.orders, [c("o_orderdate", "gt", "1998-06-01")])


@query("flt7_contains_documents", "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), ' the ')")
def _(t: Tables):
    return ops.apply_filter(t.documents, [c("text", "contains", " THE ")], select=["doc_id", "lang", "source"])


_MANY = "SELECT {cols} FROM orders WHERE {neg} EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 4000)"


@query("flt12_in_table", _MANY.format(cols="o_orderkey, o_custkey", neg=""))
def _(t: Tables):
    wanted = t.customer.filter("c_acctbal > 4000").select("c_custkey")
    return ops.filter_by_values(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", wanted)


@query(
    "flt12_in_table_text",
    f"""WITH {DIRTY} SELECT cust_id, segment FROM dirty WHERE regexp_replace(lower(segment), '[^a-z0-9]+', '', 'g') IN (
  SELECT regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '', 'g') FROM customer WHERE c_mktsegment LIKE '%I%')""",
)
def _(t: Tables):
    wanted = t.customer.filter("c_mktsegment like '%I%'").select("c_mktsegment")
    return ops.filter_by_values(dirty(t).select("cust_id", "segment"), "segment", wanted)


@query("flt13_not_in_table", _MANY.format(cols="o_orderkey, o_custkey", neg="NOT"))
def _(t: Tables):
    wanted = t.customer.filter("c_acctbal > 4000").select("c_custkey")
    return ops.filter_by_values(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", wanted, negate=True)


@query(
    "flt16_and_select_limit",
    f"WITH {DIRTY} SELECT count(*) AS n, 25 AS shown FROM (SELECT * FROM dirty WHERE score > 100 AND {SEG} = 'machinery' LIMIT 25)",
)
def _(t: Tables):
    df = filtered(t, c("score", "gt", 100), c("segment", "eq", "machinery"), select=["cust_id", "segment"], limit=25)
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(25).alias("shown"))


@query("flt16_or", where(f"score < 0 OR {SEG} = 'machinery'"))
def _(t: Tables):
    return filtered(t, c("score", "lt", 0), c("segment", "eq", "machinery"), logic="or")


@query(
    "flt17_grouped_negated",
    where(f"coalesce(score > 1000, false) AND NOT coalesce({SEG} = 'machinery' OR contains(lower(gender), 'female'), false)"),
)
def _(t: Tables):
    tree = {
        "all": [
            c("score", "gt", 1000),
            {"any": [c("segment", "eq", "machinery"), c("gender", "contains", "female")], "negated": True},
        ]
    }
    df = dirty(t).select("cust_id", "full_name", "segment", "money", "score", "gender")
    return ops.apply_filter(df, tree)


@query("flt18_drop_mode", where(f"NOT coalesce(score > 1000 AND {SEG} = 'machinery', false)"))
def _(t: Tables):
    return filtered(t, c("score", "gt", 1000), c("segment", "eq", "machinery"), mode="drop")


AGGREGATES = {
    "avg": "avg({x})", "sum": "sum({x})", "min": "min({x})", "max": "max({x})",
    "median": "median({x})", "count": "count({x})", "std": "stddev_samp({x})",
}

for _fn, _sql in AGGREGATES.items():

    @query(
        f"flt19_against_{_fn}",
        f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice {'<' if _fn == 'sum' else '>='} (SELECT {_sql.format(x='o_totalprice')} FROM orders)",
    )
    def _(t: Tables, fn=_fn):
        operator = "lt" if fn == "sum" else "gte"
        return ops.apply_filter(t.orders, [c("o_totalprice", operator, {"function": fn})], select=["o_orderkey", "o_totalprice"])


@query(
    "flt19_above_conditional_avg",
    f"""WITH {DIRTY}, m AS (SELECT *, TRY_CAST(replace(replace(money, '$', ''), ',', '') AS DOUBLE) AS v FROM dirty)
  SELECT cust_id, money FROM m WHERE v > (SELECT avg(v) FROM m WHERE lower(trim(gender)) = 'female')""",
)
def _(t: Tables):
    value = {"function": "avg", "where": {"column": "gender", "value": "Female"}}
    return ops.apply_filter(dirty(t), [c("money", "gt", value)], select=["cust_id", "money"])


@query("flt20_value_rules", "SELECT 4 AS refused, count(*) AS rows FROM orders")
def _(t: Tables):
    from tidemark.errors import PlanError

    wrong = [
        c("o_custkey", "in", 5), c("o_custkey", "between", 5), c("o_custkey", "eq"), c("o_orderstatus", "not_in", "F"),
    ]
    refused = 0
    for condition in wrong:
        try:
            ops.predicate(t.orders, condition)
        except PlanError:
            refused += 1
    return t.orders.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("rows"))


@query(
    "flt21_aliases",
    "SELECT count(*) FILTER (o_custkey = 7) AS eq, count(*) FILTER (o_custkey <> 7) AS neq, count(*) FILTER (o_custkey >= 7) AS gte, "
    "count(*) FILTER (o_custkey NOT IN (7, 8)) AS not_in, count(*) FILTER (o_custkey IN (7, 8)) AS in_ FROM orders",
)
def _(t: Tables):
    spelled = {"eq": ("==", 7), "neq": ("<>", 7), "gte": ("greater_than_or_equal", 7), "not_in": ("nin", [7, 8]), "in_": ("one_of", [7, 8])}
    return t.orders.agg(
        *[F.count_if(ops.predicate(t.orders, c("o_custkey", op, value))).alias(name) for name, (op, value) in spelled.items()]
    )


@query("flt22_type_check", "SELECT 2 AS refused, count(*) AS rows FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-12-31'")
def _(t: Tables):
    from tidemark.errors import PlanError

    refused = 0
    for condition in (c("o_orderstatus", "gt", "A"), c("o_orderpriority", "between", "a", value_to="b")):
        try:
            ops.check(t.orders, condition)
        except PlanError:
            refused += 1
    kept = ops.apply_filter(t.orders, [c("o_orderdate", "between", "1996-01-01", value_to="1996-12-31")])
    return kept.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("rows"))


@query(
    "flt23_row_search",
    "SELECT event_id, props FROM events WHERE contains(lower(event_type), 'purch') OR contains(lower(props), 'purch')",
)
def _(t: Tables):
    return ops.row_search(t.events.select("event_id", "event_type", "props"), "PURCH").select("event_id", "props")


@query(
    "flt24_columns_search",
    "SELECT * FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')) AND p_type = 'ECONOMY'",
)
def _(t: Tables):
    return ops.columns_search(t.part, ["p_name", "p_brand"], "Red", {"p_type": "ECONOMY"})


@query(
    "flt25_newest_like",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority ILIKE '%high%' OR o_orderstatus ILIKE '%high%' "
    "ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500",
)
def _(t: Tables):
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    found = ops.newest_like(t.orders, ["o_orderpriority", "o_orderstatus"], "high", order, 500)
    return found.select("o_orderkey", "o_orderdate")


@query("flt26_time_range", "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def _(t: Tables):
    return ops.time_range(t.events, "ts", "2024-01-10", "2024-01-20 12:00:00")


@query("flt27_scope_employee", "SELECT * FROM orders WHERE o_custkey = 12")
def _(t: Tables):
    return ops.owner_scope(t.orders, "o_custkey", "employee", 12)


@query(
    "flt27_scope_manager",
    f"WITH {USERS} SELECT * FROM orders WHERE o_custkey IN (SELECT id FROM users WHERE manager_id = 11)",
)
def _(t: Tables):
    return ops.owner_scope(t.orders, "o_custkey", "manager", 11, users(t))


@query("flt27_scope_admin", "SELECT * FROM orders")
def _(t: Tables):
    return ops.owner_scope(t.orders, "o_custkey", "admin", 0)


@query("flt_keep_values", f"WITH {DIRTY} SELECT cust_id, segment FROM dirty WHERE {SEG} = 'machinery' AND lower(trim(gender)) = 'female'")
def _(t: Tables):
    df = dirty(t).selectExpr("cust_id", "segment", "gender")
    conditions = [c("segment", "eq", "MACHINERY"), c("gender", "eq", "female")]
    return filter_prepared(df, conditions).select("cust_id", "segment")
