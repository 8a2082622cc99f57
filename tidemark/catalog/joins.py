"""JOI, SRT, SET and the lookups of WIN: joins, unions, sorting, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import COMMENTS, JOBS, USERS, comments, jobs, users
from tidemark.operators import kpi, ordered
from tidemark.operators import tables as ops

catalog = Catalog()
query = catalog.query


@query("joi1_rows_of_jobs", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t: Tables):
    return ops.children_of(t.orders, t.lineitem, "o_orderkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "joi2_left_outer",
    "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
)
def _(t: Tables):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "o_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "joi3_count_of_children",
    """SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS row_count FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def _(t: Tables):
    return ops.with_child_count(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select("o_orderkey", "o_orderstatus", "row_count")


@query(
    "joi4_manager_counts",
    f"""WITH {USERS} SELECT m.id, m.full_name, count(e.id) AS employee_count FROM users m
  LEFT JOIN users e ON e.manager_id = m.id WHERE m.role = 'manager' GROUP BY 1, 2""",
)
def _(t: Tables):
    return ops.manager_counts(users(t)).select("id", "full_name", "employee_count")


@query("joi5_semi_join", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t: Tables):
    return ops.having(t.orders, t.customer.filter("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey")


@query(
    "joi6_first_comment",
    f"""WITH {JOBS}, {COMMENTS} SELECT id, message, created_at FROM (
  SELECT id, message, created_at, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, message DESC) AS rn
  FROM jobs JOIN comments ON submission_id = id) WHERE rn = 1""",
)
def _(t: Tables):
    order = [F.desc("created_at"), F.desc("message")]
    return ops.with_first_child(jobs(t), comments(t), "id", "submission_id", order, ["message", "created_at"]).select(
        "id", "message", "created_at"
    )


@query(
    "joi7_exists",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
def _(t: Tables):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return ops.having(t.customer, urgent, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(
    "joi8_lookup",
    """SELECT o_orderkey, c_name AS uploader_name, n_name AS nation FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t: Tables):
    named = ops.lookup(t.orders, t.customer, "o_custkey", "c_custkey", {"c_name": "uploader_name", "c_nationkey": "nk"})
    return ops.lookup(named, t.nation, "nk", "n_nationkey", {"n_name": "nation"}).select("o_orderkey", "uploader_name", "nation")


# --- sets ---------------------------------------------------------------------------------------


@query(
    "set1_concat",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS nation FROM customer
  UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""",
)
def _(t: Tables):
    a = t.customer.selectExpr("c_custkey as id", "c_name as name", "c_acctbal as balance")
    b = t.supplier.selectExpr("s_suppkey as id", "s_name as name", "s_nationkey as nation")
    return ops.concat([a, b])


@query(
    "set2_value_union",
    "SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem UNION SELECT c_custkey FROM customer",
)
def _(t: Tables):
    return ops.value_union([t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey"), t.customer.select("c_custkey")], "k")


@query(
    "set3_timeline_union",
    """SELECT o_orderkey AS id, o_orderdate AS at, 'ordered' AS action FROM orders
  UNION ALL SELECT l_orderkey, l_shipdate, 'shipped' FROM lineitem UNION ALL SELECT event_id, ts, event_type FROM events""",
)
def _(t: Tables):
    a = t.orders.selectExpr("o_orderkey as id", "o_orderdate as at", "'ordered' as action")
    b = t.lineitem.selectExpr("l_orderkey as id", "l_shipdate as at", "'shipped' as action")
    c = t.events.selectExpr("event_id as id", "ts as at", "event_type as action")
    return a.unionByName(b).unionByName(c).orderBy("at", "id", "action")


@query("set4_modified_columns", "SELECT 'o_custkey,owner' AS modified, count(*) AS n FROM orders")
def _(t: Tables):
    from tidemark.operators.columns import modified_columns

    after = t.orders.withColumnRenamed("o_custkey", "owner")
    return after.agg(
        F.lit(",".join(modified_columns(t.orders.columns, after.columns))).alias("modified"), F.count("owner").alias("n")
    )


# --- order --------------------------------------------------------------------------------------


@query("srt1_sort", "SELECT * FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey")
def _(t: Tables):
    return ops.sort(t.orders, [("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")])


@query("srt2_limit", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 137)")
def _(t: Tables):
    return t.lineitem.limit(137).agg(F.count(F.lit(1)).alias("n"))


@query("srt3_newest", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def _(t: Tables):
    return ops.newest(t.orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 200)


@query("srt4_largest_groups", "SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1 ORDER BY size DESC, o_custkey LIMIT 6")
def _(t: Tables):
    return ops.largest_groups(t.orders, "o_custkey")


@query(
    "srt5_listed_order",
    """SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END,
  event_id""",
)
def _(t: Tables):
    order = [ops.listed_first(F.col("event_type"), ["error", "purchase"]), F.col("event_id")]
    return t.events.select("event_id", "event_type").orderBy(*order)


MIXED = "case when o_orderkey % 9 = 0 then null when o_orderkey % 4 = 0 then cast(o_custkey as {s}) when o_orderkey % 4 = 1 then {d} else o_orderpriority end"


@query(
    "srt6_mixed_sort",
    f"""SELECT row_number() OVER (ORDER BY CASE WHEN v IS NULL THEN 0 WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1
  WHEN try_strptime(v, '%Y-%m-%d') IS NOT NULL THEN 2 ELSE 3 END, TRY_CAST(v AS DOUBLE), try_strptime(v, '%Y-%m-%d'), lower(v), o_orderkey) AS place,
  o_orderkey, v FROM (SELECT o_orderkey, {MIXED.format(s='VARCHAR', d="strftime(o_orderdate, '%Y-%m-%d')")} AS v FROM orders)""",
)
def _(t: Tables):
    v = F.expr(MIXED.format(s="string", d="date_format(o_orderdate, 'yyyy-MM-dd')"))
    df = t.orders.select("o_orderkey", v.alias("v"))
    keyed = df.withColumns({f"k{i}": k for i, k in enumerate(ops.mixed_key(F.col("v")))})
    keys = [c for c in keyed.columns if c.startswith("k")]
    return ordered.row_index(keyed, [], [*keys, "o_orderkey"], "place").select("place", "o_orderkey", "v")


# --- latest, first, versions, pages -------------------------------------------------------------


@query(
    "win7_latest_per_key",
    """SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",
)
def _(t: Tables):
    return kpi.latest_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(
        "user_id", "event_id", "event_type", "ts"
    )


@query(
    "win8_first_per_key_capped",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25""",
)
def _(t: Tables):
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    first = kpi.latest_per_key(t.orders, ["o_custkey"], order)
    return ops.newest(first, order, 25).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "win9_version_lineage",
    f"""WITH {JOBS}, v AS (SELECT id, coalesce(parent_id, id) AS root_id, id % 10 + 1 AS version_number FROM jobs)
  SELECT id, root_id, version_number, max(version_number) OVER (PARTITION BY root_id) + 1 AS next_version FROM v""",
)
def _(t: Tables):
    versions = jobs(t).selectExpr("id", "parent_id", "id % 10 + 1 as version_number")
    return ops.lineage(versions).select("id", "root_id", "version_number", "next_version")


@query("win11_page", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 150")
def _(t: Tables):
    return ops.page(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50)


@query("win11_deep_page", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 1000")
def _(t: Tables):
    return ops.Pages(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")]).page(20, 50)


