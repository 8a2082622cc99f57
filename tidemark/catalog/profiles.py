"""PRF: column and table profiles, semantic types, roles, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, LEDGER, dirty, ledger
from tidemark.operators import fingerprints, profile, semantics

catalog = Catalog()
query = catalog.query

ORDER_COLUMNS = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text",
    "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "text",
}


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        number, when, words = kind == "number", kind == "date", kind == "text"
        stamp = "strftime({f}({c}), '%Y-%m-%dT%H:%M:%S')"
        rows.append(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS null_count, count({c}) AS non_null_count,
  count(DISTINCT {c}) AS distinct_count, {f'CAST(min({c}) AS DOUBLE)' if number else 'NULL::DOUBLE'} AS numeric_min,
  {f'CAST(max({c}) AS DOUBLE)' if number else 'NULL::DOUBLE'} AS numeric_max,
  {stamp.format(f='min', c=c) if when else 'NULL::VARCHAR'} AS date_min, {stamp.format(f='max', c=c) if when else 'NULL::VARCHAR'} AS date_max,
  {f'round(avg(length({c})), 6)' if words else 'NULL::DOUBLE'} AS average_text_length FROM {table}"""
        )
    return " UNION ALL ".join(rows)


PROFILE_SHOWN = [
    "column", "null_count", "non_null_count", "distinct_count", "numeric_min", "numeric_max", "date_min", "date_max",
]


def _profiled(df):
    return profile.profile_columns(df).select(*PROFILE_SHOWN, F.round("average_text_length", 6).alias("average_text_length"))


@query("prf1_column_profile", _profile_sql("orders", ORDER_COLUMNS))
def _(t: Tables):
    return _profiled(t.orders)


@query(
    "prf1_column_profile_nulls",
    f"WITH {DIRTY} " + _profile_sql("dirty", {"cust_id": "number", "full_name": "text", "segment": "text", "score": "number", "gender": "text"}),
)
def _(t: Tables):
    return _profiled(dirty(t).select("cust_id", "full_name", "segment", "score", "gender"))


@query(
    "prf1_column_profile_documents",
    _profile_sql("documents", {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"}),
)
def _(t: Tables):
    return _profiled(t.documents)


@query(
    "prf2_table_profile",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, 3::BIGINT AS column_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count FROM (
  SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def _(t: Tables):
    return profile.table_profile(t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag"))


SAMPLED = {"segment": "dirty", "gender": "dirty", "nation_id": "dirty"}


def _samples_sql(order: str) -> str:
    rows = [
        f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY {order.format(c=c)}) AS INTEGER) AS rank, v AS value, n FROM (
  SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, min(cust_id) AS first_at FROM dirty WHERE {c} IS NOT NULL GROUP BY 1)
  QUALIFY rank <= 3"""
        for c in SAMPLED
    ]
    return f"WITH {DIRTY} " + " UNION ALL ".join(f"({r})" for r in rows)


SAMPLE_ORDERS = {
    "prf3_representative_values": ("representative", "first_at, v"),
    "prf4_frequent_values": ("frequent", "n DESC, v"),
    "prf5_random_values": ("random", "sha256('{c}::' || v)"),
    "prf6_rare_values": ("rare", "n, v"),
}

for _name, (_kind, _order) in SAMPLE_ORDERS.items():

    @query(_name, _samples_sql(_order))
    def _(t: Tables, kind=_kind):
        # The order key is profiled too, so it is left out of the shown columns afterwards.
        df = dirty(t).select("cust_id", *SAMPLED)
        return profile.samples(df, kind, 3, ["cust_id"]).filter("column <> 'cust_id'")


@query(
    "prf7_semantic_guess",
    f"""SELECT * FROM (VALUES ('cust_id', 'numeric', 0.85), ('full_name', 'string', 0.6), ('segment', 'categorical', 0.8),
  ('money', 'currency', 0.8), ('score', 'numeric', 0.85), ('gender', 'categorical', 0.75), ('balance', 'currency', 0.9),
  ('created_on', 'date', 0.9)) AS v("column", semantic_guess, confidence) WHERE (SELECT count(*) FROM customer) > 0""",
)
def _(t: Tables):
    df = dirty(t).selectExpr(
        "cust_id", "full_name", "segment", "money", "score", "gender", "balance",
        "date_format(date_add(date'2020-01-01', cast(cust_id % 900 as int)), 'yyyy-MM-dd') as created_on",
    )
    guessed = semantics.with_guess(profile.profile_columns(df))
    return guessed.select("column", "semantic_guess", F.col("confidence").cast("decimal(3,2)").alias("confidence"))


@query(
    "prf8_broad_type",
    """SELECT * FROM (VALUES ('o_orderkey', 'numeric', 0.95), ('payment_method', 'payment', 0.92), ('order_status', 'status', 0.92),
  ('o_totalprice', 'currency', 0.95), ('o_orderdate', 'date', 0.95), ('item_code', 'product', 0.92), ('txn_ref', 'identifier', 0.92),
  ('o_comment', 'free_text', 0.7), ('kindness', 'categorical', 0.75)) AS v("column", broad_type, match_score)
  WHERE (SELECT count(*) FROM orders) > 0""",
)
def _(t: Tables):
    df = t.orders.selectExpr(
        "o_orderkey", "o_orderpriority as payment_method", "o_orderstatus as order_status", "o_totalprice", "o_orderdate",
        "concat('i', o_orderkey) as item_code", "concat('t', o_orderkey) as txn_ref",
        "concat('a long remark on order ', o_orderkey) as o_comment", "o_orderstatus as kindness",
    )
    typed = semantics.with_broad_type(semantics.with_guess(profile.profile_columns(df)))
    return typed.select("column", "broad_type", F.col("match_score").cast("decimal(3,2)").alias("match_score"))


@query(
    "prf9_column_role",
    """SELECT * FROM (VALUES ('order_id', 'identifier'), ('o_totalprice', 'measure'), ('o_orderdate', 'temporal'),
  ('o_orderstatus', 'categorical'), ('label', 'text'), ('urgent', 'boolean')) AS v("column", role)
  WHERE (SELECT count(*) FROM orders) > 0""",
)
def _(t: Tables):
    df = t.orders.selectExpr(
        "o_orderkey as order_id", "o_totalprice", "o_orderdate", "o_orderstatus", "concat('n', o_orderkey) as label",
        "o_orderpriority = '1-URGENT' as urgent",
    )
    return semantics.with_role(semantics.with_guess(profile.profile_columns(df))).select("column", "role")


def _light_sql(column: str, kind: str, source: str, order: str, low: str, high: str) -> str:
    return f"""SELECT '{column}' AS name, '{kind}' AS detected_type, count(*) FILTER ({column} IS NULL) > 0 AS nullable,
  count(*) FILTER ({column} IS NULL) AS null_count, count(DISTINCT nullif(CAST({column} AS VARCHAR), '')) AS distinct_count,
  (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT CAST({column} AS VARCHAR) AS v, min({order}) AS k FROM {source}
    WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY k LIMIT 3)) AS sample_values,
  {low} AS min_value, {high} AS max_value FROM {source}"""


@query(
    "prf10_light_profile",
    f"WITH {LEDGER} "
    + " UNION ALL ".join(
        [
            _light_sql("account_code", "number", "ledger", "idx", "CAST(min(CAST(account_code AS DOUBLE)) AS VARCHAR)", "CAST(max(CAST(account_code AS DOUBLE)) AS VARCHAR)"),
            _light_sql("sub_class", "string", "ledger", "idx", "min(sub_class)", "max(sub_class)"),
            _light_sql("debit_amount", "number", "ledger", "idx", "CAST(min(TRY_CAST(debit_amount AS DOUBLE)) AS VARCHAR)", "CAST(max(TRY_CAST(debit_amount AS DOUBLE)) AS VARCHAR)"),
        ]
    ),
)
def _(t: Tables):
    df = ledger(t).select("idx", "account_code", "sub_class", "debit_amount")
    return profile.light_profile(df, ["idx"]).filter("name <> 'idx'").drop("position")


@query(
    "prf11_type_detection",
    f"""WITH {LEDGER} SELECT 'voucher_date' AS "column", CASE WHEN avg(CASE WHEN TRY_CAST(voucher_date AS DATE) IS NOT NULL THEN 1.0 ELSE 0 END)
    FILTER (voucher_date IS NOT NULL) >= 0.9 THEN 'date' ELSE 'string' END AS detected_type FROM ledger
  UNION ALL SELECT 'account_code', CASE WHEN avg(CASE WHEN TRY_CAST(account_code AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.9 THEN 'number' ELSE 'string' END FROM ledger
  UNION ALL SELECT 'details', CASE WHEN avg(CASE WHEN TRY_CAST(details AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.9 THEN 'number' ELSE 'string' END FROM ledger
  UNION ALL SELECT 'idx', CASE WHEN count(idx) > 0 THEN 'number' ELSE 'empty' END FROM ledger""",
)
def _(t: Tables):
    df = ledger(t).select("idx", "voucher_date", "account_code", "details")
    stats = profile.column_stats(df)
    return stats.select("column", profile._by_column(df, profile.detected_type_with_dates).alias("detected_type"))


@query(
    "prf12_schema_fingerprint",
    f"""WITH {DIRTY} SELECT sha256('cust_id:bigint:false' || chr(10) || 'score:double:' || (SELECT CASE WHEN count(*) > count(score) THEN 'true' ELSE 'false' END FROM dirty)
  || chr(10) || 'segment:string:' || (SELECT CASE WHEN count(*) > count(segment) THEN 'true' ELSE 'false' END FROM dirty) || chr(10) || 'version:1.0') AS schema_fingerprint""",
)
def _(t: Tables):
    return fingerprints.schema_fingerprint(dirty(t).select("segment", "cust_id", "score"))


_TOP = """(SELECT string_agg(sha256(v), ',' ORDER BY n DESC, v) FROM (
  SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 3))"""


@query(
    "prf13_profile_fingerprint",
    f"""SELECT sha256('o_orderpriority:' || count(DISTINCT o_orderpriority) || ':' || {_TOP.format(c='o_orderpriority')} || chr(10)
  || 'o_orderstatus:' || count(DISTINCT o_orderstatus) || ':' || {_TOP.format(c='o_orderstatus')} || chr(10) || 'version:1.0') AS profile_fingerprint FROM orders""",
)
def _(t: Tables):
    return fingerprints.profile_fingerprint(t.orders.select("o_orderstatus", "o_orderpriority"))


@query(
    "prf14_snapshot_check",
    """SELECT url AS path, CASE WHEN page_id % 5 = 0 THEN 'gone' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM pages
  UNION ALL SELECT 'new/' || page_id, 'new' FROM pages WHERE page_id % 5 = 0""",
)
def _(t: Tables):
    before = t.pages.select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    edited = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    moved = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("new/"), "page_id")).otherwise(F.col("url"))
    now = t.pages.select(moved.alias("path"), F.sha2(edited, 256).alias("sha256"))
    return fingerprints.changed_files(now, before)


@query(
    "prf15_finance_roles",
    """SELECT role, count(*) AS n FROM (SELECT unnest(['transaction_id', 'payment_value', 'date', 'status']) AS role FROM orders) GROUP BY 1""",
)
def _(t: Tables):
    from tidemark.functions.names import finance_roles

    df = t.orders.selectExpr("o_orderkey as order_id", "o_totalprice as total_amount", "o_orderdate as invoice_date", "o_orderstatus as state")
    roles = F.array(*[F.lit(r) for c in df.columns for r in finance_roles(c)])
    return df.select(F.explode(roles).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prf16_field_mapping",
    """SELECT * FROM (VALUES ('order_id', 'transaction_id', 'number', 'high', 'Matched a semantic column role and mapped to the canonical target.'),
  ('debit_amount', 'debit_amount', 'number', 'high', 'Matched a known finance schema alias.'),
  ('raw_text', 'raw_text', 'string', 'medium', 'Preserved unstructured text for user confirmation.'),
  ('remark', 'remark', 'string', 'medium', 'Normalized from the source header and proposed as-is.')) AS v(source, target, detected_type, confidence, reason)
  WHERE (SELECT count(*) FROM orders) > 0""",
)
def _(t: Tables):
    df = t.orders.selectExpr(
        "o_orderkey as order_id", "o_totalprice as debit_amount", "o_orderpriority as raw_text", "o_orderstatus as remark"
    )
    return profile.field_mapping(df)
