"""CLN: cleaning operators on the noisy customer table and on whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, LEDGER, WS, dirty, ledger
from tidemark.functions import dates, text
from tidemark.operators import cleaning as ops
from tidemark.operators import ledger as ledgers
from tidemark.plans.run import apply_ops

catalog = Catalog()
query = catalog.query

COLUMNS = "cust_id, full_name, segment, money, quantity, signup, score, gender, nation_id, balance".split(", ")


def over_dirty(**changed: str) -> str:
    """SQL that selects every column of the noisy table, some by an expression."""
    shown = [f"{changed[c]} AS {c}" if c in changed else c for c in COLUMNS]
    return f"WITH {DIRTY} SELECT {', '.join(shown)} FROM dirty"


def strip_sql(c: str) -> str:
    return f"trim({c}, {WS})"


def title_sql(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'), "
        "lambda x: upper(x[1]) || x[2:]), '')"
    )


TEXTS = ["full_name", "segment", "money", "quantity", "signup", "gender"]


@query("cln1_trim_whitespace", over_dirty(**{c: strip_sql(c) for c in TEXTS}))
def _(t: Tables):
    return ops.trim_whitespace(dirty(t))


@query("cln1_trim_documents", f"SELECT doc_id, {strip_sql('text')} AS text, lang, source, n_chars FROM documents")
def _(t: Tables):
    return ops.trim_whitespace(t.documents, ["text"])


@query(
    "cln2_drop_duplicates_rows",
    "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem",
)
def _(t: Tables):
    return ops.drop_duplicates(t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag"))


_KEEP = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (
 SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linenumber, l_suppkey
   ORDER BY l_shipdate {d}, l_orderkey {d}, l_partkey {d}, l_extendedprice {d}) AS rn FROM lineitem) WHERE rn = 1"""


def _kept(t: Tables, keep):
    df = ops.drop_duplicates(
        t.lineitem, ["l_returnflag", "l_linenumber", "l_suppkey"], keep,
        ["l_shipdate", "l_orderkey", "l_partkey", "l_extendedprice"],
    )
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("cln2_drop_duplicates_first", _KEEP.format(d="ASC"))
def _(t: Tables):
    return _kept(t, "first")


@query("cln2_drop_duplicates_last", _KEEP.format(d="DESC"))
def _(t: Tables):
    return _kept(t, "last")


@query(
    "cln2_drop_duplicates_none",
    f"""WITH {DIRTY} SELECT cust_id, full_name, segment FROM (
  SELECT *, count(*) OVER (PARTITION BY full_name) AS n FROM dirty) WHERE n = 1""",
)
def _(t: Tables):
    return ops.drop_duplicates(dirty(t), ["full_name"], keep=False).select("cust_id", "full_name", "segment")


@query("cln3_fill_zero", over_dirty(score="coalesce(score, 0)"))
def _(t: Tables):
    return ops.fill_nulls(dirty(t), ["score"], "zero")


@query("cln3_fill_empty_string", over_dirty(full_name="coalesce(full_name, '')", gender="coalesce(gender, '')"))
def _(t: Tables):
    return ops.fill_nulls(dirty(t), ["full_name", "gender", "score"], "empty_string")


@query("cln3_fill_mean", f"WITH {DIRTY} SELECT cust_id, round(coalesce(score, (SELECT avg(score) FROM dirty)), 6) AS score FROM dirty")
def _(t: Tables):
    return ops.fill_nulls(dirty(t).select("cust_id", "score"), ["score"], "mean").withColumn("score", F.round("score", 6))


@query("cln3_fill_median", f"WITH {DIRTY} SELECT cust_id, coalesce(score, (SELECT median(score) FROM dirty)) AS score FROM dirty")
def _(t: Tables):
    return ops.fill_nulls(dirty(t).select("cust_id", "score"), ["score"], "median")


@query(
    "cln3_fill_mode",
    f"""WITH {DIRTY} SELECT cust_id, coalesce(segment, (SELECT segment FROM dirty WHERE segment IS NOT NULL
  GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM dirty""",
)
def _(t: Tables):
    return ops.fill_nulls(dirty(t).select("cust_id", "segment"), ["segment"], "mode")


@query("cln3_fill_constant", over_dirty(segment="coalesce(segment, 'UNKNOWN')"))
def _(t: Tables):
    return ops.fill_nulls(dirty(t), ["segment"], "constant", "UNKNOWN")


_BLANK = "CASE WHEN " + strip_sql("{c}") + " <> '' THEN {c} END"


@query(
    "cln4_drop_nulls_any",
    f"WITH {DIRTY} SELECT cust_id, full_name, segment FROM dirty WHERE {_BLANK.format(c='full_name')} IS NOT NULL AND segment IS NOT NULL",
)
def _(t: Tables):
    return ops.drop_nulls(dirty(t), ["full_name", "segment"]).select("cust_id", "full_name", "segment")


@query(
    "cln4_drop_nulls_all",
    f"""WITH {DIRTY} SELECT cust_id, {_BLANK.format(c='full_name')} AS full_name, segment FROM dirty
  WHERE {_BLANK.format(c='full_name')} IS NOT NULL OR segment IS NOT NULL""",
)
def _(t: Tables):
    return ops.drop_nulls(dirty(t), ["full_name", "segment"], "all").select("cust_id", "full_name", "segment")


@query("cln5_normalize_date", over_dirty(signup="strftime(try_strptime(signup, '%d/%m/%Y'), '%Y-%m-%d')"))
def _(t: Tables):
    return ops.normalize_date(dirty(t), "signup", dayfirst=True)


@query("cln5_normalize_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS o_orderdate FROM orders")
def _(t: Tables):
    return ops.normalize_date(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "%d.%m.%Y")


@query(
    "cln5_normalize_date_ignore",
    over_dirty(signup="coalesce(strftime(try_strptime(signup, '%d/%m/%Y'), '%m/%Y'), signup)"),
)
def _(t: Tables):
    return ops.normalize_date(dirty(t), "signup", "%m/%Y", dayfirst=True, errors="ignore")


_FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyyMMdd", "MM/dd/yy", "MM.dd.yyyy", "dd-MMM-yyyy",
    "MMMM dd, yyyy", "MM/dd/yyyy hh:mm a", "'no date'",
)


@query(
    "cln5_normalize_date_forms",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(_FORMS)} < {len(_FORMS) - 1} THEN strftime(o_orderdate, '%d of %B, %Y') END AS written FROM orders",
)
def _(t: Tables):
    written = F.coalesce(*[
        F.when(F.col("o_orderkey") % len(_FORMS) == i, F.date_format("o_orderdate", form)) for i, form in enumerate(_FORMS)
    ])
    return ops.normalize_date(t.orders.select("o_orderkey", written.alias("written")), "written", "%d of %B, %Y")


@query("cln6_normalize_currency", over_dirty(money="TRY_CAST(regexp_replace(money, '[^0-9.-]', '', 'g') AS DOUBLE)"))
def _(t: Tables):
    return ops.normalize_currency(dirty(t), "money")


@query("cln7_normalize_number", over_dirty(quantity="TRY_CAST(replace(quantity, ',', '') AS DOUBLE)"))
def _(t: Tables):
    return ops.normalize_number(dirty(t), "quantity")


for _case, _sql in {
    "lower": "lower({c})",
    "upper": "upper({c})",
    "title": title_sql("{c}"),
    "capitalize": "upper({c}[1]) || lower({c}[2:])",
}.items():

    @query(
        f"cln8_text_case_{_case}",
        f"WITH {DIRTY} SELECT cust_id, {_sql.format(c='full_name')} AS full_name, {_sql.format(c='segment')} AS segment FROM dirty",
    )
    def _(t: Tables, case=_case):
        return ops.text_case(dirty(t).select("cust_id", "full_name", "segment"), case)


@query("cln8_text_case_title_documents", f"SELECT doc_id, {title_sql('source')} AS source, {title_sql('lang')} AS lang FROM documents")
def _(t: Tables):
    return ops.text_case(t.documents.select("doc_id", "source", "lang"), "title")


@query(
    "cln9_replace_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def _(t: Tables):
    return ops.replace_values(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "finished"})


@query(
    "cln9_replace_by_table",
    "SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS customer FROM orders "
    "LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
)
def _(t: Tables):
    mapping = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("old"), F.col("c_name").alias("new"))
    df = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return ops.replace_by_table(df, "customer", mapping)


@query("cln10_strip_currency_symbols", over_dirty(money="regexp_replace(money, '[$£€¥]', '', 'g')"))
def _(t: Tables):
    return ops.strip_currency_symbols(dirty(t), "money")


@query("cln11_remove_commas", over_dirty(quantity="replace(quantity, ',', '')"))
def _(t: Tables):
    return ops.remove_commas(dirty(t), "quantity")


@query("cln12_coerce_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(t: Tables):
    return ops.coerce_type(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "string")


@query("cln12_coerce_integer", f"WITH {DIRTY} SELECT cust_id, TRY_CAST(replace(quantity, ',', '') AS BIGINT) AS quantity FROM dirty")
def _(t: Tables):
    df = ops.remove_commas(dirty(t).select("cust_id", "quantity"), "quantity")
    return ops.coerce_type(df, "quantity", "integer")


@query("cln12_coerce_float", f"WITH {DIRTY} SELECT cust_id, TRY_CAST(replace(money, '$', '') AS DOUBLE) AS money FROM dirty")
def _(t: Tables):
    df = ops.strip_currency_symbols(dirty(t).select("cust_id", "money"), "money")
    return ops.coerce_type(df, "money", "float")


@query("cln12_coerce_boolean", f"WITH {DIRTY} SELECT cust_id, coalesce(nation_id <> 0, true) AS nation_id, coalesce(score <> 0, true) AS score FROM dirty")
def _(t: Tables):
    df = dirty(t).select("cust_id", "nation_id", "score")
    return ops.coerce_type(ops.coerce_type(df, "nation_id", "boolean"), "score", "boolean")


@query("cln12_coerce_date", f"WITH {LEDGER} SELECT idx, TRY_CAST(voucher_date AS TIMESTAMP) AS voucher_date FROM ledger")
def _(t: Tables):
    return ops.coerce_type(ledger(t).select("idx", "voucher_date"), "voucher_date", "date")


@query("cln12_coerce_ignore", f"WITH {DIRTY} SELECT cust_id, money FROM dirty")
def _(t: Tables):
    return ops.coerce_type(dirty(t).select("cust_id", "money"), "money", "float", errors="ignore")


@query("cln13_remove_empty_rows", f"WITH {DIRTY} SELECT full_name, segment FROM dirty WHERE full_name IS NOT NULL OR segment IS NOT NULL")
def _(t: Tables):
    return ops.drop_empty_rows(dirty(t).select("full_name", "segment"))


@query("cln14_absolute_value", over_dirty(cust_id="abs(cust_id)", score="abs(score)", nation_id="abs(nation_id)", balance="abs(balance)"))
def _(t: Tables):
    return ops.absolute_value(dirty(t))


_GENDER = (
    f"CASE WHEN lower({strip_sql('gender')}) IN ('m', 'male', 'males') THEN 'Male' "
    f"WHEN lower({strip_sql('gender')}) IN ('f', 'female', 'females') THEN 'Female' "
    f"WHEN lower({strip_sql('gender')}) IN ('o', 'other', 'others') THEN 'Other' "
    f"ELSE {title_sql(strip_sql('gender'))} END"
)


@query("cln15_normalize_categories", over_dirty(gender=_GENDER, segment=title_sql(strip_sql("segment"))))
def _(t: Tables):
    return ops.normalize_categories(dirty(t))


@query("cln16_empty_to_null", over_dirty(full_name=_BLANK.format(c="full_name")))
def _(t: Tables):
    return ops.empty_to_null(dirty(t))


@query("cln17_numeric_when_confident", f"WITH {LEDGER} SELECT idx, TRY_CAST(account_code AS DOUBLE) AS account_code, details FROM ledger")
def _(t: Tables):
    return ops.numeric_when_confident(ledger(t).select("idx", "account_code", "details"))


@query(
    "cln18_currency_when_confident",
    f"""WITH {DIRTY} SELECT cust_id, full_name, TRY_CAST(replace(replace(money, '$', ''), ',', '') AS DOUBLE) AS money,
  TRY_CAST(replace(quantity, ',', '') AS DOUBLE) AS quantity FROM (
  SELECT cust_id, full_name, CASE WHEN balance < 0 THEN replace(money, '-', '') ELSE money END AS money, quantity FROM dirty)""",
)
def _(t: Tables):
    unsigned = F.when(F.col("balance") < 0, F.translate("money", "-", "")).otherwise(F.col("money"))
    return ops.currency_when_confident(dirty(t).select("cust_id", "full_name", unsigned.alias("money"), "quantity"))


@query(
    "cln19_dates_when_confident",
    f"WITH {DIRTY} SELECT cust_id, try_strptime(signup, '%d/%m/%Y') AS signup, segment FROM dirty",
)
def _(t: Tables):
    return ops.dates_when_confident(dirty(t).select("cust_id", "signup", "segment"))


@query("cln20_lower_values", over_dirty(**{c: f"lower({strip_sql(c)})" for c in TEXTS}))
def _(t: Tables):
    return ops.lower_values(dirty(t))


_PREP = f"""WITH {DIRTY} SELECT cust_id, lower(nullif({strip_sql('full_name')}, '')) AS full_name,
  lower({strip_sql('segment')}) AS segment, TRY_CAST(replace(quantity, ',', '') AS DOUBLE) AS order_qty,
  try_strptime(signup, '%d/%m/%Y') AS signup_date FROM dirty"""


@query("cln21_filter_prep", _PREP)
def _(t: Tables):
    df = dirty(t).selectExpr("cust_id", "full_name", "segment", "quantity as `Order Qty`", "signup as signupDate")
    return ops.prepare_for_filter(df)


@query(
    "cln22_default_clean",
    f"WITH {DIRTY} SELECT DISTINCT {strip_sql('segment')} AS customer_segment, nation_id FROM dirty",
)
def _(t: Tables):
    return ops.default_clean(dirty(t).selectExpr("segment as `Customer Segment`", "nation_id"))


AUDITED = [
    {"type": "trim_whitespace", "columns": ["full_name", "segment"]},
    {"type": "drop_nulls", "columns": ["full_name"]},
    {"type": "filter", "conditions": [{"column": "segment", "operator": "eq", "value": "machinery"}]},
    {"type": "drop_columns", "columns": ["gender"]},
]


@query(
    "cln23_audited_plan",
    f"""WITH {DIRTY}, a AS (SELECT count(*) AS n FROM dirty),
  b AS (SELECT count(*) AS n FROM dirty WHERE {strip_sql('full_name')} <> ''),
  c AS (SELECT count(*) AS n FROM dirty WHERE {strip_sql('full_name')} <> '' AND lower({strip_sql('segment')}) = 'machinery')
  SELECT 'step_1' AS operation_id, 'trim_whitespace' AS operation_type, a.n AS rows_in, a.n AS rows_out, '[]' AS columns_modified FROM a
  UNION ALL SELECT 'step_2', 'drop_nulls', a.n, b.n, '[]' FROM a, b
  UNION ALL SELECT 'step_3', 'filter', b.n, c.n, '[]' FROM b, c
  UNION ALL SELECT 'step_4', 'drop_columns', c.n, c.n, '["gender"]' FROM c""",
)
def _(t: Tables):
    result = apply_ops(dirty(t), AUDITED)
    return result.audit().selectExpr(
        "operation_id", "operation_type", "cast(input_row_count as bigint) as rows_in",
        "cast(output_row_count as bigint) as rows_out", "columns_modified",
    )


@query(
    "cln23_audited_limit",
    """SELECT 'step_1' AS operation_id, 'trim_whitespace' AS operation_type, count(*) AS rows_in, count(*) AS rows_out FROM orders
  UNION ALL SELECT 'step_2', 'filter', count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders
  UNION ALL SELECT 'step_3', 'limit', count(*) FILTER (o_orderstatus = 'F'), least(10, count(*) FILTER (o_orderstatus = 'F')) FROM orders""",
)
def _(t: Tables):
    """Only a part of the result is read, and the limit stops the reading of what precedes it."""
    result = apply_ops(t.orders.select("o_orderkey", "o_orderstatus"), [
        {"type": "trim_whitespace"},
        {"type": "filter", "conditions": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}]},
        {"type": "limit", "n": 10},
    ])
    result.df.take(5)
    return result.audit().selectExpr(
        "operation_id", "operation_type", "cast(input_row_count as bigint) as rows_in", "cast(output_row_count as bigint) as rows_out"
    )


@query(
    "cln24_json_safe",
    f"""WITH {DIRTY} SELECT cust_id, {strip_sql('full_name')} AS full_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
  nullif(balance, 0) AS share FROM dirty JOIN orders ON o_custkey = cust_id""",
)
def _(t: Tables):
    nan = F.when(F.col("balance") == 0, F.lit(float("nan"))).otherwise(F.col("balance"))
    joined = dirty(t).join(t.orders, F.col("o_custkey") == F.col("cust_id"))
    return ops.json_safe(joined.select("cust_id", "full_name", "o_orderdate", nan.alias("share")))


@query(
    "cln25_ledger_derive",
    f"""WITH {LEDGER} SELECT idx, CASE WHEN TRY_CAST(debit_amount AS DOUBLE) > 0 THEN TRY_CAST(debit_amount AS DOUBLE) END AS debit_amount,
  CASE WHEN TRY_CAST(credit_amount AS DOUBLE) > 0 THEN TRY_CAST(credit_amount AS DOUBLE) END AS credit_amount,
  TRY_CAST(split_part(entry_no, '.', 1) AS INTEGER) AS entry_group, TRY_CAST(nullif(split_part(entry_no, '.', 2), '') AS INTEGER) AS entry_line
  FROM ledger""",
)
def _(t: Tables):
    return ledgers.derive(ledger(t)).select("idx", "debit_amount", "credit_amount", "entry_group", "entry_line")


@query(
    "cln26_text_keys",
    "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS word_key, "
    "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS compact_key FROM documents",
)
def _(t: Tables):
    return t.documents.select(
        "doc_id", text.word_key(F.col("text")).alias("word_key"), text.compact_key(F.col("text")).alias("compact_key")
    )


@query(
    "cln27_mask_sensitive",
    """SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN left(CAST(o_custkey AS VARCHAR), 1) || '***@x.org'
       ELSE '****' || right('1' || o_custkey || '000000', 4) END AS contact_email,
  CASE WHEN length(o_orderpriority) <= 12 THEN '<redacted>'
       ELSE left(o_orderpriority, 2) || '***' || right(o_orderpriority, 2) END AS account_kind,
  o_orderpriority AS plain FROM orders""",
)
def _(t: Tables):
    df = t.orders.selectExpr(
        "o_orderkey",
        "case when o_orderkey % 3 = 0 then concat(o_custkey, '@x.org') else concat('1-', o_custkey, '-000000') end as contact_email",
        "o_orderpriority as account_kind",
        "o_orderpriority as plain",
    )
    return ops.mask_sensitive(df)


@query(
    "cln27_mask_documents",
    """SELECT doc_id, CASE WHEN position('@' IN text) = 1 THEN '<redacted>'
  WHEN position('@' IN text) > 1 THEN left(text, 1) || '***' || substring(text, position('@' IN text))
  WHEN length(regexp_replace(text, '\\D+', '', 'g')) >= 6 THEN '****' || right(regexp_replace(text, '\\D+', '', 'g'), 4)
  WHEN length(text) <= 12 THEN '<redacted>' ELSE left(text, 2) || '***' || right(text, 2) END AS text FROM documents""",
)
def _(t: Tables):
    return ops.mask_sensitive(t.documents.select("doc_id", "text"), ["text"])


@query(
    "cln28_display",
    """SELECT o_orderkey, 'ID-' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 5 THEN CAST(o_orderkey AS VARCHAR)
  ELSE lpad(CAST(o_orderkey AS VARCHAR), 5, '0') END AS display_id,
  strftime(o_orderdate + to_minutes(CAST(o_orderkey % 1440 + 330 AS INTEGER)), '%H:%M') AS clock FROM orders""",
)
def _(t: Tables):
    at = F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int))")
    return t.orders.select(
        "o_orderkey", text.padded_id(F.col("o_orderkey"), "ID-").alias("display_id"), dates.local_clock(at).alias("clock")
    )


@query(
    "cln29_multi_value",
    """SELECT o_orderkey, array_to_string(list_distinct_ordered, '|') AS parsed FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = CAST(o_custkey AS VARCHAR) THEN [o_orderstatus]
    ELSE [o_orderstatus, CAST(o_custkey AS VARCHAR), '2.5', o_orderpriority] END AS list_distinct_ordered FROM orders)""",
)
def _(t: Tables):
    cell = F.expr(
        "concat('\"', o_orderstatus, '\" and ', lpad(o_custkey, 9, '0'), ', 2.50; ', o_orderpriority, ' OR ', o_orderstatus)"
    )
    return t.orders.select("o_orderkey", F.array_join(text.multi_value(cell), "|").alias("parsed"))

