"""VAL: rules, quarantine, ledger checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, LEDGER, LEDGER_ERRORS, dirty, ledger
from tidemark.operators import ledger as ledgers
from tidemark.operators import rules as ops

catalog = Catalog()
query = catalog.query


def report(column: str, rule: str, severity: str, invalid: str, sample: str, order: str, source: str) -> str:
    """SQL of one report row: count and first three samples of the invalid rows."""
    return f"""SELECT '{column}' AS "column", '{rule}' AS rule, '{severity}' AS severity, count(*) AS invalid_count,
  string_agg(s, '|' ORDER BY k) FILTER (rn <= 3) AS samples FROM (
  SELECT {sample} AS s, {order} AS k, row_number() OVER (ORDER BY {order}) AS rn FROM {source} WHERE {invalid}) HAVING count(*) > 0"""


def shown(df):
    return df.select("column", "rule", "severity", "invalid_count", F.array_join("sample_values", "|").alias("samples"))


def rule(name: str, constraint: dict, invalid: str, severity: str = "warning", sample: str | None = None, now: str | None = None):
    """Register a one-rule report over the noisy customer table."""
    column = constraint["column"]

    @query(
        name,
        f"WITH {DIRTY} " + report(column, constraint["rule"], severity, invalid, sample or f"CAST({column} AS VARCHAR)", "cust_id", "dirty"),
    )
    def _(t: Tables):
        return shown(ops.validate(dirty(t), [constraint], ["cust_id"], now))


def k(column: str, name: str, **more) -> dict:
    return {"column": column, "rule": name, **more}


BLANK = "trim({c}, ' ' || chr(9))"

rule("val1_required", k("full_name", "required"), f"full_name IS NULL OR {BLANK.format(c='full_name')} = ''", "error")
rule("val3_non_negative", k("score", "non_negative"), "score < 0")
rule("val4_numeric_range", k("score", "numeric_range", min_value=0, max_value=9000), "score < 0 OR score > 9000")
rule(
    "val4_numeric_range_text", k("money", "numeric_range", min_value=0),
    "money IS NOT NULL AND (TRY_CAST(money AS DOUBLE) IS NULL OR TRY_CAST(money AS DOUBLE) < 0)",
)
rule("val5_percentage_range", k("score", "percentage_range"), "score < 0 OR score > 100")
rule("val8_starts_with", k("segment", "starts_with", value="M"), "segment IS NOT NULL AND NOT starts_with(segment, 'M')")
rule("val9_ends_with", k("full_name", "ends_with", value="7"), "full_name IS NOT NULL AND NOT suffix(full_name, '7')")
rule(
    "val10_contains", k("segment", "contains", value="Mach-in"),
    "segment IS NOT NULL AND NOT contains(regexp_replace(lower(segment), '[^a-z0-9]+', '', 'g'), 'machin')",
)
rule(
    "val11_regex_match", k("full_name", "regex_match", pattern=r"Customer#\d{9}|\s+C"),
    r"full_name IS NOT NULL AND NOT regexp_matches(full_name, '^(?:Customer#\d{9}|\s+C)')",
)
rule(
    "val12_allowed_values", k("segment", "allowed_values", allowed_values=["building", "MACHINERY "]),
    "segment IS NOT NULL AND upper(segment) NOT IN ('BUILDING', 'MACHINERY')",
)
rule(
    "val13_not_allowed_values", k("gender", "not_allowed_values", not_allowed_values=["unknown", "o"]),
    "upper(gender) IN ('UNKNOWN', 'O')", "error",
)
rule("val14_length_range", k("gender", "length_range", min_length=2, max_length=6), "length(gender) < 2 OR length(gender) > 6")
rule("val14_length_max_only", k("gender", "length_range", max_length=6), "length(gender) > 6")
rule(
    "val15_cross_field_compare", k("nation_id", "cross_field_compare", compare_column="cust_id", operator="<"),
    "NOT (nation_id < cust_id)", "error", """'{"nation_id":' || nation_id || ',"cust_id":' || cust_id || '}'""",
)


@query(
    "val2_unique",
    """WITH d AS (SELECT o_clean AS v, count(*) AS n, min(o_orderkey) AS k FROM (
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_clean FROM orders) GROUP BY 1 HAVING count(*) > 1)
  SELECT 'code' AS "column", 'unique' AS rule, 'error' AS severity, CAST(sum(n) AS BIGINT) AS invalid_count,
  (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT v, k FROM d ORDER BY k LIMIT 3)) AS samples FROM d""",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", F.format_string(" %s ", F.col("o_custkey").cast("string")).alias("code"))
    return shown(ops.validate(df, [k("code", "unique")], ["o_orderkey"]))


@query(
    "val6_date_not_future",
    report(
        "o_orderdate", "date_not_future", "warning", "o_orderdate > TIMESTAMP '2001-01-01'",
        "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "o_orderkey", "orders",
    ),
)
def _(t: Tables):
    return shown(ops.validate(t.orders, [k("o_orderdate", "date_not_future")], ["o_orderkey"], now="2001-01-01"))


@query(
    "val7_date_range",
    f"WITH {LEDGER} "
    + report(
        "voucher_date", "date_range", "warning",
        "voucher_date IS NOT NULL AND (TRY_CAST(voucher_date AS DATE) IS NULL OR TRY_CAST(voucher_date AS DATE) < DATE '1996-01-01' "
        "OR TRY_CAST(voucher_date AS DATE) > DATE '1999-12-31')",
        "voucher_date", "idx", "ledger",
    ),
)
def _(t: Tables):
    constraint = k("voucher_date", "date_range", min_date="1996-01-01", max_date="1999-12-31")
    return shown(ops.validate(ledger(t), [constraint], ["idx"]))


def _star(column: str) -> str:
    return report(
        column, "forbidden_substring", "warning",
        f"contains(regexp_replace(lower(CAST({column} AS VARCHAR)), '[^a-z0-9]+', '', 'g'), '1urg')", f"CAST({column} AS VARCHAR)",
        "o_orderkey", "orders",
    )


@query("val16_forbidden_substring", " UNION ALL ".join(f"({_star(c)})" for c in ("o_orderstatus", "o_orderpriority")))
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return shown(ops.validate(df, [k("*", "forbidden_substring", value="1-URG")], ["o_orderkey"]))


@query("val17_drop_column", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def _(t: Tables):
    return ops.drop_columns(t.orders, [k("o_totalprice", "drop_column"), k("absent", "drop_column")])


FILTERS = [
    {"action": "drop_columns", "columns": ["gender"]},
    {"action": "keep_rows", "conditions": [{"column": "segment", "operator": "eq", "value": "BUILDING"}]},
    {"action": "drop_rows", "conditions": [{"column": "full_name", "operator": "contains", "value": "#000000007"}]},
]


@query(
    "val18_filter_constraints",
    f"WITH {DIRTY} ("
    + report("segment", "allowed_values", "warning", "segment IS NOT NULL AND upper(segment) <> 'BUILDING'", "segment", "cust_id", "dirty")
    + ") UNION ALL ("
    + report(
        "full_name", "forbidden_substring", "warning",
        "contains(regexp_replace(lower(full_name), '[^a-z0-9]+', '', 'g'), '000000007')", "full_name", "cust_id", "dirty",
    )
    + ")",
)
def _(t: Tables):
    return shown(ops.validate(dirty(t), ops.constraints_from_filter(FILTERS), ["cust_id"]))


@query("val19_ledger_columns", "SELECT 'credit_amount' AS missing, count(*) AS n FROM orders")
def _(t: Tables):
    df = ledger(t).drop("credit_amount")
    return df.agg(F.lit(",".join(ledgers.missing_columns(df))).alias("missing"), F.count(F.lit(1)).alias("n"))


@query("val20_ledger_row_errors", f"WITH {LEDGER}, {LEDGER_ERRORS} SELECT row, field, message FROM errs")
def _(t: Tables):
    return ledgers.row_errors(ledger(t), "idx").select("row", "field", "message")


@query(
    "val20_ledger_report",
    f"""WITH {LEDGER}, {LEDGER_ERRORS} SELECT row, field, message FROM (
  SELECT *, row_number() OVER (PARTITION BY chk ORDER BY row) AS rn FROM errs)
  WHERE rn <= 25 OR chk = 10 ORDER BY chk, row LIMIT 100""",
)
def _(t: Tables):
    return ledgers.error_report(ledger(t), "idx")


SPLIT = [
    k("full_name", "required"), k("score", "non_negative"), k("gender", "not_allowed_values", not_allowed_values=["unknown"]),
    k("quantity", "unique"), k("segment", "unique"),
]
_ERRORS = f"""{DIRTY}, flagged AS (SELECT *, array_to_string(list_filter([
  CASE WHEN full_name IS NULL OR {BLANK.format(c='full_name')} = '' THEN 'full_name:required' END,
  CASE WHEN score < 0 THEN 'score:non_negative' END,
  CASE WHEN upper(gender) = 'UNKNOWN' THEN 'gender:not_allowed_values' END,
  CASE WHEN quantity IS NOT NULL AND count(*) OVER (PARTITION BY quantity) > 1 THEN 'quantity:unique' END,
  CASE WHEN segment IS NOT NULL AND count(*) OVER (PARTITION BY trim(segment)) > 1 THEN 'segment:unique' END],
  lambda e: e IS NOT NULL), '|') AS errs FROM dirty)"""


@query("val21_quarantine_bad", f"WITH {_ERRORS} SELECT cust_id, errs AS errors FROM flagged WHERE errs <> ''")
def _(t: Tables):
    _good, bad = ops.quarantine(dirty(t), SPLIT)
    return bad.select("cust_id", F.array_join("errors", "|").alias("errors"))


@query("val21_quarantine_good", f"WITH {_ERRORS} SELECT cust_id, full_name, segment FROM flagged WHERE errs = ''")
def _(t: Tables):
    good, _bad = ops.quarantine(dirty(t), SPLIT)
    return good.select("cust_id", "full_name", "segment")


@query(
    "val_all_rules_one_pass",
    f"WITH {DIRTY} ("
    + ") UNION ALL (".join(
        [
            report("full_name", "required", "error", f"full_name IS NULL OR {BLANK.format(c='full_name')} = ''", "full_name", "cust_id", "dirty"),
            report("score", "non_negative", "warning", "score < 0", "CAST(score AS VARCHAR)", "cust_id", "dirty"),
            report("gender", "not_allowed_values", "error", "upper(gender) = 'UNKNOWN'", "gender", "cust_id", "dirty"),
        ]
    )
    + f""") UNION ALL (SELECT 'segment', 'unique', 'error', CAST(sum(n) AS BIGINT), (SELECT string_agg(v, '|' ORDER BY k) FROM (
  SELECT trim(segment) AS v, min(cust_id) AS k FROM dirty WHERE segment IS NOT NULL GROUP BY 1 ORDER BY k LIMIT 3))
  FROM (SELECT trim(segment) AS v, count(*) AS n FROM dirty WHERE segment IS NOT NULL GROUP BY 1 HAVING count(*) > 1))""",
)
def _(t: Tables):
    return shown(ops.validate(dirty(t), SPLIT, ["cust_id"]))
