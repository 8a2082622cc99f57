"""Tables derived from the given ones, each with the same derivation in SQL.

The given tables are clean and have no nulls, so noise is put in by row: padding, blanks, nulls,
currency signs, commas and case changes. Every row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.catalog import Tables

# --- an uploaded customer table with noise ------------------------------------------------------


def dirty(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "c_custkey as cust_id",
        """case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then '   '
           when c_custkey % 7 = 0 then concat('  ', c_name, ' ', char(9)) else c_name end as full_name""",
        """case when c_custkey % 17 = 0 then null when c_custkey % 4 = 0 then upper(c_mktsegment)
           when c_custkey % 4 = 1 then lower(c_mktsegment)
           when c_custkey % 4 = 2 then concat(' ', c_mktsegment, ' ') else c_mktsegment end as segment""",
        """case when c_custkey % 23 = 0 then null when c_custkey % 19 = 0 then 'n/a'
           else concat(case when c_acctbal < 0 then '-' else '' end, '$', format_number(abs(c_acctbal), 2))
           end as money""",
        "case when c_custkey % 41 = 0 then null else format_number(c_custkey * 37, 0) end as quantity",
        """case when c_custkey % 31 = 0 then null when c_custkey % 29 = 0 then 'not a date'
           else date_format(date_add(date'2020-01-01', cast(c_custkey % 900 as int)), 'dd/MM/yyyy')
           end as signup""",
        "case when c_custkey % 10 = 0 then null else c_acctbal end as score",
        """case when c_custkey % 37 = 0 then null else
           element_at(array('m', 'Male', 'MALES', 'f', 'female', ' Females ', 'o', 'Others', 'unknown'),
           cast(c_custkey % 9 as int) + 1) end as gender""",
        "c_nationkey as nation_id",
        "c_acctbal as balance",
    )


DIRTY = """dirty AS (SELECT c_custkey AS cust_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '   '
       WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' || chr(9) ELSE c_name END AS full_name,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment)
       WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment)
       WHEN c_custkey % 4 = 2 THEN ' ' || c_mktsegment || ' ' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'n/a'
       ELSE (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || '$' || format('{:,.2f}', abs(c_acctbal)) END AS money,
  CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE format('{:,}', c_custkey * 37) END AS quantity,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'not a date'
       ELSE strftime(DATE '2020-01-01' + CAST(c_custkey % 900 AS INTEGER), '%d/%m/%Y') END AS signup,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS score,
  CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE
    ['m', 'Male', 'MALES', 'f', 'female', ' Females ', 'o', 'Others', 'unknown'][CAST(c_custkey % 9 AS INTEGER) + 1] END AS gender,
  c_nationkey AS nation_id, c_acctbal AS balance FROM customer)"""

# White space of every kind, for SQL trims.
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

# --- orders as jobs, line items as their stored rows, customers as users ------------------------

JOB_STATUS = (
    "case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then 'processing' "
    "when o_orderstatus = 'O' and o_orderkey % 5 = 0 then 'pending' "
    "when o_orderstatus = 'O' then 'queued' "
    "when o_orderstatus = 'F' and o_orderkey % 7 = 0 then 'callback_failed' "
    "when o_orderstatus = 'F' and o_orderkey % 11 = 0 then 'declined' "
    "when o_orderstatus = 'F' then 'succeeded' "
    "when o_orderkey % 3 = 0 then 'partial' when o_orderkey % 3 = 1 then 'complete' else 'planning' end"
)


def jobs(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey as id",
        "o_custkey as user_id",
        "concat('file_', cast(o_orderkey as string), '.csv') as file_name",
        "case when o_orderpriority = '3-MEDIUM' then null else lower(substring(o_orderpriority, 3)) end as output_format",
        f"{JOB_STATUS} as status",
        """concat('{"status": "', case when o_orderkey % 13 = 0 then 'pending_agent_availability'
           when o_orderkey % 17 = 0 then 'rejected' else 'done' end, '", "record_count": ',
           cast(o_orderkey % 9 as string), case when o_orderkey % 6 = 0 then ', "error": "Bad column"' else '' end,
           case when o_orderkey % 4 = 0 then
             concat(', "agent_summaries": [{"agent_id": "cleaner", "summary": "x"}, {"agent_id": " Orchestrator ", ',
                    '"summary": "Plan   ', cast(o_orderkey as string), '.", "bullets": ["b"]}]') else '' end, '}') as summary""",
        "o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int)) as uploaded_at",
        """case when o_orderkey % 8 <> 0 then o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int) + 2) end
           as dispatched_at""",
        """case when o_orderstatus <> 'O' then
           o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int) + cast(o_orderkey % 200 as int) - 5) end
           as completed_at""",
        "case when o_orderkey % 10 in (0, 3, 7) then o_orderkey - o_orderkey % 10 + 1 end as parent_id",
    )


JOBS = f"""jobs AS (SELECT o_orderkey AS id, o_custkey AS user_id, 'file_' || o_orderkey || '.csv' AS file_name,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE lower(substring(o_orderpriority, 3)) END AS output_format,
  {JOB_STATUS} AS status,
  '{{"status": "' || (CASE WHEN o_orderkey % 13 = 0 THEN 'pending_agent_availability'
     WHEN o_orderkey % 17 = 0 THEN 'rejected' ELSE 'done' END) || '", "record_count": ' || (o_orderkey % 9)
   || (CASE WHEN o_orderkey % 6 = 0 THEN ', "error": "Bad column"' ELSE '' END)
   || (CASE WHEN o_orderkey % 4 = 0 THEN ', "agent_summaries": [{{"agent_id": "cleaner", "summary": "x"}}, '
     || '{{"agent_id": " Orchestrator ", "summary": "Plan   ' || o_orderkey || '.", "bullets": ["b"]}}]' ELSE '' END)
   || '}}' AS summary,
  o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS uploaded_at,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate + to_minutes(CAST(o_orderkey % 1440 + 2 AS INTEGER)) END AS dispatched_at,
  CASE WHEN o_orderstatus <> 'O' THEN
    o_orderdate + to_minutes(CAST(o_orderkey % 1440 + o_orderkey % 200 - 5 AS INTEGER)) END AS completed_at,
  CASE WHEN o_orderkey % 10 IN (0, 3, 7) THEN o_orderkey - o_orderkey % 10 + 1 END AS parent_id
  FROM orders),
 staged AS (SELECT *, CASE WHEN status IN ('pending', 'queued', 'quarantined')
    AND json_extract_string(summary, '$.status') IN ('pending_agent_availability', 'rejected') THEN 'quarantined'
   WHEN status = 'pending' THEN 'queued' WHEN status = 'processing' THEN 'running'
   WHEN status IN ('complete', 'success') THEN 'succeeded' WHEN status = 'partial' THEN 'failed'
   WHEN status = 'rejected' THEN 'quarantined' ELSE status END AS cstatus FROM jobs)"""


def job_rows(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_orderkey as submission_id", "l_linenumber as record_index", "l_partkey", "l_suppkey", "l_shipdate"
    )


def users(t: Tables) -> DataFrame:
    """Customers as users: one manager per ten keys, some employees without one."""
    return t.customer.selectExpr(
        "c_custkey as id",
        "c_name as full_name",
        "case when c_custkey % 10 = 1 then 'manager' when c_custkey % 97 = 0 then 'admin' else 'employee' end as role",
        """case when c_custkey % 10 = 1 or c_custkey % 97 = 0 or c_custkey % 9 = 0 then null
           else c_custkey - c_custkey % 10 + 1 end as manager_id""",
    )


USERS = """users AS (SELECT c_custkey AS id, c_name AS full_name,
  CASE WHEN c_custkey % 10 = 1 THEN 'manager' WHEN c_custkey % 97 = 0 THEN 'admin' ELSE 'employee' END AS role,
  CASE WHEN c_custkey % 10 = 1 OR c_custkey % 97 = 0 OR c_custkey % 9 = 0 THEN NULL
       ELSE c_custkey - c_custkey % 10 + 1 END AS manager_id FROM customer)"""


def comments(t: Tables) -> DataFrame:
    """Line items as comments on their order."""
    return t.lineitem.selectExpr(
        "l_orderkey as submission_id",
        "concat('part ', cast(l_partkey as string), ' from ', cast(l_suppkey as string)) as message",
        "l_shipdate as created_at",
    )


COMMENTS = """comments AS (SELECT l_orderkey AS submission_id, 'part ' || l_partkey || ' from ' || l_suppkey AS message,
  l_shipdate AS created_at FROM lineitem)"""

# --- a general ledger with errors ---------------------------------------------------------------


def ledger(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey as idx",
        """case when o_orderkey % 101 = 0 then null when o_orderkey % 103 = 0 then 'soon'
           else date_format(o_orderdate, 'yyyy-MM-dd') end as voucher_date""",
        """case when o_orderkey % 53 = 0 then concat('E', cast(o_orderkey as string))
           else concat(cast(o_orderkey % 90 + 1 as string), '.', cast(o_orderkey % 3 + 1 as string)) end as entry_no""",
        "case when o_orderkey % 61 = 0 then '  ' else o_orderpriority end as sub_account",
        "concat('order ', cast(o_orderkey as string)) as details",
        "cast(o_custkey as string) as account_code",
        "o_orderstatus as class",
        "case when o_orderkey % 67 = 0 then null else o_orderpriority end as sub_class",
        "'IN' as country",
        "'west' as region",
        """case when o_orderkey % 71 = 0 then 'many' when o_orderkey % 73 = 0 then '-5'
           when o_orderkey % 2 = 0 then cast(o_orderkey % 500 + 1 as string) end as debit_amount""",
        """case when o_orderkey % 79 = 0 then '10' when o_orderkey % 83 = 0 then '0'
           when o_orderkey % 2 = 1 and o_orderkey % 89 <> 0 then cast(o_orderkey % 700 + 1 as string) end as credit_amount""",
    )


LEDGER = """ledger AS (SELECT o_orderkey AS idx,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN 'soon'
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS voucher_date,
  CASE WHEN o_orderkey % 53 = 0 THEN 'E' || o_orderkey ELSE (o_orderkey % 90 + 1) || '.' || (o_orderkey % 3 + 1) END AS entry_no,
  CASE WHEN o_orderkey % 61 = 0 THEN '  ' ELSE o_orderpriority END AS sub_account,
  'order ' || o_orderkey AS details, CAST(o_custkey AS VARCHAR) AS account_code, o_orderstatus AS class,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE o_orderpriority END AS sub_class, 'IN' AS country, 'west' AS region,
  CASE WHEN o_orderkey % 71 = 0 THEN 'many' WHEN o_orderkey % 73 = 0 THEN '-5'
       WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 500 + 1 AS VARCHAR) END AS debit_amount,
  CASE WHEN o_orderkey % 79 = 0 THEN '10' WHEN o_orderkey % 83 = 0 THEN '0'
       WHEN o_orderkey % 2 = 1 AND o_orderkey % 89 <> 0 THEN CAST(o_orderkey % 700 + 1 AS VARCHAR) END AS credit_amount
  FROM orders)"""

LEDGER_ERRORS = """errs AS (
  SELECT idx + 2 AS row, 0 AS chk, 'voucher_date' AS field, 'Required value is missing' AS message FROM ledger WHERE voucher_date IS NULL
  UNION ALL SELECT idx + 2, 1, 'voucher_date', 'Must be a valid date' FROM ledger WHERE voucher_date = 'soon'
  UNION ALL SELECT idx + 2, 3, 'sub_account', 'Required value is missing' FROM ledger WHERE trim(sub_account) = ''
  UNION ALL SELECT idx + 2, 7, 'sub_class', 'Required value is missing' FROM ledger WHERE sub_class IS NULL
  UNION ALL SELECT idx + 2, 10, 'entry_no', 'Must be in format ''N.N'' (e.g. 1.1, 3.2), got ''' || entry_no || '''' FROM ledger
    WHERE NOT regexp_full_match(entry_no, '\\d+\\.\\d+')
  UNION ALL SELECT idx + 2, 11, 'debit_amount/credit_amount', 'Each row must have at least one of debit_amount or credit_amount'
    FROM ledger WHERE debit_amount IS NULL AND credit_amount IS NULL
  UNION ALL SELECT idx + 2, 12, 'debit_amount/credit_amount', 'Each row must have only one of debit_amount or credit_amount, not both'
    FROM ledger WHERE debit_amount IS NOT NULL AND credit_amount IS NOT NULL
  UNION ALL SELECT idx + 2, 13, 'debit_amount', 'Must be numeric' FROM ledger WHERE debit_amount = 'many'
  UNION ALL SELECT idx + 2, 14, 'debit_amount', 'Must be greater than zero' FROM ledger WHERE TRY_CAST(debit_amount AS DOUBLE) <= 0
  UNION ALL SELECT idx + 2, 15, 'credit_amount', 'Must be numeric' FROM ledger WHERE credit_amount IS NOT NULL AND TRY_CAST(credit_amount AS DOUBLE) IS NULL
  UNION ALL SELECT idx + 2, 16, 'credit_amount', 'Must be greater than zero' FROM ledger WHERE TRY_CAST(credit_amount AS DOUBLE) <= 0)"""
