"""General-ledger checks and derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, names, numbers, text

# Required ledger columns and the two amount columns.
REQUIRED = (
    "voucher_date", "entry_no", "sub_account", "details", "account_code",
    "class", "sub_class", "country", "region",
)
AMOUNTS = ("debit_amount", "credit_amount")
FIRST_DATA_ROW = 2
PER_CHECK = 25
IN_TOTAL = 100

MISSING = "Required value is missing"
BAD_DATE = "Must be a valid date"
NO_SIDE = "Each row must have at least one of debit_amount or credit_amount"
BOTH_SIDES = "Each row must have only one of debit_amount or credit_amount, not both"
BAD_ENTRY = "Must be in format 'N.N' (e.g. 1.1, 3.2), got '"
NOT_NUMERIC = "Must be numeric"
NOT_POSITIVE = "Must be greater than zero"


def missing_columns(df: DataFrame) -> list[str]:
    """Ledger columns the table lacks; names are compared without case and outer blanks."""
    present = {c.strip().lower() for c in df.columns}
    return [c for c in REQUIRED + AMOUNTS if c not in present]


def _checks(df: DataFrame) -> list[tuple[str, Column, Column]]:
    """Field, message and flag of every row check, in report order."""
    at = {c.strip().lower(): names.col(c) for c in df.columns}
    found: list[tuple[str, Column, Column]] = []
    for field in REQUIRED:
        if field not in at:
            continue
        shown = at[field].cast("string")
        found.append((field, F.lit(MISSING), shown.isNull() | (text.strip(shown) == "")))
        if field == "voucher_date":
            parsed = dates.as_timestamp(at[field], df.select(at[field]).schema[0].dataType)
            found.append((field, F.lit(BAD_DATE), shown.isNotNull() & parsed.isNull()))
    if "entry_no" in at:
        shown = at["entry_no"].cast("string")
        message = F.concat(F.lit(BAD_ENTRY), shown, F.lit("'"))
        found.append(("entry_no", message, ~text.strip(shown).rlike(r"\A\d+\.\d+\z")))
    debit, credit = (at.get(a) for a in AMOUNTS)
    if debit is not None and credit is not None:
        sides = "debit_amount/credit_amount"
        found.append((sides, F.lit(NO_SIDE), debit.isNull() & credit.isNull()))
        found.append((sides, F.lit(BOTH_SIDES), debit.isNotNull() & credit.isNotNull()))
        for field, c in zip(AMOUNTS, (debit, credit)):
            number = numbers.to_number(c)
            found.append((field, F.lit(NOT_NUMERIC), c.isNotNull() & number.isNull()))
            found.append((field, F.lit(NOT_POSITIVE), number <= 0))
    return found


def row_errors(df: DataFrame, index: str) -> DataFrame:
    """Every error of every row: ``row, field, message, check``. ``index`` counts data rows from 0;
    the reported row is the line in the file, whose first line is the header."""
    checks = _checks(df)
    hits = F.array(
        *[
            F.when(
                F.coalesce(flag, F.lit(False)),
                F.struct(F.lit(i).alias("check"), F.lit(field).alias("field"), message.alias("message")),
            )
            for i, (field, message, flag) in enumerate(checks)
        ]
    )
    return (
        df.select(
            (F.col(index) + FIRST_DATA_ROW).cast("bigint").alias("row"),
            F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("e"),
        )
        .select("row", "e.field", "e.message", "e.check")
    )


def error_report(
    df: DataFrame, index: str, per_check: int | None = PER_CHECK, in_total: int | None = IN_TOTAL
) -> DataFrame:
    """The report shown to a user, in report order: the first ``per_check`` errors of each check and
    ``in_total`` of all; None sets no limit. The format check of ``entry_no`` has no limit of its own."""
    found = row_errors(df, index)
    if not (per_check is None and in_total is None):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("check").orderBy("row")))
    if in_total is not None:
        found = found.filter(F.col("rank") <= in_total)
    if per_check is not None:
        found = found.filter(F.startswith("message", F.lit(BAD_ENTRY)) | (F.col("rank") <= per_check))
    found = found.orderBy("check", "row")
    return (found if in_total is None else found.limit(in_total)).select("row", "field", "message")


def positive(c: Column) -> Column:
    """An amount above zero, else null."""
    number = numbers.to_number(c)
    return F.when(number > 0, number)


def derive(df: DataFrame) -> DataFrame:
    """Amounts above zero, and ``entry_no`` ``3.2`` as ``entry_group`` 3 and ``entry_line`` 2."""
    parts = F.split(text.strip(F.col("entry_no").cast("string")), r"\.")
    return df.withColumns(
        {
            "debit_amount": positive(F.col("debit_amount")),
            "credit_amount": positive(F.col("credit_amount")),
            "entry_group": F.try_element_at(parts, F.lit(1)).try_cast("int"),
            "entry_line": F.try_element_at(parts, F.lit(2)).try_cast("int"),
        }
    )
