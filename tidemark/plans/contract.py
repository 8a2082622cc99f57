"""Field metadata of results, for whoever displays them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import names

PREVIEW_ROWS = 1_000


def contract_type(kind: T.DataType) -> str:
    """string, integer, number, boolean, date or datetime."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if names.is_numeric(kind):
        return "number"
    if isinstance(kind, T.DateType):
        return "date"
    return "datetime" if names.is_dated(kind) else "string"


def result_kind(op: dict) -> tuple[str, str]:
    """Kind and shape of a calculation's result."""
    kind = op["type"]
    if kind.startswith(("group_", "cross_tab_", "quarterly_")):
        return "series", "categorical_series"
    if kind in ("running_total", "percentage_change", "difference", "ratio", "absolute_value"):
        return "tabular", "table"
    return "scalar", "single_value"


def result_fields(df: DataFrame, op: dict) -> DataFrame:
    """One row per result column: label, type, role, unit, aggregation, and whether nulls occur."""
    kind, shape = result_kind(op)
    keys = op.get("group_by") or (["quarter", "period_start"] if op["type"].startswith("quarterly_") else [])
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = []
    for i, f in enumerate(df.schema.fields):
        dimension = f.name in keys or not names.is_numeric(f.dataType)
        role = ("time" if names.is_dated(f.dataType) else "dimension") if dimension else "measure"
        aggregation = op["type"] if not dimension and kind != "tabular" else None
        rows.append(
            (i, f.name, f.name.replace("_", " ").title(), contract_type(f.dataType), role, names.unit_of(f.name), aggregation, kind, shape)
        )
    meta = df.sparkSession.createDataFrame(
        rows,
        "position int, id string, label string, data_type string, role string, unit string, "
        "aggregation string, result_kind string, data_shape string",
    )
    nulls = df.agg(*[F.count_if(names.col(c).isNull()).alias(str(i)) for i, c in enumerate(df.columns)])
    flags = nulls.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("position"), (F.col(str(i)) > 0).alias("nullable")) for i in range(len(df.columns))]))
    )
    return meta.join(F.broadcast(flags), "position").orderBy("position")


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The rows shown to a user."""
    return df.limit(n)
