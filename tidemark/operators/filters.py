"""Filter operators: fifteen comparisons, null-safe, combined with and / or / not.

A positive comparison is false for null; a negative one (``neq``, ``not_contains``, ``not_in``) is
its complement, so it keeps nulls. Everything is a Column, so filters reach the scan.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import PlanError, UnknownOperatorError
from tidemark.functions import names, numbers, text
from tidemark.operators.quantiles import exact_quantile

OPERATORS = (
    "eq", "neq", "gt", "gte", "lt", "lte", "contains", "not_contains", "starts_with",
    "ends_with", "between", "in", "not_in", "is_null", "is_not_null",
)

# Other spellings of the comparison names.
ALIASES = {
    "==": "eq", "=": "eq", "equals": "eq", "equal": "eq", "equal_to": "eq", "is_equal": "eq",
    "!=": "neq", "<>": "neq", "ne": "neq", "not_equal": "neq", "not_equals": "neq", "not_equal_to": "neq",
    ">": "gt", "greater": "gt", "greater_than": "gt", "more_than": "gt",
    ">=": "gte", "ge": "gte", "greater_equal": "gte", "greater_than_or_equal": "gte", "greater_than_or_equal_to": "gte",
    "<": "lt", "less": "lt", "less_than": "lt", "below": "lt",
    "<=": "lte", "le": "lte", "less_equal": "lte", "less_than_or_equal": "lte", "less_than_or_equal_to": "lte",
    "one_of": "in", "contains_any": "in", "not_in_list": "not_in", "not in": "not_in", "nin": "not_in",
    "isnull": "is_null", "null": "is_null", "notnull": "is_not_null",
}

NEGATIONS = {"neq": "eq", "not_contains": "contains", "not_in": "in"}
ORDERED = ("gt", "gte", "lt", "lte", "between")


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def operator_name(name: str) -> str:
    """The comparison meant by a name or alias."""
    lowered = str(name).strip().lower()
    found = ALIASES.get(lowered, lowered)
    if found not in OPERATORS:
        raise UnknownOperatorError(f"Unknown comparison {name!r}; known: {list(OPERATORS)}")
    return found


def check(df: DataFrame, condition: dict) -> None:
    """Raise when a condition does not fit its column or lacks the values it needs."""
    names.require(df, condition["column"])
    op = operator_name(condition["operator"])
    kind = df.schema[condition["column"]].dataType
    value, upper = condition.get("value"), condition.get("value_to")
    if op in ("is_null", "is_not_null"):
        return
    if op in ("in", "not_in") and not isinstance(value, (list, tuple, set)):
        raise PlanError(f"{op} needs a list of values")
    if op == "between" and (value is None or upper is None):
        raise PlanError("between needs both bounds")
    if value is None:
        raise PlanError(f"{op} needs a value")
    aggregated = isinstance(value, dict)
    if op in ORDERED and names.is_numeric(kind) and None in (_number(value), _number(upper) if upper is not None else 0):
        raise PlanError(f"{op} on {condition['column']} needs numbers")
    if op in ORDERED and not aggregated and not (names.is_numeric(kind) or names.is_dated(kind)):
        raise PlanError(f"{op} needs a number or date column, {condition['column']} is {kind.simpleString()}")


def predicate(df: DataFrame, condition: dict) -> Column:
    """The condition as a Column. It is null only for a positive comparison of a null value, which
    a filter treats as false; no wrapper hides the comparison, so it can be pushed to the scan."""
    check(df, condition)
    op = operator_name(condition["operator"])
    c = _c(condition["column"])
    if op in NEGATIONS:
        return ~predicate(df, {**condition, "operator": NEGATIONS[op]}) | c.isNull()
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    kind = df.schema[condition["column"]].dataType
    value, cased = condition.get("value"), bool(condition.get("case_sensitive", False))
    if isinstance(value, dict):
        return _against_aggregate(df, condition, op)
    return _compare(c, kind, op, value, condition.get("value_to"), cased)


def _compare(c: Column, kind: T.DataType, op: str, value, upper, cased: bool) -> Column:
    if op == "eq":
        if names.is_text(kind) and isinstance(value, str):
            return text.fold(c, cased) == F.lit(value if cased else value.lower().strip())
        if names.is_numeric(kind) and _number(value) is None:
            return F.lit(False)
        return c == _literal(value, kind)
    if op == "gt":
        return c > _literal(value, kind)
    if op == "gte":
        return c >= _literal(value, kind)
    if op == "lt":
        return c < _literal(value, kind)
    if op == "lte":
        return c <= _literal(value, kind)
    if op == "between":
        return c.between(_literal(value, kind), _literal(upper, kind))
    if op == "in":
        if names.is_text(kind):
            return text.match_key(c, cased).isin(_wanted_keys(value, cased))
        wanted = [_number(v) if names.is_numeric(kind) else v for v in value]
        return c.isin([v for v in wanted if v is not None])
    shown, wanted = c.cast("string"), str(value)
    if not cased:
        shown, wanted = F.lower(shown), wanted.lower()
    test = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[op]
    return test(shown, F.lit(wanted))


def _literal(value, kind: T.DataType) -> Column:
    """A value in the type of its column. Texts are read as ISO dates or numbers; a text that is no
    number equals nothing, and one that is no date is an error."""
    if isinstance(value, str) and names.is_dated(kind):
        try:
            return F.lit(datetime.datetime.fromisoformat(value).isoformat()).cast("timestamp_ntz").cast(kind)
        except ValueError as error:
            raise PlanError(f"Not a date: {value!r}") from error
    if isinstance(value, str) and names.is_numeric(kind):
        return F.lit(_number(value))
    return F.lit(value)


def _number(value) -> float | int | None:
    if not isinstance(value, str):
        return value
    try:
        return float(value)
    except ValueError:
        return None


def _wanted_keys(values, cased: bool) -> list[str]:
    import re

    keys = set()
    for v in values:
        raw = str(v or "").strip()
        if raw:
            shown = raw if cased else raw.lower()
            keys.add(re.sub("[^A-Za-z0-9]+", "", shown) or shown)
    return sorted(keys)


def stripped_number(c: Column) -> Column:
    """A number, or a text read as number after removing currency signs and commas."""
    return numbers.to_number(F.translate(c.cast("string"), numbers.CURRENCY_SYMBOLS + ",", ""))


def aggregate_value(df: DataFrame, spec: dict, default_column: str):
    """The aggregate a condition is compared with: a scalar subquery, or a literal for a median.

    ``spec``: ``function`` (avg, mean, average, sum, min, max, median, count, std), optional
    ``column`` and ``where`` (one ``{column, value}`` text equality on the rows aggregated).
    """
    fn = str(spec.get("function") or spec.get("agg_func") or "avg").strip().lower()
    column = spec.get("column") or default_column
    names.require(df, column)
    rows = df
    where = spec.get("where")
    if where:
        names.require(df, where["column"])
        wanted = str(where["value"]).strip().lower()
        rows = rows.filter(text.fold(_c(where["column"]).cast("string")) == wanted)
    c = _c(column)
    number = c.cast("double") if names.is_numeric(df.schema[column].dataType) else stripped_number(c)
    if fn == "median":
        return F.lit(exact_quantile(rows.select(number.alias("v")), "v", 0.5)).cast("double")
    known = {
        "avg": F.avg, "mean": F.avg, "average": F.avg, "min": F.min, "max": F.max,
        "count": F.count, "std": F.stddev_samp,
        "sum": lambda n: F.coalesce(F.sum(n), F.lit(0.0)),
    }
    if fn not in known:
        raise UnknownOperatorError(f"Unknown aggregate {fn!r} in a filter")
    return rows.select(number.alias("n")).agg(known[fn]("n")).scalar()


def _against_aggregate(df: DataFrame, condition: dict, op: str) -> Column:
    c = _c(condition["column"])
    numeric = names.is_numeric(df.schema[condition["column"]].dataType)
    left = c.cast("double") if numeric else stripped_number(c)
    right = aggregate_value(df, condition["value"], condition["column"])
    tests = {"eq": left == right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}
    if op not in tests:
        raise PlanError(f"{op} cannot be compared with an aggregate")
    return tests[op]


def complement(condition: Column) -> Column:
    """True exactly where a filter on ``condition`` would not keep the row."""
    return ~F.coalesce(condition, F.lit(False))


def tree(df: DataFrame, node: dict) -> Column:
    """A nested predicate: leaves are conditions, inner nodes have ``all`` or ``any``; both may be
    ``negated``."""
    if "all" in node or "any" in node:
        parts = [tree(df, child) for child in node.get("all", node.get("any"))]
        if not parts:
            raise PlanError("Empty predicate group")
        combined = reduce(lambda a, b: (a & b) if "all" in node else (a | b), parts)
    else:
        combined = predicate(df, node)
    return complement(combined) if node.get("negated") else combined


def apply_filter(
    df: DataFrame, conditions: list[dict] | dict, logic: str = "and", mode: str = "keep",
    select: list[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Filter, then project, then limit. ``mode='drop'`` keeps exactly the rows ``keep`` removes."""
    if select:
        names.require(df, select)
    if logic not in ("and", "or") or mode not in ("keep", "drop"):
        raise PlanError(f"Unknown logic {logic!r} or mode {mode!r}")
    node = conditions if isinstance(conditions, dict) else {"all" if logic == "and" else "any": conditions}
    out = df
    if node.get("all", node.get("any", True)):
        keep = tree(df, node)
        out = df.filter(keep if mode == "keep" else complement(keep))
    out = out.select(*select) if select else out
    return out.limit(limit) if limit else out


def filter_by_values(df: DataFrame, column: str, values: DataFrame, negate: bool = False) -> DataFrame:
    """``in`` / ``not_in`` against a one-column table of any size, by the same comparison keys.

    The value table is made distinct first, so a value repeated any number of times is one join row;
    a text occurring in a third of the rows meets one partner and stays a plain probe.
    """
    names.require(df, column)
    wanted = values.columns[0]
    if names.is_text(df.schema[column].dataType):
        left, right = text.match_key(_c(column)), text.match_key(_c(wanted))
        values = values.filter(text.strip(_c(wanted)) != "")
    else:
        left, right = _c(column), _c(wanted)
    keys = values.select(right.alias("__wanted")).filter("__wanted is not null").distinct()
    return df.join(keys, left == F.col("__wanted"), "left_anti" if negate else "left_semi")


def row_search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose JSON text contains the query, case ignored."""
    row = F.lower(F.to_json(F.struct(*[_c(c) for c in df.columns])))
    return df.filter(F.contains(row, F.lit(query.lower())))


def columns_search(df: DataFrame, columns: list[str], query: str, exact: dict | None = None) -> DataFrame:
    """Rows where one of the columns contains the query and the named columns equal their values."""
    names.require(df, columns + list(exact or {}))
    out = df.filter(text.any_contains([_c(c) for c in columns], query)) if query else df
    for column, value in (exact or {}).items():
        out = out.filter(_c(column) == F.lit(value))
    return out


def newest_like(df: DataFrame, columns: list[str], query: str, order_by: list, limit: int) -> DataFrame:
    """ILIKE ``%query%`` on any of the columns, the newest ``limit`` rows."""
    like = reduce(lambda a, b: a | b, [_c(c).ilike(f"%{query}%") for c in columns])
    return df.filter(like).orderBy(*order_by).limit(limit)


def time_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows in a time range; both bounds are optional and inclusive."""
    out = df
    if start is not None:
        out = out.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return out


def owner_scope(df: DataFrame, owner: str, role: str, user_id, users: DataFrame | None = None) -> DataFrame:
    """Rows a user may see: an employee their own, a manager those of their reports, an admin all.

    ``users`` has ``id`` and ``manager_id``.
    """
    if role == "admin":
        return df
    if role == "employee":
        return df.filter(F.col(owner) == F.lit(user_id))
    if role == "manager":
        reports = users.filter(F.col("manager_id") == F.lit(user_id)).select(F.col("id").alias("__id"))
        return df.join(reports, F.col(owner) == F.col("__id"), "left_semi")
    raise PlanError(f"Unknown role {role!r}")
