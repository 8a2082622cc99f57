"""Ops by name. A user op is a function ``fn(df, op) -> DataFrame`` registered under a new name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import PlanError, UnknownOperatorError
from tidemark.functions import names
from tidemark.operators import calculations, cleaning, columns, filters, tables

Op = Callable[[DataFrame, dict], DataFrame]

CLEANING: dict[str, Op] = {
    "trim_whitespace": lambda df, o: cleaning.trim_whitespace(df, o.get("columns")),
    "normalize_column_names": lambda df, o: columns.normalize_names(df, o.get("style", "snake_case")),
    "drop_duplicates": lambda df, o: cleaning.drop_duplicates(df, o.get("subset"), o.get("keep", "first"), o.get("order_by")),
    "fill_nulls": lambda df, o: cleaning.fill_nulls(df, o["columns"], o["strategy"], o.get("value")),
    "drop_nulls": lambda df, o: cleaning.drop_nulls(df, o.get("columns"), o.get("how", "any")),
    "normalize_date": lambda df, o: cleaning.normalize_date(
        df, o["column"], o.get("target_format", "%Y-%m-%d"), o.get("dayfirst", False), o.get("errors", "coerce")
    ),
    "normalize_currency": lambda df, o: cleaning.normalize_currency(df, o["column"]),
    "normalize_number": lambda df, o: cleaning.normalize_number(df, o["column"]),
    "normalize_text_case": lambda df, o: cleaning.text_case(df, o["case"], o.get("columns")),
    "replace_values": lambda df, o: cleaning.replace_values(df, o["column"], o["mapping"]),
    "strip_currency_symbols": lambda df, o: cleaning.strip_currency_symbols(df, o["column"]),
    "remove_commas_from_numbers": lambda df, o: cleaning.remove_commas(df, o["column"]),
    "coerce_column_type": lambda df, o: cleaning.coerce_type(df, o["column"], o["target_type"], o.get("errors", "coerce")),
    "remove_empty_rows": lambda df, o: cleaning.drop_empty_rows(df),
    "remove_empty_columns": lambda df, o: columns.drop_empty(df),
    "rename_columns": lambda df, o: columns.rename(df, o["mapping"]),
    "reorder_columns": lambda df, o: columns.reorder(df, o["columns"]),
    "absolute_value": lambda df, o: cleaning.absolute_value(df, o.get("columns")),
    "normalize_categorical_values": lambda df, o: cleaning.normalize_categories(df, o.get("columns"), o.get("most", cleaning.MAX_CATEGORIES)),
}

# Ops that look at the data before the plan is fixed; a stream cannot run them.
DATA_DEPENDENT = ("fill_nulls", "remove_empty_columns", "normalize_categorical_values", "filter_prep", "drop_duplicates")

ACTIONS: dict[str, Op] = {
    "filter_prep": lambda df, o: cleaning.prepare_for_filter(df, o.get("steps", cleaning.PREP_STEPS)),
    "filter": lambda df, o: filters.apply_filter(
        df, o["conditions"], o.get("logic", "and"), o.get("mode", "keep"), o.get("select"), o.get("limit")
    ),
    "select_columns": lambda df, o: columns.project(df, o["columns"]),
    "drop_columns": lambda df, o: columns.drop(df, o["columns"]),
    "sort": lambda df, o: tables.sort(df, [tuple(k) for k in o["keys"]]),
    "limit": lambda df, o: df.limit(o["n"]),
}

KEEPS_ROWS = {*CLEANING, "select_columns", "drop_columns", "sort"} - {"drop_duplicates", "drop_nulls", "remove_empty_rows"}

# Other spellings of op names.
OP_ALIASES = {
    "remove_duplicates": "drop_duplicates", "deduplicate": "drop_duplicates",
    "trim_spaces": "trim_whitespace", "strip_whitespace": "trim_whitespace",
    "drop_blank_rows": "remove_empty_rows", "drop_blank_columns": "remove_empty_columns",
    "abs": "absolute_value", "absolute": "absolute_value",
}

_user_ops: dict[str, Op] = {}


def _calculation(df: DataFrame, op: dict) -> DataFrame:
    return calculations.calculate(df, {**op, "type": op["calculation"]}).df


def known_ops() -> list[str]:
    return sorted({*CLEANING, *ACTIONS, "calculate", *_user_ops})


def register_op(name: str, fn: Op, replace: bool = False) -> None:
    """Make ``fn`` available under ``name`` in op lists."""
    if not callable(fn) or not name:
        raise PlanError("An op needs a name and a function")
    if name in known_ops() and not replace:
        raise PlanError(f"Op {name!r} exists")
    _user_ops[name] = fn


def find(name: str) -> Op:
    """The function of an op name; unknown names are an error that lists the known ones."""
    for table in (_user_ops, CLEANING, ACTIONS):
        if name in table:
            return table[name]
    if name in OP_ALIASES:
        return find(OP_ALIASES[name])
    if name == "calculate":
        return _calculation
    raise UnknownOperatorError(f"Unknown op {name!r}; known: {known_ops()}")


def keeps_rows(name: str) -> bool:
    """Whether an op is known to give as many rows as it gets."""
    name = OP_ALIASES.get(name, name)
    return name not in _user_ops and name in KEEPS_ROWS


def warnings_of(df: DataFrame, op: dict) -> DataFrame | None:
    """What an op has to say about the table it gets, as rows ``warning``, or None."""
    name = OP_ALIASES.get(op["type"], op["type"])
    if name == "calculate":
        return calculations.warnings_of(df, {**op, "type": op["calculation"]})
    if name == "normalize_categorical_values":
        return cleaning.uncategorized(df, op.get("columns"), op.get("most", cleaning.MAX_CATEGORIES))
    if name == "absolute_value" and not names.expand_numeric(df, op.get("columns")):
        return df.sparkSession.createDataFrame([("absolute_value found no numeric column.",)], "warning string")
    return None


def check_coverage(wanted: list[str], table: dict) -> None:
    """Raise unless a table of functions covers exactly the given names."""
    missing, extra = sorted(set(wanted) - set(table)), sorted(set(table) - set(wanted))
    if missing or extra:
        raise PlanError(f"Functions missing for {missing}, unknown {extra}")


def scalar_op(name: str, fn: Callable[[pd.Series], pd.Series], returns: str) -> None:
    """Register a vectorized scalar function; ops give ``column`` and optionally ``output``.

    The function gets whole Arrow batches as pandas Series, never single rows.
    """
    udf = F.pandas_udf(fn, returns)
    register_op(name, lambda df, o: df.withColumn(o.get("output", o["column"]), udf(names.col(o["column"]))))


def grouped_op(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
    """Register a function over whole groups; ops give ``group_by``.

    A group goes to one task as one pandas frame, so this is for keys whose groups are known to be
    small; the aggregations of ``calculations`` have no such limit.
    """
    register_op(name, lambda df, o: df.groupBy(*o["group_by"]).applyInPandas(fn, schema))


def merged_op(
    name: str, partial: Callable[[pd.DataFrame], dict], state: str, finish: Callable[[pd.DataFrame], dict], returns: str,
) -> None:
    """Register a function over groups of any size; ops give ``group_by``.

    ``partial`` turns some rows of a group into one state (a dict with the columns of ``state``), ``finish`` all
    states of a group into its result (the columns of ``returns``); states must not depend on how the rows
    are cut. Rows are reduced batch by batch where they lie, so a group with a third of all rows sends one
    state a batch, and only states are shuffled.
    """

    def run(df: DataFrame, op: dict) -> DataFrame:
        keys = op["group_by"]
        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        fields = [f.split()[0].strip("`") for f in returns.split(",")]

        def reduced(batches):
            for pdf in batches:
                rows = [
                    {**dict(zip(keys, key)), **partial(part)}
                    for key, part in pdf.groupby(keys, dropna=False, sort=False)
                ]
                if rows:
                    yield pd.DataFrame(rows)

        def finished(key, states):
            return pd.DataFrame([{**dict(zip(keys, key)), **finish(states)}], columns=[*keys, *fields])

        states = df.mapInPandas(reduced, f"{kinds}, {state}")
        return states.groupBy(*keys).applyInPandas(finished, f"{kinds}, {returns}")

    register_op(name, run)
