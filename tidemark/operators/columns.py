"""Projection and column operators. Apart from ``drop_empty`` they read the schema only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import PlanError
from tidemark.functions import names


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def has_value(df: DataFrame, columns: list[str], how: str = "any") -> Column:
    """The rows ``na.drop`` keeps, for names of any kind: with ``any`` every column must have a value,
    with ``all`` at least one. NaN is no value."""
    if how not in ("any", "all"):
        raise PlanError(f"Unknown mode {how!r}")
    present = []
    for name in columns:
        found = col(name).isNotNull()
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            found = found & ~F.isnan(col(name))
        present.append(found)
    return reduce((lambda a, b: a & b) if how == "any" else (lambda a, b: a | b), present)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the listed columns in the listed order; unknown names are an error."""
    names.require(df, columns)
    return df.select(*[col(c) for c in columns])


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    """Remove the listed columns; unknown names are an error."""
    names.require(df, columns)
    return df.drop(*columns)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by mapping; names that are not in the table are ignored."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def reorder(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listed columns first, the others behind in their old order."""
    first = [c for c in columns if c in df.columns]
    return df.select(*[col(c) for c in first], *[col(c) for c in df.columns if c not in first])


def normalize_names(df: DataFrame, style: str = "snake_case") -> DataFrame:
    """All names in one style; equal results are numbered so that no column is lost."""
    return df.toDF(*names.unique_names([names.styled(c, style) for c in df.columns]))


def normalize_headers(df: DataFrame, ledger: bool = False) -> DataFrame:
    """Header names of an uploaded file by the alias table."""
    form = names.ledger_name if ledger else names.source_name
    return df.toDF(*names.unique_names([form(c) for c in df.columns]))


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename finance columns to their canonical targets; other columns keep their name."""
    wanted = [names.finance_target(c) or c for c in df.columns]
    return df.toDF(*names.unique_names(wanted))


def drop_empty(df: DataFrame) -> DataFrame:
    """Remove columns in which every value is null: one aggregate over all columns."""
    counts = df.agg(*[F.count(col(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if counts[i] > 0])


def family(df: DataFrame, reference: str) -> DataFrame:
    """The columns that belong to a reference such as ``loans``."""
    return df.select(*[col(c) for c in names.family(df.columns, reference)])


def hide_internal(df: DataFrame) -> DataFrame:
    """Drop columns whose name starts with an underscore and rows that are left empty."""
    shown = [c for c in df.columns if not c.startswith("_")]
    return df.select(*[col(c) for c in shown]).filter(has_value(df, shown, "all"))


def hide_internal_keys(df: DataFrame, column: str) -> DataFrame:
    """The same for a map column: drop ``_`` keys, then rows whose map is left empty."""
    kept = F.map_filter(F.col(column), lambda k, _v: ~F.startswith(k, F.lit("_")))
    return df.withColumn(column, kept).filter(F.size(column) > 0)


def modified_columns(before: list[str], after: list[str]) -> list[str]:
    """Names in only one of the two lists, sorted."""
    return sorted(set(before) ^ set(after))
