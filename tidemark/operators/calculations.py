"""The 24 calculations: scalar, grouped, quarterly, cross-tab, conditional, row-wise, ordered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import PlanError, UnknownOperatorError
from tidemark.functions import dates, names, numbers, text
from tidemark.operators import cleaning, columns, ordered
from tidemark.operators.quantiles import exact_quantiles


_c = columns.col

def _number(df: DataFrame, column: str) -> Column:
    names.require(df, column)
    if not names.is_numeric(df.schema[column].dataType):
        raise PlanError(f"Column {column} must be numeric")
    return _c(column)


# --- scalar -------------------------------------------------------------------------------------

SIMPLE: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double"),
    "mean": F.avg,
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
    "count": F.count,
    "variance": F.var_samp,
    "standard_deviation": F.stddev_samp,
}
ANY_TYPE = ("count", "count_distinct")


def scalar(df: DataFrame, function: str, column: str, output: str | None = None) -> DataFrame:
    """One row, one column: the aggregate of a column, rounded to cents for money names."""
    return scalars(df, [(function, column, output)])


def scalars(df: DataFrame, wanted: list[tuple[str, str, str | None]]) -> DataFrame:
    """Several scalar calculations as one row. All plain aggregates share a single pass.

    Distinct counts group the values first and count the groups, and medians are found by
    bracketing, all columns together, so neither gathers the values of a column in one task.
    """
    for _, column, _ in wanted:
        names.require(df, column)
    halves = [column for function, column, _ in wanted if function == "median"]
    for column in halves:
        _number(df, column)  # refuses what is no number
    medians = exact_quantiles(df, halves, 0.5) if halves else {}
    shown: dict[str, Column] = {}
    plain: dict[str, Column] = {}
    for function, column, output in wanted:
        name = output or f"{function}_{column}"
        c = _c(column) if function in ANY_TYPE else _number(df, column)
        if function == "median":
            shown[name] = numbers.round_money(F.lit(medians[column]).cast("double"), name)
        elif function == "count_distinct":
            shown[name] = df.select(c.alias("v")).filter("v is not null").distinct().agg(F.count("v")).scalar()
        elif function in SIMPLE:
            value = SIMPLE[function](c)
            plain[name] = value if function == "count" else numbers.round_money(value, name)
            shown[name] = names.col(name)
        else:
            raise UnknownOperatorError(f"Unknown scalar calculation {function!r}")
    base = df.agg(*[v.alias(k) for k, v in plain.items()]) if plain else df.sparkSession.range(1)
    return base.select(*[v.alias(k) for k, v in shown.items()])


# --- grouped ------------------------------------------------------------------------------------


def _present(df: DataFrame, keys: list[str]) -> DataFrame:
    names.require(df, keys)
    return df.filter(columns.has_value(df, keys))


def group(df: DataFrame, function: str, column: str, group_by: list[str], output: str | None = None) -> DataFrame:
    """``sum``, ``mean`` or ``count`` per group; rows with a null key are left out."""
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    name = output or f"{function}_{column}"
    rows = _present(df, keys)
    if function == "count":
        value = F.count(F.lit(1))
    elif function == "sum":
        value = numbers.round_money(F.coalesce(F.sum(_number(df, column)), F.lit(0)), name)
    elif function == "mean":
        value = numbers.round_money(F.avg(_number(df, column)), name)
    else:
        raise UnknownOperatorError(f"Unknown grouped calculation {function!r}")
    return rows.groupBy(*[_c(k) for k in keys]).agg(value.alias(name))


def cross_tab(df: DataFrame, function: str, column: str, group_by: list[str], output: str | None = None) -> DataFrame:
    """Grouped calculation over two or more dimensions, long form."""
    if len(group_by) < 2:
        raise PlanError("A cross tab needs at least two dimensions")
    return group(df, function, column, group_by, output)


def cross_tab_wide(df: DataFrame, function: str, column: str, row: str, across: str, values: list) -> DataFrame:
    """The wide variant for stated column values: a missing cell is 0 for sum and count."""
    rows = _present(df, [row, across])
    agg = {"sum": F.sum, "mean": F.avg, "count": lambda _c: F.count(F.lit(1))}[function](_c(column))
    wide = rows.groupBy(_c(row)).pivot(across, values).agg(agg)
    return wide if function == "mean" else wide.na.fill(0)


def quarterly(df: DataFrame, function: str, column: str, date_column: str, output: str | None = None) -> DataFrame:
    """``sum``, ``mean`` or ``count`` per calendar quarter, in order; undated rows are left out."""
    names.require(df, [column, date_column])
    name = output or f"quarterly_{function}_{column}"
    when = dates.as_timestamp(_c(date_column), df.schema[date_column].dataType)
    value = F.lit(1) if function == "count" else _number(df, column)
    rows = df.select(F.trunc(when.cast("date"), "quarter").alias("__start"), value.alias("__value"))
    agg = {
        "sum": lambda: numbers.round_money(F.coalesce(F.sum("__value"), F.lit(0)), name),
        "mean": lambda: numbers.round_money(F.avg("__value"), name),
        "count": lambda: F.count(F.lit(1)),
    }[function]()
    return (
        rows.filter("__start is not null")
        .groupBy("__start")
        .agg(agg.alias(name))
        .orderBy("__start")
        .select(
            dates.quarter_label(F.col("__start")).alias("quarter"),
            name,
            F.date_format("__start", "yyyy-MM-dd").alias("period_start"),
        )
    )


def conditional_percentage(
    df: DataFrame, filter_column: str, filter_value, denominator_column: str | None = None,
    denominator_value=None, output: str | None = None,
) -> DataFrame:
    """Share in percent of rows that match, of all rows or of those matching a second condition.

    One row: the percentage, its numerator and its denominator. A zero denominator stops the job.
    """
    names.require(df, [filter_column] + ([denominator_column] if denominator_column else []))
    name = (output or f"pct_{filter_column}_{filter_value}").replace(" ", "_").lower()

    def matches(column: str, value) -> Column:
        same = text.fold(_c(column).cast("string")) == F.lit(str(value).lower().strip())
        return F.coalesce(same, F.lit(False))

    base = F.lit(True)
    if denominator_column and denominator_value is not None:
        base = matches(denominator_column, denominator_value)
    counts = df.agg(
        F.count_if(base & matches(filter_column, filter_value)).alias("n"), F.count_if(base).alias("d")
    )
    none = F.raise_error(F.lit("conditional percentage: no row in the denominator"))
    return counts.select(
        F.when(F.col("d") == 0, none.cast("double")).otherwise(numbers.percent(F.col("n"), F.col("d"), 2)).alias(name),
        F.col("n").alias(f"{name}_numerator"),
        F.col("d").alias(f"{name}_denominator"),
    )


# --- row-wise -----------------------------------------------------------------------------------


def difference(df: DataFrame, column: str, secondary: str, output: str | None = None) -> DataFrame:
    name = output or f"diff_{column}_{secondary}"
    return df.withColumn(name, numbers.round_money(_number(df, column) - _number(df, secondary), name))


def ratio(df: DataFrame, column: str, secondary: str, output: str | None = None) -> DataFrame:
    """Row-wise quotient; null where the denominator is zero."""
    name = output or f"ratio_{column}_{secondary}"
    return df.withColumn(
        name, numbers.round_money(numbers.ratio(_number(df, column), _number(df, secondary)), name)
    )


def zero_denominators(secondary: str) -> Column:
    """How many rows a ratio set to null; for ``observe`` or an aggregate."""
    return F.count_if(_c(secondary).cast("double") == 0)


def absolute(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    if column == names.ALL_NUMERIC:
        return cleaning.absolute_value(df)
    return df.withColumn(output or column, F.abs(_number(df, column)))


# --- ordered ------------------------------------------------------------------------------------


def running_total(
    df: DataFrame, column: str, sort_by: list[str], partition_by: list[str] | None = None, output: str | None = None
) -> DataFrame:
    """Cumulative sum in order; a null value gives null and does not break the sum.

    Rows equal in ``sort_by`` are taken in an order of their own that does not change between runs.
    """
    name = output or f"running_total_{column}"
    _number(df, column)
    out = ordered.running(df, partition_by or [], sort_by, {name: ordered.Running("sum", column)})
    shown = F.when(_c(column).isNotNull(), _c(name))
    for key in partition_by or []:
        shown = F.when(_c(key).isNotNull(), shown)
    return out.withColumn(name, numbers.round_money(shown, name))


def percentage_change(
    df: DataFrame, column: str, sort_by: list[str], partition_by: list[str] | None = None, output: str | None = None
) -> DataFrame:
    """Change against the row before, null values standing for the last known one."""
    name = output or f"pct_change_{column}"
    _number(df, column)
    out = ordered.running(
        df, partition_by or [], sort_by,
        {"__now": ordered.Running("last", column), "__before": ordered.Running("last_before", column)},
    )
    shown = numbers.ratio(F.col("__now"), F.col("__before")) - 1
    for key in partition_by or []:
        shown = F.when(_c(key).isNotNull(), shown)
    return out.withColumn(name, shown).drop("__now", "__before")


def partition_hints(df: DataFrame, column: str, sort_by: list[str]) -> DataFrame:
    """Text columns that look like a missing partition: more than one and under half as many
    distinct values as rows. One aggregate with bounded sketches."""
    targets = [c for c in names.text_columns(df) if c != column and c not in sort_by]
    if not targets:
        return df.sparkSession.createDataFrame([], "column string, distinct_share double")
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.approx_count_distinct(_c(c)).alias(f"d{i}") for i, c in enumerate(targets)],
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n")) for i, c in enumerate(targets)])
    )
    return (
        stats.select("rows", pairs.alias("p"))
        .filter("p.n > 1 and p.n < rows * 0.5")
        .select("p.column", numbers.ratio(F.col("p.n"), F.col("rows")).alias("distinct_share"))
    )


# --- op records ---------------------------------------------------------------------------------


@dataclass
class Calculated:
    """Result of one calculation op: a new table, or a one-row table of metrics."""

    kind: str
    df: DataFrame
    warnings: list[str] = field(default_factory=list)


def _sort(op: dict) -> list[str]:
    if not op.get("sort_by"):
        raise PlanError(f"{op['type']} needs sort_by")
    return [op["sort_by"]] if isinstance(op["sort_by"], str) else list(op["sort_by"])


def _parts(op: dict) -> list[str]:
    given = op.get("partition_by") or []
    return [given] if isinstance(given, str) else list(given)


def _grouped(function: str, fn):
    return lambda df, op: Calculated("table", fn(df, function, op.get("column"), op["group_by"], op.get("output_column")))


def _quarter(function: str):
    return lambda df, op: Calculated(
        "table", quarterly(df, function, op["column"], op["date_column"], op.get("output_column"))
    )


def _scalar(function: str):
    return lambda df, op: Calculated("scalar", scalar(df, function, op["column"], op.get("output_column")))


CALCULATIONS: dict[str, Callable[[DataFrame, dict], Calculated]] = {
    **{f: _scalar(f) for f in (*SIMPLE, "median", "count_distinct")},
    **{f"group_{f}": _grouped(f, group) for f in ("sum", "mean", "count")},
    **{f"cross_tab_{f}": _grouped(f, cross_tab) for f in ("sum", "mean", "count")},
    **{f"quarterly_{f}": _quarter(f) for f in ("sum", "mean", "count")},
    "running_total": lambda df, op: Calculated(
        "table", running_total(df, op["column"], _sort(op), _parts(op), op.get("output_column"))
    ),
    "percentage_change": lambda df, op: Calculated(
        "table", percentage_change(df, op["column"], _sort(op), _parts(op), op.get("output_column"))
    ),
    "difference": lambda df, op: Calculated(
        "table", difference(df, op["column"], op["secondary_column"], op.get("output_column"))
    ),
    "ratio": lambda df, op: Calculated(
        "table", ratio(df, op["column"], op["secondary_column"], op.get("output_column"))
    ),
    "absolute_value": lambda df, op: Calculated("table", absolute(df, op["column"], op.get("output_column"))),
    "conditional_percentage": lambda df, op: Calculated(
        "scalar",
        conditional_percentage(
            df, op["filter_column"], op["filter_value"], op.get("denominator_filter_column"),
            op.get("denominator_filter_value"), op.get("output_column"),
        ),
    ),
}


def warnings_of(df: DataFrame, op: dict) -> DataFrame | None:
    """What a calculation has to say about its input, as rows ``warning``; None where it never has anything.
    At most one small aggregate."""
    kind = op.get("type")
    if kind == "ratio":
        found = df.agg(zero_denominators(op["secondary_column"]).alias("n")).where("n > 0")
        text = F.concat(F.col("n").cast("string"), F.lit(f" rows have a zero in {op['secondary_column']}; their ratio is null."))
        return found.select(text.alias("warning"))
    if kind in ("running_total", "percentage_change") and not _parts(op):
        found = partition_hints(df, op["column"], _sort(op)).agg(F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("c"))
        return found.where("c <> ''").select(F.concat(F.lit(f"{kind} has no partition_by, but these columns look like one: "), F.col("c")).alias("warning"))
    if kind == "absolute_value" and op.get("column") == names.ALL_NUMERIC and not names.expand_numeric(df, None):
        return df.sparkSession.createDataFrame([("absolute_value found no numeric column.",)], "warning string")
    return None


def calculate(df: DataFrame, op: dict) -> Calculated:
    """Run one calculation op by its ``type``."""
    fn = CALCULATIONS.get({"abs": "absolute_value", "absolute": "absolute_value"}.get(op.get("type"), op.get("type")))
    if fn is None:
        raise UnknownOperatorError(f"Unknown calculation {op.get('type')!r}; known: {sorted(CALCULATIONS)}")
    return fn(df, op)


def calculate_all(df: DataFrame, ops: list[dict], chained: bool = False) -> tuple[DataFrame, list[Calculated]]:
    """Run ops over one table. Independent by default; ``chained`` lets a table result replace the
    input of the ops behind it, while scalars only add metrics."""
    table, results = df, []
    for op in ops:
        result = calculate(table, op)
        results.append(result)
        if chained and result.kind == "table":
            table = result.df
    return table, results
