"""Chart-ready data: grouped datasets, field roles, fitness checks, histogram bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import PlanError
from tidemark.functions import names
from tidemark.operators import calculations, ordered

MAX_CATEGORIES = 12

# Chart kind chosen for a data shape.
AUTO_CHART = {
    "time_series": "line",
    "categorical_series": "bar",
    "histogram_bins": "histogram",
    "scatter_points": "scatter",
}


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def grouped(df: DataFrame, group_by: str, aggregation: str = "count", measure: str | None = None, output: str | None = None) -> DataFrame:
    """One category column and one aggregated number; null categories are left out."""
    if aggregation in ("sum", "mean") and measure in df.columns:
        name = output or f"{aggregation}_{measure}"
        value = F.coalesce(F.sum(_c(measure)), F.lit(0)) if aggregation == "sum" else F.avg(_c(measure))
        return df.filter(_c(group_by).isNotNull()).groupBy(_c(group_by)).agg(value.alias(name))
    return calculations.group(df, "count", group_by, [group_by], output or f"count_{group_by}")


def is_identifier(name: str) -> bool:
    """Whether a name is that of an id or key, which is never drawn as a measure."""
    n = name.strip().lower()
    return (
        n in ("id", "index", "row_number", "record_id")
        or n.startswith("id_")
        or n.endswith(("_id", "_number", "_key", "_no"))
    )


def _data_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if names.is_numeric(kind):
        return "float"
    return "datetime" if names.is_dated(kind) else "string"


def fields(df: DataFrame, aggregated: dict[str, str] | None = None) -> DataFrame:
    """One row per column: type, role and the aggregation behind it.

    Only the roles of text columns depend on the data: category when under half of the rows have
    distinct values, else dimension.
    """
    rows, texts = [], []
    for i, f in enumerate(df.schema.fields):
        kind = _data_type(f.dataType)
        role = "identifier" if is_identifier(f.name) else {"integer": "measure", "float": "measure", "datetime": "time"}.get(kind)
        if role is None:
            texts.append(f.name)
        rows.append((i, f.name, names.styled(f.name).replace("_", " ").title(), kind, role, (aggregated or {}).get(f.name)))
    meta = df.sparkSession.createDataFrame(
        rows, "position int, id string, label string, data_type string, role string, aggregation string"
    )
    if not texts:
        return meta
    shares = _distinct_shares(df, texts)
    role = F.coalesce("role", F.when(F.col("share") < 0.5, "category").otherwise("dimension"))
    return (
        meta.join(F.broadcast(shares), "id", "left")
        .select("position", "id", "label", "data_type", role.alias("role"), "aggregation")
        .orderBy("position")
    )


def _distinct_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values over rows, exact: grouped pairs counted per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("id"), _c(c).cast("string").alias("v")) for c in columns])
    total = df.agg(F.count(F.lit(1)))
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.id", "p.v")
        .filter("v is not null")
        .distinct()
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("d"))
        .select("id", F.try_divide(F.col("d"), total.scalar()).alias("share"))
    )


def data_shape(roles: DataFrame) -> DataFrame:
    """One row: the shape a table's roles make, and the chart chosen for it."""
    has = {r: F.max(F.col("role") == r) for r in ("time", "category", "measure", "dimension")}
    measures = F.count_if((F.col("role") == "measure") & F.col("data_type").isin("integer", "float"))
    shape = (
        F.when(has["time"], "time_series")
        .when(has["category"] & has["measure"], "categorical_series")
        .when(has["dimension"] & (measures >= 1), "histogram_bins")
        .when((measures == 2) & ~has["category"], "scatter_points")
        .otherwise("scalar")
    )
    chart = F.lit("bar")
    for label, kind in AUTO_CHART.items():
        chart = F.when(F.col("data_shape") == label, kind).otherwise(chart)
    return roles.agg(shape.alias("data_shape")).withColumn("chart", chart)


def axes(roles: DataFrame, chart: str) -> DataFrame:
    """Default axes of a chart kind: the first fitting field for each axis, one row; null when the
    table has none."""
    first = lambda *wanted: F.min_by("id", F.when(F.col("role").isin(*wanted), F.col("position")))
    agg = roles.agg(
        first("category", "dimension").alias("category"),
        first("measure").alias("measure"),
        first("time").alias("time"),
        F.slice(
            F.array_sort(F.collect_list(F.when(F.col("role") == "measure", F.struct("position", "id")))), 2, 1
        ).alias("second"),
    )
    second = F.try_element_at("second", F.lit(1))["id"]
    by_chart = {
        "pie": ("category", "measure"),
        "scatter": ("measure", second),
        "line": (F.coalesce("time", "category"), "measure"),
    }
    x, y = by_chart.get(chart, (F.coalesce("category", "time"), "measure"))
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return agg.select(F.lit(chart).alias("chart"), F.when(both, x).alias("x"), F.when(both, y).alias("y"))


def _verdict(df: DataFrame, chart: str, checks: list[tuple[Column, str]], facts: list[Column]) -> DataFrame:
    """One row: ``valid`` and the code of the first check that fails."""
    reason = F.lit(None).cast("string")
    for ok, code in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), f"{chart}_incompatible_{code}").otherwise(reason)
    return df.agg(*facts).select(
        F.lit(chart).alias("chart"), reason.isNull().alias("valid"), reason.alias("reason_code")
    )


def _distinct(df: DataFrame, column: str) -> Column:
    """Exact distinct count as a scalar subquery over the grouped values."""
    return df.select(_c(column).alias("v")).filter("v is not null").distinct().agg(F.count(F.lit(1))).scalar()


def line_fitness(df: DataFrame, x: str, role: str) -> DataFrame:
    """A line needs time or a dimension on x and two distinct x values (two differ if min ≠ max)."""
    checks = [
        (F.lit(x in df.columns), "missing_x_axis"),
        (F.lit(role in ("time", "dimension")), "invalid_x_role"),
        (F.col("low") != F.col("high"), "insufficient_x_values"),
    ]
    c = _c(x) if x in df.columns else F.lit(None).cast("string")
    return _verdict(df, "line", checks, [F.min(c).alias("low"), F.max(c).alias("high")])


def _typed(df: DataFrame, columns: list[str], roles: dict[str, str]) -> tuple[list[str], list[str]]:
    present = [c for c in columns if c in df.columns]
    categories = [c for c in present if roles.get(c) in ("category", "dimension")]
    return categories, [c for c in present if names.is_numeric(df.schema[c].dataType)]


def _complete(columns: list[str]) -> Column:
    flag = F.lit(True)
    for c in columns:
        flag = flag & _c(c).isNotNull()
    return F.count_if(flag).alias("complete")


def bar_fitness(df: DataFrame, axes_used: list[str], roles: dict[str, str]) -> DataFrame:
    """A bar chart needs a category, a number and one complete row."""
    categories, numbers = _typed(df, axes_used, roles)
    checks = [
        (F.lit(bool(categories)), "missing_category"),
        (F.lit(bool(numbers)), "missing_numeric"),
        (F.col("complete") >= 1, "insufficient_rows"),
    ]
    return _verdict(df, "bar", checks, [_complete(categories + numbers)])


def pie_fitness(
    df: DataFrame, axes_used: list[str], roles: dict[str, str], aggregated: bool = True, max_categories: int = MAX_CATEGORIES
) -> DataFrame:
    """A pie needs one category, one aggregated number, none negative, and few categories."""
    most = max(2, min(50, max_categories))
    categories, numbers = _typed(df, axes_used, roles)
    low = F.min(_c(numbers[0])) if numbers else F.lit(None).cast("double")
    few = _distinct(df, categories[0]) <= most if categories else F.lit(False)
    checks = [
        (F.lit(len(categories) == 1), "category_count"),
        (F.lit(len(numbers) == 1), "numeric_count"),
        (F.lit(aggregated), "aggregation_required"),
        (F.coalesce(F.col("low") >= 0, F.lit(True)), "negative_values"),
        (few, "too_many_categories"),
    ]
    return _verdict(df, "pie", checks, [low.alias("low")])


def scatter_fitness(df: DataFrame, axes_used: list[str]) -> DataFrame:
    """A scatter plot needs two numbers and two complete rows."""
    _, numbers = _typed(df, axes_used, {})
    checks = [
        (F.lit(len(numbers) >= 2), "insufficient_numeric_fields"),
        (F.col("complete") >= 2, "insufficient_rows"),
    ]
    return _verdict(df, "scatter", checks, [_complete(numbers[:2])])


def histogram_fitness(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """A histogram needs a numeric measure with at least one value."""
    measures = [c for c, r in roles.items() if r == "measure" and names.is_numeric(df.schema[c].dataType)]
    checks = [(F.lit(bool(measures)), "missing_measure"), (F.col("complete") >= 1, "insufficient_rows")]
    return _verdict(df, "histogram", checks, [_complete(measures[:1])])


def histogram_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from the smallest to the largest value: ``bin, low, high, n``; empty bins
    are 0. The largest value belongs to the last bin."""
    if bins < 1:
        raise PlanError("At least one bin")
    v = _c(column).cast("double")
    ends = df.agg(F.min(v).alias("low"), F.max(v).alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    raw = F.when(low == high, F.lit(1)).otherwise(F.width_bucket(v, low, high, F.lit(bins)))
    counted = (
        df.filter(v.isNotNull()).groupBy(F.least(raw, F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (low + (F.col("bin") - 1) * width).alias("low"),
        (low + F.col("bin") * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def newest_specs(specs: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The newest chart spec per key."""
    return ordered.first_per_key(specs, keys, order_by)
