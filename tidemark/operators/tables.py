"""Joins, unions, sorting and paging as the dashboards use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import PlanError
from tidemark.functions import dates, names, numbers
from tidemark.operators import ordered
from tidemark.operators.columns import has_value
from tidemark.session import scratch_path


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# --- joins --------------------------------------------------------------------------------------


def children_of(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Children whose parent exists: an inner equi-join on unique parent keys is a semi join of the
    children, so no parent column is shuffled."""
    keys = parents.select(_c(parent_key).alias("__k"))
    return children.join(keys, _c(child_key) == F.col("__k"), "left_semi")


def with_child_count(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str = "row_count"
) -> DataFrame:
    """Parents with the number of their children, 0 where there are none. The children are counted
    before the join, so a parent with a third of all children is one join row."""
    counted = children.groupBy(_c(child_key).alias("__k")).agg(F.count(F.lit(1)).alias(name))
    joined = parents.join(counted, _c(parent_key) == F.col("__k"), "left").drop("__k")
    return joined.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def with_first_child(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order_by: list[Column], columns: list[str]
) -> DataFrame:
    """Parents that have a child, with columns of the first one in order."""
    first = ordered.first_per_key(children, [child_key], order_by)
    return parents.join(first.select(_c(child_key).alias("__k"), *columns), _c(parent_key) == F.col("__k")).drop("__k")


def having(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents for which at least one child exists. The child keys are made distinct before the join,
    so a parent with a third of all children is one join row."""
    keys = children.select(_c(child_key).alias("__k")).distinct()
    return parents.join(keys, _c(parent_key) == F.col("__k"), "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, columns: dict[str, str]) -> DataFrame:
    """Attributes of a keyed table; Spark broadcasts the table while it is below its threshold."""
    t = table.select(_c(table_key).alias("__k"), *[_c(c).alias(n) for c, n in columns.items()])
    return df.join(t, _c(key) == F.col("__k"), "left").drop("__k")


def manager_counts(users: DataFrame) -> DataFrame:
    """Managers with the number of users that report to them: a self join on counts."""
    managers = users.filter(F.col("role") == "manager")
    return with_child_count(managers, users.filter("manager_id is not null"), "id", "manager_id", "employee_count")


# --- unions -------------------------------------------------------------------------------------


def concat(tables: list[DataFrame]) -> DataFrame:
    """Tables below each other, columns matched by name and filled with null; columns without a name
    and rows without a value are dropped."""
    if not tables:
        raise PlanError("Nothing to combine")
    out = None
    for t in tables:
        named = t.select(*[_c(c) for c in t.columns if c.strip()])
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out.filter(has_value(out, out.columns, "all"))


def value_union(columns: list[DataFrame], name: str) -> DataFrame:
    """Distinct values of several one-column tables."""
    out = None
    for t in columns:
        values = t.select(_c(t.columns[0]).alias(name))
        out = values if out is None else out.union(values)
    return out.distinct()


# --- order --------------------------------------------------------------------------------------


def sort(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Sort by ``(column, "asc" | "desc")`` keys."""
    names.require(df, [k for k, _ in keys])
    order = []
    for column, direction in keys:
        if direction not in ("asc", "desc"):
            raise PlanError(f"Unknown direction {direction!r}")
        order.append(_c(column).asc() if direction == "asc" else _c(column).desc())
    return df.orderBy(*order)


def newest(df: DataFrame, order_by: list[Column], n: int) -> DataFrame:
    """Top ``n``: each task keeps ``n`` rows, no full sort."""
    return df.orderBy(*order_by).limit(n)


def page(df: DataFrame, order_by: list[Column], number: int, size: int) -> DataFrame:
    """One page after sorting, counted from 0. All rows before the page are kept on the way, so this is for
    the first pages; ``Pages`` reads any page alone."""
    return df.orderBy(*order_by).offset(number * size).limit(size)


class Pages:
    """Pages of a sorted table, of which each reads only the slices that hold it.

    The rows are range-partitioned by the order once and stored, a folder per slice; the number of rows of each
    slice says where every page lies. Rows equal in the order go by a hash of the whole row, so pages neither
    overlap nor depend on the run.
    """

    def __init__(self, df: DataFrame, order_by: list[Column], slices: int | None = None):
        self.columns, self.spark = df.columns, df.sparkSession
        self.order = [*order_by, F.col("__tie")]
        tied = df.withColumn("__tie", ordered.row_hash(df))
        cut = tied.repartitionByRange(slices or ordered.slice_count(df), *self.order).withColumn("__slice", F.spark_partition_id())
        self.path = scratch_path(self.spark, "pages")
        cut.write.partitionBy("__slice").parquet(self.path)
        self.schema = cut.schema
        counts = self._stored().groupBy("__slice").count().orderBy("__slice").collect()  # a row per slice
        self.starts, at = [], 0
        for r in counts:
            self.starts.append((r["__slice"], at, at + r["count"]))
            at += r["count"]
        self.rows = at

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def page(self, number: int, size: int) -> DataFrame:
        """One page, counted from 0; pages behind the last row are empty."""
        first, end = number * size, (number + 1) * size
        held = [(k, low) for k, low, high in self.starts if low < end and first < high]
        some = self._stored().where(F.col("__slice").isin([k for k, _ in held])).orderBy(*self.order)
        skipped = first - held[0][1] if held else 0
        return some.offset(skipped).limit(size).select(*[_c(c) for c in self.columns])


def largest_groups(df: DataFrame, key: str, n: int = 6, name: str = "size") -> DataFrame:
    return df.groupBy(_c(key)).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), _c(key)).limit(n)


def listed_first(c: Column, order: list[str]) -> Column:
    """Sort key that puts the listed values first, in their order, and all others behind."""
    key = F.lit(len(order))
    for i, value in enumerate(order):
        key = F.when(c == value, i).otherwise(key)
    return key


def mixed_key(c: Column) -> list[Column]:
    """Sort keys of a column of mixed texts: missing first, then numbers by value, dates by time,
    other texts without case."""
    number, when = numbers.to_number(c), dates.parse_date(c)
    kind = (
        F.when(c.isNull(), 0).when(number.isNotNull(), 1).when(when.isNotNull(), 2).otherwise(3)
    )
    return [kind, number, when, F.lower(c.cast("string"))]


# --- versions -----------------------------------------------------------------------------------


def lineage(df: DataFrame, key: str = "id", parent: str = "parent_id", version: str = "version_number") -> DataFrame:
    """Root of every version (its parent or itself) and the number the next version of that root
    gets. The versions are counted by an aggregate before they are joined back."""
    rooted = df.withColumn("root_id", F.coalesce(_c(parent), _c(key)))
    following = rooted.groupBy("root_id").agg((F.max(_c(version)) + 1).alias("next_version"))
    return rooted.join(following, "root_id")
