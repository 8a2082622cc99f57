"""Column and table profiles as DataFrames with one row per column.

Two scans give everything: one wide aggregate (counts, ranges, lengths, parse rates) without a
shuffle of rows, and one grouped count of ``(column, value)`` pairs for what needs the values
(distinct counts, frequent, rare and sample values). In the pairs a long text stands for itself by its
beginning and a digest; the few long texts that are shown are fetched afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dates, names, numbers, text
from tidemark.operators import ordered

SAMPLE_CHARS = 64
DIGEST_CHARS = 64
#: Texts of more characters go through a shuffle as their first DIGEST_CHARS, a mark and a SHA-256.
LONG_CHARS = 2 * DIGEST_CHARS + 1
MARK = "\u0000"


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _shown(df: DataFrame, column: str) -> Column:
    """A value as text; NaN counts as missing."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return numbers.no_nan(_c(column)).cast("string")
    if names.is_dated(kind):
        return dates.iso_text(_c(column))
    return _c(column).cast("string")


def _key(df: DataFrame, column: str, shown: Column) -> Column:
    """What stands for a value in a shuffle: the value, or for a long text its beginning and its digest, which
    sort like it but for texts that begin alike. A short text that holds the mark is digested too."""
    if not names.is_text(df.schema[column].dataType):
        return shown
    brief = F.concat(F.left(shown, F.lit(DIGEST_CHARS)), F.lit(MARK), F.sha2(shown, 256))
    return F.when((F.length(shown) > LONG_CHARS) | F.contains(shown, F.lit(MARK)), brief).otherwise(shown)


def value_counts(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``column, key, n, first_at`` for every distinct non-null value of every column; ``with_values`` gives
    the values of chosen keys.

    Rows are counted map-side before the shuffle, so a frequent value costs one row per task, and no
    text of more than LONG_CHARS characters is moved.
    """
    order = F.struct(*[_c(c) for c in order_by]) if order_by else F.monotonically_increasing_id()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _key(df, c, _shown(df, c)).alias("key")) for c in df.columns])
    return (
        df.select(order.alias("at"), F.explode(pairs).alias("p"))
        .select("at", "p.column", "p.key")
        .filter("key is not null")
        .groupBy("column", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    )


def with_values(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (``column, key, …``, a few rows per column) with the ``value`` of each key. Digested texts are
    looked up in a scan of the text columns; the chosen keys are broadcast."""
    texts = [c for c in df.columns if names.is_text(df.schema[c].dataType)]
    if not texts:
        return chosen.withColumn("value", F.col("key"))
    digested = F.contains("key", F.lit(MARK))
    wanted = F.broadcast(chosen.where(digested).select("column", "key").distinct())
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _key(df, c, _c(c)).alias("key"), _c(c).alias("text")) for c in texts])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where(digested).join(wanted, ["column", "key"])
    found = rows.groupBy("column", "key").agg(F.first("text").alias("text"))
    return chosen.join(F.broadcast(found), ["column", "key"], "left").withColumn("value", F.coalesce("text", "key")).drop("text")


def distinct_counts(df: DataFrame) -> DataFrame:
    """``column, distinct_count`` of every column; long texts are counted by their digests."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _key(df, c, _shown(df, c)).alias("key")) for c in df.columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", "p.key")
        .filter("key is not null")
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct_count"))
    )


def _stat_columns(df: DataFrame, column: str) -> dict[str, Column]:
    kind, c = df.schema[column].dataType, _c(column)
    textual, numeric, dated = names.is_text(kind), names.is_numeric(kind), names.is_dated(kind)
    value = numbers.no_nan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
    none_number, none_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rate = lambda good: numbers.ratio(F.count(good), F.count(c)) if textual else none_number
    symbol = F.when(c.rlike("[$€£¥₹]"), 1) if textual else None
    return {
        "null_count": F.count_if(value.isNull()),
        "non_null_count": F.count(value),
        "numeric_min": F.min(value).cast("double") if numeric else none_number,
        "numeric_max": F.max(value).cast("double") if numeric else none_number,
        "date_min": dates.iso_text(F.min(c)) if dated else none_text,
        "date_max": dates.iso_text(F.max(c)) if dated else none_text,
        "text_min": F.min(c) if textual else none_text,
        "text_max": F.max(c) if textual else none_text,
        "average_text_length": F.avg(F.length(c)) if textual else none_number,
        "number_rate": rate(numbers.to_number(c)),
        "date_rate": rate(dates.parse_date(c)),
        "symbol_rate": rate(symbol),
        "text_number_min": F.min(numbers.to_number(c)) if textual else none_number,
        "text_number_max": F.max(numbers.to_number(c)) if textual else none_number,
    }


def column_stats(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One row per column from a single wide aggregate: all statistics, or the ``wanted`` ones."""
    shown, structs = [], []
    for i, f in enumerate(df.schema.fields):
        stats = {k: v for k, v in _stat_columns(df, f.name).items() if wanted is None or k in wanted}
        shown += [v.alias(f"{k}_{i}") for k, v in stats.items()]
        structs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(names.profile_name(f.name)).alias("normalized_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                *[F.col(f"{k}_{i}").alias(k) for k in stats],
            )
        )
    return df.agg(*shown).select(F.inline(F.array(*structs)))


def profile_columns(df: DataFrame) -> DataFrame:
    """The column profile: counts, ranges, average text length, distinct count."""
    joined = column_stats(df).join(F.broadcast(distinct_counts(df)), "column", "left")
    return joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")))


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and rows that repeat an earlier one. Rows are counted by 256 bits of hashes, four
    of 64 over the columns in turned orders, so none of their values is moved."""
    c = [_c(x) for x in df.columns]
    nulls = F.concat(*[F.when(x.isNull(), "1").otherwise("0") for x in c])  # a hash passes over nulls
    turned = [[nulls, *c[k % len(c) :], *c[: k % len(c)]] for k in range(4)]
    digest = [F.xxhash64(F.lit(k), *columns).alias(f"__h{k}") for k, columns in enumerate(turned)]
    groups = df.select(*digest).groupBy(*[f"__h{k}" for k in range(4)]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_row_count"),
    )


# --- sample values ------------------------------------------------------------------------------


def shown_sample(c: Column, sensitive: bool = False, chars: int | None = SAMPLE_CHARS) -> Column:
    """A sample as it may be shown: masked if sensitive, without control characters, at most
    ``chars`` characters long (None: whole)."""
    safe = F.regexp_replace(text.mask(c) if sensitive else c, r"[\x00-\x08\x0b-\x1f]", "")
    return safe if chars is None else F.left(safe, F.lit(chars))


def _top(df: DataFrame, counts: DataFrame, order: list[Column], n: int, chars: int | None) -> DataFrame:
    """The first ``n`` values per column as rows ``column, rank, value, n``."""
    window = Window.partitionBy("column").orderBy(*order)
    ranked = counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
    ranked = with_values(df, ranked.select("column", "key", "rank", "n"))
    value = shown_sample(F.col("value"), chars=chars)
    sensitive = [c for c in df.columns if text.is_sensitive_name(c)]
    if sensitive:
        value = F.when(F.col("column").isin(sensitive), shown_sample(F.col("value"), True, chars)).otherwise(value)
    return ranked.select("column", "rank", value.alias("value"), "n")


def samples(
    df: DataFrame, kind: str, n: int = 3, order_by: list[str] | None = None, chars: int | None = SAMPLE_CHARS
) -> DataFrame:
    """``n`` sample values per column, cut to ``chars`` characters: ``representative`` (first seen), ``frequent``, ``rare`` or
    ``random`` (seeded by the column name, so equal input gives equal samples)."""
    counts = value_counts(df, order_by)
    orders = {
        "representative": [F.col("first_at"), F.col("key")],
        "frequent": [F.desc("n"), F.col("key")],
        "rare": [F.asc("n"), F.col("key")],
        "random": [F.sha2(F.concat(F.col("column"), F.lit("::"), F.col("key")), 256)],
    }
    return _top(df, counts, orders[kind], n, chars)


# --- light profile ------------------------------------------------------------------------------


def detected_type(kind: T.DataType) -> Column:
    """``empty``, ``number`` (90 % readable) or ``string`` from the stats of a column."""
    by_rate = F.when(F.col("number_rate") >= 0.9, "number").otherwise("string")
    return F.when(F.col("non_null_count") == 0, "empty").otherwise(
        F.lit("number") if names.is_numeric(kind) else by_rate
    )


def detected_type_with_dates(kind: T.DataType, dates_first: bool = True) -> Column:
    """The same with ``date``; which of date and number is tried first is the caller's choice."""
    if names.is_numeric(kind):
        found = F.lit("number")
    elif names.is_dated(kind):
        found = F.lit("date")
    else:
        tests = [("date", F.col("date_rate")), ("number", F.col("number_rate"))]
        (first, r1), (second, r2) = tests if dates_first else tests[::-1]
        found = F.when(r1 >= 0.9, first).when(r2 >= 0.9, second).otherwise("string")
    return F.when(F.col("non_null_count") == 0, "empty").otherwise(found)


def _by_column(df: DataFrame, fn) -> Column:
    """A CASE over the column names with one expression per data type."""
    out = F.lit(None).cast("string")
    for f in df.schema.fields:
        out = F.when(F.col("column") == f.name, fn(f.dataType)).otherwise(out)
    return out


def light_profile(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Upload profile: detected type, nulls, distinct non-empty values, three samples, range.

    The range is numeric where any value reads as number, else the text range.
    """
    counts = value_counts(df, order_by)
    pool = counts.filter("key <> ''")
    distinct = pool.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    first = ordered.first_per_key(pool, ["column"], [F.col("first_at"), F.col("key")], 3)
    shown = with_values(df, first.select("column", "key", "first_at"))
    shown = shown.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "value"))), lambda p: p["value"]), "|").alias(
            "sample_values"
        )
    )
    as_text = lambda c: F.col(c).cast("string")
    low = F.coalesce(as_text("numeric_min"), as_text("text_number_min"), F.col("date_min"), F.col("text_min"))
    high = F.coalesce(as_text("numeric_max"), as_text("text_number_max"), F.col("date_max"), F.col("text_max"))
    return (
        column_stats(df)
        .join(F.broadcast(distinct), "column", "left")
        .join(F.broadcast(shown), "column", "left")
        .select(
            "position",
            F.col("column").alias("name"),
            _by_column(df, detected_type).alias("detected_type"),
            (F.col("null_count") > 0).alias("nullable"),
            "null_count",
            F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
            "sample_values",
            low.alias("min_value"),
            high.alias("max_value"),
        )
    )


# Confidence and reason of a proposed mapping, by what speaks for it.
MAPPING_REASONS = {
    "alias": ("high", "Matched a known finance schema alias."),
    "role": ("high", "Matched a semantic column role and mapped to the canonical target."),
    "raw_text": ("medium", "Preserved unstructured text for user confirmation."),
    "header": ("medium", "Normalized from the source header and proposed as-is."),
}


def _mapping_rules(columns: list[str]) -> list[tuple[str, str, str]]:
    """(source, target, ground) of every rule that fits a column, the strongest ground first."""
    aliases = set(names.LEDGER_ALIASES.values())
    fits = {
        "alias": {c: c for c in columns if c in aliases},
        "role": {c: names.finance_target(c) for c in columns},
        "raw_text": {c: c for c in columns if c == "raw_text"},
        "header": {c: c for c in columns},
    }
    return [(c, target, ground) for ground, found in fits.items() for c, target in found.items() if target]


def field_mapping(df: DataFrame) -> DataFrame:
    """Proposed mapping of the columns to canonical targets: the first rule that fits, with its reason."""
    first: dict[str, tuple[str, str]] = {}
    for source, target, ground in _mapping_rules(df.columns):
        first.setdefault(source, (target, ground))
    rows = [(c, target, *MAPPING_REASONS[ground]) for c, (target, ground) in first.items()]
    mapping = df.sparkSession.createDataFrame(rows, "source string, target string, confidence string, reason string")
    types = column_stats(df, ["non_null_count", "number_rate"]).select(F.col("column").alias("source"), _by_column(df, detected_type).alias("detected_type"))
    return types.join(F.broadcast(mapping), "source").select("source", "target", "detected_type", "confidence", "reason")
