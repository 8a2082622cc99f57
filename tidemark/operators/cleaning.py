"""Cleaning operators. Each takes a DataFrame and gives a DataFrame; null text stays null.

Operators whose result depends on the data (filling by mean, conversions decided by a parse rate)
first run one aggregate over all columns concerned and use its single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import PlanError
from tidemark.functions import dates, names, numbers, text
from tidemark.operators import columns as cols
from tidemark.operators import ordered
from tidemark.operators.quantiles import exact_quantiles

PARSE_RATE = 0.8
RATE_KINDS = ("num", "cur", "date", "dayfirst")
MAX_CATEGORIES = 50

# Spellings of the three categories that are written out.
CATEGORY_SPELLINGS = {
    "Male": ("m", "male", "males"),
    "Female": ("f", "female", "females"),
    "Other": ("o", "other", "others"),
}

# The steps allowed before a filter, in their order.
PREP_STEPS = (
    "trim_whitespace",
    "normalize_column_names",
    "normalize_empty_strings",
    "safe_numeric_conversion",
    "safe_currency_conversion",
    "safe_date_detection",
    "categorical_value_normalization",
)


_c = cols.col


def _map_columns(df: DataFrame, targets: list[str], fn) -> DataFrame:
    return df.withColumns({c: fn(_c(c)) for c in targets}) if targets else df


# --- text ---------------------------------------------------------------------------------------


def trim_whitespace(df: DataFrame, columns=None) -> DataFrame:
    return _map_columns(df, names.expand_text(df, columns), text.strip)


def text_case(df: DataFrame, case: str, columns=None) -> DataFrame:
    """``lower``, ``upper``, ``title`` or ``capitalize`` on text columns."""
    styles = {"lower": F.lower, "upper": F.upper, "title": text.title, "capitalize": text.capitalize}
    if case not in styles:
        raise PlanError(f"Unknown text case {case!r}")
    return _map_columns(df, names.expand_text(df, columns), styles[case])


def replace_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Whole-value replacement; a mapping given as a DataFrame goes through ``replace_by_table``."""
    names.require(df, column)
    if not mapping:
        return df
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    replaced = F.try_element_at(F.create_map(*pairs), _c(column))
    known = _c(column).isin(list(mapping))
    return df.withColumn(column, F.when(known, replaced).otherwise(_c(column)))


def replace_by_table(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Whole-value replacement by a table ``old, new`` of any size with unique ``old``."""
    m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    joined = df.join(m, _c(column).eqNullSafe(F.col("__old")) & F.col("__old").isNotNull(), "left")
    value = F.when(F.col("__old").isNotNull(), F.col("__new")).otherwise(_c(column))
    return joined.withColumn(column, value).drop("__old", "__new")


def normalize_categories(df: DataFrame, columns=None, most: int = MAX_CATEGORIES) -> DataFrame:
    """Strip and title-case columns with at most ``most`` distinct values; write out gender spellings. Columns
    with more stay as they are; ``uncategorized`` names them."""
    targets = names.expand_text(df, columns)
    if not targets:
        return df
    low = _with_few_values(df, targets, most)

    def canonical(c: Column) -> Column:
        key = F.lower(text.strip(c))
        expr = text.title(text.strip(c))
        for label, spellings in CATEGORY_SPELLINGS.items():
            expr = F.when(key.isin(*spellings), F.lit(label)).otherwise(expr)
        return expr

    return _map_columns(df, low, canonical)


def uncategorized(df: DataFrame, columns=None, most: int = MAX_CATEGORIES) -> DataFrame | None:
    """The warning about columns that ``normalize_categories`` leaves for their many values; one aggregate with
    bounded sketches, so a column near the limit may be missing or named in error."""
    targets = names.expand_text(df, columns)
    if not targets:
        return None
    counts = [F.when(F.approx_count_distinct(text.strip(_c(c)), 0.01) > most, F.lit(c)) for c in targets]
    found = df.agg(F.array_join(F.array_compact(F.array(*counts)), ", ").alias("c")).where("c <> ''")
    return found.select(F.concat(F.lit(f"Columns of more than {most} values stay as they are: "), F.col("c")).alias("warning"))


def _with_few_values(df: DataFrame, targets: list[str], most: int) -> list[str]:
    """The columns with at least one and at most ``most`` distinct stripped values.

    The distinct values of a column are only followed while they can still be few: an approximate
    count settles the clear cases in one pass with bounded memory, and only columns near the limit
    are counted exactly, by grouping.
    """
    rough = df.agg(
        *[F.approx_count_distinct(text.strip(_c(c))).alias(str(i)) for i, c in enumerate(targets)]
    ).first()
    few = [c for i, c in enumerate(targets) if 0 < rough[i] <= most * 2]
    if not few:
        return []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), text.strip(_c(c)).alias("v")) for c in few]))
    exact = (
        df.select(pairs.alias("p")).select("p.k", "p.v").filter("v is not null").distinct().groupBy("k").count()
    )
    return [r["k"] for r in exact.collect() if r["count"] <= most]


# --- numbers ------------------------------------------------------------------------------------


def normalize_currency(df: DataFrame, column: str) -> DataFrame:
    """Keep digits, point and minus, then read as number; unreadable becomes null."""
    names.require(df, column)
    kept = F.regexp_replace(_c(column).cast("string"), "[^0-9.-]", "")
    return df.withColumn(column, numbers.to_number(kept))


def normalize_number(df: DataFrame, column: str) -> DataFrame:
    """Remove commas, then read as number; unreadable becomes null."""
    names.require(df, column)
    return df.withColumn(column, numbers.to_number(F.translate(_c(column).cast("string"), ",", "")))


def strip_currency_symbols(df: DataFrame, column: str) -> DataFrame:
    names.require(df, column)
    return df.withColumn(column, F.translate(_c(column).cast("string"), numbers.CURRENCY_SYMBOLS, ""))


def remove_commas(df: DataFrame, column: str) -> DataFrame:
    names.require(df, column)
    return df.withColumn(column, F.translate(_c(column).cast("string"), ",", ""))


def absolute_value(df: DataFrame, columns=None) -> DataFrame:
    return _map_columns(df, names.expand_numeric(df, columns), F.abs)


# --- dates and types ----------------------------------------------------------------------------


def normalize_date(
    df: DataFrame, column: str, target_format: str = "%Y-%m-%d", dayfirst: bool = False,
    errors: str = "coerce", formats: tuple[str, ...] | None = None,
) -> DataFrame:
    """Dates as text in ``target_format``; unreadable text becomes null, stays, or stops the job."""
    names.require(df, column)
    kind = df.schema[column].dataType
    parsed = dates.parse_date(_c(column), formats, dayfirst) if formats else dates.as_timestamp(_c(column), kind, dayfirst)
    out = dates.strftime(parsed, target_format)
    if errors == "ignore":
        out = F.coalesce(out, _c(column).cast("string"))
    elif errors == "raise":
        message = F.concat(F.lit(f"{column}: no date: "), _c(column).cast("string"))
        out = F.when(parsed.isNull() & _c(column).isNotNull(), F.raise_error(message)).otherwise(out)
    elif errors != "coerce":
        raise PlanError(f"Unknown errors mode {errors!r}")
    return df.withColumn(column, out)


def coerce_type(df: DataFrame, column: str, target_type: str, errors: str = "coerce") -> DataFrame:
    """Convert to string, integer, float, decimal, boolean or date.

    ``coerce`` gives null for unreadable values, ``raise`` stops the job, ``ignore`` leaves the whole
    column unchanged when any value is unreadable. Booleans are true for every value but zero, false
    and empty text; null counts as true, because the missing value is not one of those.
    """
    names.require(df, column)
    c, kind = _c(column), df.schema[column].dataType
    if target_type == "string":
        return df.withColumn(column, c.cast("string"))
    if target_type == "boolean":
        if names.is_text(kind):
            truth = c != ""
        elif names.is_numeric(kind):
            truth = c != 0
        elif isinstance(kind, T.BooleanType):
            truth = c
        else:
            truth = c.isNotNull()
        return df.withColumn(column, F.coalesce(truth, F.lit(True)))
    if target_type in ("float", "decimal"):
        out = numbers.as_number(c, kind)
    elif target_type == "integer":
        number = numbers.as_number(c, kind)
        whole = number.try_cast("bigint")
        fraction = F.raise_error(F.concat(F.lit(f"{column}: not a whole number: "), c.cast("string")))
        out = F.when(number.isNotNull() & (number != F.floor(number)), fraction).otherwise(whole)
    elif target_type == "date":
        out = dates.as_timestamp(c, kind)
    else:
        raise PlanError(f"Unknown target type {target_type!r}")
    if errors == "raise":
        failed = F.raise_error(F.concat(F.lit(f"{column}: not a {target_type}: "), c.cast("string")))
        out = F.when(c.isNotNull() & out.isNull(), failed).otherwise(out)
    elif errors == "ignore":
        readable = numbers.as_number(c, kind) if target_type != "date" else out
        bad = df.agg(F.count_if(c.isNotNull() & readable.isNull())).first()[0]
        if bad:
            return df
    elif errors != "coerce":
        raise PlanError(f"Unknown errors mode {errors!r}")
    return df.withColumn(column, out)


# --- rows ---------------------------------------------------------------------------------------


def drop_duplicates(
    df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order_by: list[str] | None = None
) -> DataFrame:
    """One row per distinct ``subset``; nulls equal each other; ``keep=False`` removes every copy.

    Every form is an aggregation with a map-side part, so a value held by a third of all rows is cut
    down before the shuffle. ``order_by`` names columns that decide which copy is first.
    """
    keys = [c for c in subset if c in df.columns] if subset else df.columns
    whole = set(keys) == set(df.columns)
    if keep is not False and (whole or not order_by):
        return df.dropDuplicates(keys)
    row = F.struct(*[_c(c) for c in df.columns])
    grouped = df.groupBy(*[_c(c).alias(f"__k{i}") for i, c in enumerate(keys)])
    if keep is False:
        kept = grouped.agg(F.count(F.lit(1)).alias("__n"), F.first(row).alias("__row")).filter("__n = 1")
    else:
        names.require(df, order_by)
        pick = F.min_by if keep == "first" else F.max_by
        kept = grouped.agg(pick(row, F.struct(*[_c(c) for c in order_by])).alias("__row"))
    return kept.select("__row.*")


def fill_nulls(df: DataFrame, columns, strategy: str, value=None) -> DataFrame:
    """Fill by zero, empty_string, mean, median, mode or constant."""
    targets = names.expand(df, columns)
    numeric = [c for c in targets if names.is_numeric(df.schema[c].dataType)]
    texts = [c for c in targets if names.is_text(df.schema[c].dataType)]
    if strategy == "zero":
        fills = {c: F.lit(0) for c in numeric} | {c: F.lit("0") for c in texts}
    elif strategy == "empty_string":
        fills = {c: F.lit("") for c in texts}
    elif strategy == "constant":
        if value is None:
            raise PlanError("constant needs a value")
        fills = {c: F.lit(value) for c in targets}
    elif strategy == "mean":
        row = df.agg(*[F.avg(_c(c)).alias(str(i)) for i, c in enumerate(numeric)]).first() if numeric else []
        fills = {c: F.lit(row[i]) for i, c in enumerate(numeric)}
    elif strategy == "median":
        fills = {c: F.lit(m) for c, m in exact_quantiles(df, numeric, 0.5).items()} if numeric else {}
    elif strategy == "mode":
        modes = _modes(df, targets) if targets else {}
        fills = {c: F.lit(modes.get(c)) for c in targets}
    else:
        raise PlanError(f"Unknown fill strategy {strategy!r}")
    return df.withColumns({c: _filled(df, c, fill, strategy) for c, fill in fills.items()}) if fills else df


def _filled(df: DataFrame, column: str, fill: Column, strategy: str) -> Column:
    if strategy in ("mean", "median"):
        return F.coalesce(_c(column).cast("double"), fill.cast("double"))
    if strategy in ("zero", "mode"):
        return F.coalesce(_c(column), fill.cast(df.schema[column].dataType))
    return F.coalesce(_c(column), fill)


def _modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Smallest of the most frequent values of every column, as text: one grouped count for all
    columns, of which one row per column comes back."""

    def pair(i: int, name: str) -> Column:
        numeric = names.is_numeric(df.schema[name].dataType)
        number = _c(name).cast("double") if numeric else F.lit(None).cast("double")
        return F.struct(F.lit(i).alias("i"), _c(name).cast("string").alias("v"), number.alias("number"))

    pairs = F.explode(F.array(*[pair(i, c) for i, c in enumerate(columns)]))
    counted = (
        df.select(pairs.alias("p")).select("p.*").filter("v is not null")
        .groupBy("i", "v").agg(F.first("number").alias("number"), F.count(F.lit(1)).alias("n"))
    )
    top = ordered.first_per_key(counted, ["i"], [F.desc("n"), F.col("number"), F.col("v")])
    return {columns[r["i"]]: r["v"] for r in top.collect()}


def drop_nulls(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with null or blank text in any or all columns; blanks become null in kept rows."""
    targets = [c for c in columns if c in df.columns] if columns else df.columns
    if not targets:
        return df
    blanks = [c for c in targets if names.is_text(df.schema[c].dataType)]
    out = _map_columns(df, blanks, text.blank_to_null)
    return out.filter(cols.has_value(out, targets, how))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.filter(cols.has_value(df, df.columns, "all"))


def json_safe(df: DataFrame) -> DataFrame:
    """Stripped text, ISO timestamps, and null for NaN and the infinities."""
    out = {}
    for f in df.schema.fields:
        if names.is_text(f.dataType):
            out[f.name] = text.strip(_c(f.name))
        elif names.is_dated(f.dataType):
            out[f.name] = dates.iso_text(_c(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = numbers.no_nan(_c(f.name))
    return df.withColumns(out) if out else df


# --- preparation before a filter ----------------------------------------------------------------


def empty_to_null(df: DataFrame, columns=None) -> DataFrame:
    return _map_columns(df, names.expand_text(df, columns), text.blank_to_null)


def currency_number(c: Column) -> Column:
    """Money text as number: symbols, codes and commas removed first."""
    return numbers.to_number(F.translate(F.regexp_replace(c, numbers.CURRENCY_NOISE, ""), ",", ""))


def parse_rates(df: DataFrame, columns: list[str], kinds: tuple[str, ...] = RATE_KINDS) -> dict[str, dict[str, float]]:
    """Share of non-null texts that read as number, currency and date: one aggregate for all."""
    if not columns:
        return {}
    tests = {
        "num": numbers.to_number,
        "cur": lambda v: F.when(v.rlike(numbers.CURRENCY_PATTERN), 1),
        "date": dates.parse_date,
        "dayfirst": lambda v: dates.parse_date(v, dayfirst=True),
    }
    shown = []
    for i, c in enumerate(columns):
        shown.append(F.count(_c(c)).alias(f"n{i}"))
        shown += [F.count(tests[k](_c(c))).alias(f"{k}{i}") for k in kinds]
    row = df.agg(*shown).first()
    return {
        c: {k: (row[f"{k}{i}"] / row[f"n{i}"] if row[f"n{i}"] else 0.0) for k in kinds}
        for i, c in enumerate(columns)
    }


def numeric_when_confident(df: DataFrame, columns=None, rates=None) -> DataFrame:
    """Text columns of which at least 80 % read as numbers become numbers."""
    targets = names.expand_text(df, columns)
    rates = rates or parse_rates(df, targets, ("num",))
    return _map_columns(df, [c for c in targets if rates[c]["num"] >= PARSE_RATE], numbers.to_number)


def currency_when_confident(df: DataFrame, columns=None, rates=None) -> DataFrame:
    """Text columns of which at least 80 % look like money become numbers."""
    targets = names.expand_text(df, columns)
    rates = rates or parse_rates(df, targets, ("cur",))
    return _map_columns(df, [c for c in targets if rates[c]["cur"] >= PARSE_RATE], currency_number)


def dates_when_confident(df: DataFrame, columns=None, rates=None) -> DataFrame:
    """Text columns of which at least 80 % read as dates, month first or else day first, become
    timestamps."""
    targets = names.expand_text(df, columns)
    rates = rates or parse_rates(df, targets, ("date", "dayfirst"))
    for dayfirst, kind in ((False, "date"), (True, "dayfirst")):
        hit = [c for c in targets if rates[c][kind] >= PARSE_RATE]
        df = _map_columns(df, hit, lambda c, d=dayfirst: dates.parse_date(c, dayfirst=d))
        targets = [c for c in targets if c not in hit]
    return df


def lower_values(df: DataFrame, columns=None) -> DataFrame:
    return _map_columns(df, names.expand_text(df, columns), lambda c: F.lower(text.strip(c)))


def prepare_for_filter(df: DataFrame, steps=PREP_STEPS) -> DataFrame:
    """The safe bundle: it never drops a row and refuses every other step.

    The three conversion steps share one aggregate, because each of them only looks at columns the
    ones before left as text, and trimming and emptying do not change what reads as what.
    """
    unknown = [s for s in steps if s not in PREP_STEPS]
    if unknown:
        raise PlanError(f"Not safe before a filter: {unknown}; allowed: {list(PREP_STEPS)}")
    out = df
    if "trim_whitespace" in steps:
        out = trim_whitespace(out)
    if "normalize_column_names" in steps:
        out = cols.normalize_names(out)
    if "normalize_empty_strings" in steps:
        out = empty_to_null(out)
    conversions = [
        ("safe_numeric_conversion", "num", numbers.to_number),
        ("safe_currency_conversion", "cur", currency_number),
        ("safe_date_detection", "date", dates.parse_date),
        ("safe_date_detection", "dayfirst", lambda c: dates.parse_date(c, dayfirst=True)),
    ]
    wanted = [conv for conv in conversions if conv[0] in steps]
    if wanted:
        left = names.text_columns(out)
        rates = parse_rates(out, left)
        for _step, kind, fn in wanted:
            hit = [c for c in left if rates[c][kind] >= PARSE_RATE]
            out = _map_columns(out, hit, fn)
            left = [c for c in left if c not in hit]
    if "categorical_value_normalization" in steps:
        out = lower_values(out)
    return out


def default_clean(df: DataFrame) -> DataFrame:
    """Trim, snake_case names, drop exact duplicates."""
    return drop_duplicates(cols.normalize_names(trim_whitespace(df)))


def mask_sensitive(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mask the text columns whose name is sensitive, or the ones given."""
    targets = columns if columns is not None else [c for c in names.text_columns(df) if text.is_sensitive_name(c)]
    return _map_columns(df, names.expand_text(df, targets) if targets else [], text.mask)
