"""Validation rules: one report row per failing constraint, and a per-row quarantine split.

Every rule but ``unique`` looks at one row only, so all of them are flags counted by one aggregate.
``unique`` groups the values and counts the groups. Samples are the first three invalid values per
constraint, cut to three per task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import PlanError
from tidemark.functions import dates, names, numbers, text
from tidemark.operators import ordered, skew

# The rule names.
RULES = (
    "allowed_values", "contains", "cross_field_compare", "date_range", "date_not_future",
    "drop_column", "ends_with", "forbidden_substring", "length_range", "non_negative",
    "not_allowed_values", "percentage_range", "numeric_range", "regex_match", "required",
    "starts_with", "unique",
)
# Rules reported as errors unless the constraint says otherwise.
ERROR_RULES = ("required", "unique", "not_allowed_values", "cross_field_compare")
SAMPLES = 3

REPORT_SCHEMA = (
    "column string, rule string, severity string, reason string, "
    "invalid_count bigint, sample_values array<string>"
)


@dataclass
class Check:
    """A constraint bound to a column: the flag of invalid rows and the text shown as sample."""

    column: str
    rule: str
    severity: str
    reason: str
    flag: Column | None
    sample: Column


def bind(df: DataFrame, constraints: list[dict], now=None) -> list[Check]:
    """The checks of a table; constraints on absent columns or without their values are skipped."""
    checks = []
    for constraint in constraints:
        rule, column = str(constraint.get("rule", "")).strip(), str(constraint.get("column", "")).strip()
        if rule and rule not in RULES:
            raise PlanError(f"Unknown rule {rule!r}; known: {list(RULES)}")
        targets = df.columns if column == "*" and rule == "forbidden_substring" else [column]
        for target in targets:
            if not rule or rule == "drop_column" or target not in df.columns:
                continue
            flag = _flag(df, target, rule, constraint, now)
            if flag is None and rule != "unique":
                continue
            default = "error" if rule in ERROR_RULES else "warning"
            checks.append(
                Check(
                    target, rule, str(constraint.get("severity", default)), str(constraint.get("reason", "")),
                    None if flag is None else F.coalesce(flag, F.lit(False)),
                    _sample(df, target, rule, constraint),
                )
            )
    return checks


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _sample(df: DataFrame, column: str, rule: str, constraint: dict) -> Column:
    if rule == "cross_field_compare":
        return F.to_json(F.struct(_c(column), _c(constraint["compare_column"])))
    if rule == "date_not_future":
        return dates.iso_text(dates.as_timestamp(_c(column), df.schema[column].dataType))
    if rule == "unique":
        return text.strip(_c(column).cast("string"))
    return _c(column).cast("string")


def _flag(df: DataFrame, column: str, rule: str, k: dict, now) -> Column | None:
    """True for an invalid value; null where the rule does not apply to the value."""
    c, shown = _c(column), _c(column).cast("string")
    value = str(k.get("value", "")).strip()
    number = numbers.as_number(c, df.schema[column].dataType)
    if rule == "unique":
        return None
    if rule == "required":
        return c.isNull() | (text.strip(shown) == "")
    if rule == "non_negative":
        return number < 0
    if rule == "percentage_range":
        return ~number.between(0, 100)
    if rule == "numeric_range":
        low, high = _bound(k.get("min_value"), float), _bound(k.get("max_value"), float)
        if low is None and high is None:
            return None
        return c.isNotNull() & _outside(number, low, high)
    if rule == "date_not_future":
        moment = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
        return dates.as_timestamp(c, df.schema[column].dataType) > moment
    if rule == "date_range":
        low, high = _bound(k.get("min_date"), str), _bound(k.get("max_date"), str)
        if low is None and high is None:
            return None
        ends = [None if e is None else F.lit(e).cast("timestamp_ntz") for e in (low, high)]
        return c.isNotNull() & _outside(dates.as_timestamp(c, df.schema[column].dataType), *ends)
    if rule in ("starts_with", "ends_with"):
        test = F.startswith if rule == "starts_with" else F.endswith
        return ~test(shown, F.lit(value)) if value else None
    if rule in ("contains", "forbidden_substring"):
        wanted = "".join(ch for ch in value.lower() if ch.isascii() and ch.isalnum())
        if not wanted:
            return None
        found = F.contains(text.compact_key(shown), F.lit(wanted))
        return ~found if rule == "contains" else found
    if rule == "regex_match":
        pattern = str(k.get("pattern", "")).strip()
        return ~shown.rlike(rf"\A(?:{pattern})") if pattern else None
    if rule in ("allowed_values", "not_allowed_values"):
        listed = sorted({str(v).strip().upper() for v in k.get(rule, []) if str(v).strip()})
        if not listed:
            return None
        member = F.upper(shown).isin(listed)
        return ~member if rule == "allowed_values" else member
    if rule == "length_range":
        low, high = _bound(k.get("min_length"), int), _bound(k.get("max_length"), int)
        if low is None and high is None:
            return None
        return c.isNotNull() & _outside(F.length(shown), low, high)
    return _cross_field(df, column, k)


def _cross_field(df: DataFrame, column: str, k: dict) -> Column | None:
    other, operator = str(k.get("compare_column", "")).strip(), str(k.get("operator", "")).strip()
    if other not in df.columns:
        return None
    a, b = (numbers.as_number(_c(name), df.schema[name].dataType) for name in (column, other))
    valid = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}
    return ~valid[operator] if operator in valid else None


def _bound(value, kind):
    if value is None or value == "":
        return None
    try:
        return kind(value)
    except (TypeError, ValueError):
        return None


def _outside(c: Column, low, high) -> Column:
    """Unreadable, below the lower or above the upper bound."""
    parts = [c.isNull()]
    if low is not None:
        parts.append(c < low)
    if high is not None:
        parts.append(c > high)
    return reduce(lambda x, y: x | y, parts[1:], parts[0]) if len(parts) > 1 else parts[0]


def validate(
    df: DataFrame, constraints: list[dict], order_by: list[str] | None = None, now=None, samples: int = SAMPLES,
) -> DataFrame:
    """The report: failing constraints with their count of invalid rows and first samples.

    ``order_by`` says which invalid values are the first; without it the order of the scan counts.
    """
    checks = bind(df, constraints, now)
    spark = df.sparkSession
    if not checks:
        return spark.createDataFrame([], REPORT_SCHEMA)
    order = F.struct(*[_c(c) for c in order_by]) if order_by else F.monotonically_increasing_id()
    plain = [(i, c) for i, c in enumerate(checks) if c.flag is not None]
    unique = [(i, c) for i, c in enumerate(checks) if c.flag is None]
    parts = []
    if plain:
        parts.append(_plain_report(df, plain, order, samples))
    if unique:
        parts.append(_unique_report(df, unique, order, samples))
    counted = reduce(DataFrame.unionByName, parts)
    facts = [(i, c.column, c.rule, c.severity, c.reason) for i, c in enumerate(checks)]
    described = spark.createDataFrame(facts, "idx int, column string, rule string, severity string, reason string")
    return (
        counted.join(F.broadcast(described), "idx")
        .orderBy("idx")
        .select("column", "rule", "severity", "reason", "invalid_count", "sample_values")
    )


def _plain_report(df: DataFrame, checks: list[tuple[int, Check]], order: Column, samples: int) -> DataFrame:
    totals = df.agg(*[F.count_if(c.flag).alias(f"n{i}") for i, c in checks])
    counts = totals.select(
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("idx"), F.col(f"n{i}").alias("invalid_count")) for i, _ in checks])
        )
    ).filter("invalid_count > 0")
    hits = F.array(
        *[F.when(c.flag, F.struct(F.lit(i).alias("idx"), c.sample.alias("value"))) for i, c in checks]
    )
    found = (
        df.select(order.alias("at"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit"))
        .select("at", "hit.idx", "hit.value")
    )
    return counts.join(F.broadcast(_first_samples(found, samples)), "idx", "left")


def _first_samples(found: DataFrame, samples: int) -> DataFrame:
    """At most ``samples`` samples per constraint as an array; one row per constraint."""
    first = ordered.first_per_key(found, ["idx"], [F.col("at"), F.col("value")], samples)
    pairs = F.array_sort(F.collect_list(F.struct("at", "value")))
    return first.groupBy("idx").agg(F.transform(pairs, lambda p: p["value"]).alias("sample_values"))


def _repeated(df: DataFrame, value: Column) -> DataFrame:
    """Non-blank stripped texts that occur more than once, with their counts."""
    shown = text.strip(value.cast("string"))
    return df.select(shown.alias("value")).filter("value <> ''").groupBy("value").count().filter("count > 1")


def _unique_report(df: DataFrame, checks: list[tuple[int, Check]], order: Column, samples: int) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("idx"), c.sample.alias("value")) for i, c in checks])
    repeated = (
        df.select(order.alias("at"), F.explode(pairs).alias("p"))
        .select("at", "p.idx", "p.value")
        .filter("value <> ''")
        .groupBy("idx", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
        .filter("n > 1")
    )
    counts = repeated.groupBy("idx").agg(F.sum("n").alias("invalid_count"))
    return counts.join(F.broadcast(_first_samples(repeated, samples)), "idx", "left")


def flag_rows(df: DataFrame, constraints: list[dict], now=None, errors: str = "errors") -> DataFrame:
    """Add an array of ``column:rule`` texts with every constraint a row breaks."""
    checks = bind(df, constraints, now)
    out, labels = df, []
    for i, check in enumerate(checks):
        flag = check.flag
        if flag is None:
            key = text.strip(_c(check.column).cast("string"))
            repeated = _repeated(df, _c(check.column))
            out = skew.join_counted(out, key, repeated, f"__dup{i}")
            flag = F.col(f"__dup{i}")
        labels.append(F.when(flag, F.lit(f"{check.column}:{check.rule}")))
    found = F.filter(F.array(*labels), lambda e: e.isNotNull()) if labels else F.array().cast("array<string>")
    return out.withColumn(errors, found).select(*df.columns, errors)


def quarantine(df: DataFrame, constraints: list[dict], now=None) -> tuple[DataFrame, DataFrame]:
    """Good rows as they are, and bad rows with their ``errors``."""
    flagged = flag_rows(df, constraints, now)
    return flagged.filter(F.size("errors") == 0).drop("errors"), flagged.filter(F.size("errors") > 0)


def drop_columns(df: DataFrame, constraints: list[dict]) -> DataFrame:
    """Apply the ``drop_column`` constraints."""
    gone = [k["column"] for k in constraints if k.get("rule") == "drop_column" and k["column"] in df.columns]
    return df.drop(*gone)


def constraints_from_filter(actions: list[dict]) -> list[dict]:
    """Constraints that say what a filter means for a table: kept values are allowed, dropped ones
    are not.

    Actions: ``{"action": "drop_columns", "columns": [...]}`` and
    ``{"action": "keep_rows" | "drop_rows", "conditions": [{"column", "operator", "value"}]}``.
    """
    out = []
    for action in actions:
        kind = action["action"]
        if kind == "drop_columns":
            for c in action["columns"]:
                out.append({"column": c, "rule": "drop_column", "severity": "warning", "reason": f"Removes {c}."})
            continue
        keep = kind == "keep_rows"
        for leaf in _leaves(action.get("conditions", [])):
            column, op, value = leaf["column"], leaf["operator"], leaf.get("value")
            base = {"column": column, "severity": "warning", "reason": f"Filters on {column}."}
            if op == "contains":
                out.append({**base, "rule": "contains" if keep else "forbidden_substring", "value": str(value)})
            elif op in ("eq", "in"):
                rule = "allowed_values" if keep else "not_allowed_values"
                listed = list(value) if isinstance(value, (list, tuple, set)) else [value]
                out.append({**base, "rule": rule, rule: [str(v) for v in listed]})
    return out


def _leaves(nodes: list[dict]) -> list[dict]:
    found = []
    for node in nodes:
        inner = node.get("conditions") or node.get("all") or node.get("any")
        found += _leaves(inner) if inner else [node]
    return found
