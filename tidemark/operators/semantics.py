"""Semantic guess, broad type and role of columns: rules over profile rows.

Profile rows number as many as a table has columns; the rules are Columns over them, so profiles of
many tables can be classified together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name parts that hint at a meaning.
DATE_HINTS = ("date", "time", "timestamp", "dob", "birthday", "birth_date", "created", "modified", "updated", "_at")
CURRENCY_HINTS = (
    "price", "amount", "cost", "revenue", "total", "fee", "salary", "income",
    "balance", "currency", "usd", "eur", "gbp",
)
CATEGORY_HINTS = ("status", "state", "category", "type", "kind", "group", "class", "segment", "tier", "mode")

# Tags that decide a broad type.
PRODUCT_TAGS = ("product", "item", "sku", "goods", "catalog", "catalogue", "material", "article", "title")
PAYMENT_TAGS = (
    "payment", "pay", "method", "mode", "tender", "merchant", "vendor", "seller",
    "payee", "wallet", "card", "cash", "upi", "bank",
)
STATUS_TAGS = ("status", "state", "stage", "progress", "outcome", "result", "flag", "approval")
IDENTIFIER_TAGS = ("id", "identifier", "uuid", "key", "code", "reference", "ref", "txn", "transaction")

TEXT_TYPES = ("string",)
NUMBER_TYPES = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"
DATE_TYPES = ("date", "timestamp", "timestamp_ntz")


def _hinted(name: Column, hints: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(name, h))


def _tagged(tags: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted]))


def with_guess(profile: DataFrame) -> DataFrame:
    """Add ``semantic_guess`` and ``confidence`` to the rows of ``profile_columns``."""
    name, kind = F.lower(F.trim("column")), F.col("data_type")
    is_text, is_number = kind.isin(*TEXT_TYPES), kind.rlike(NUMBER_TYPES)
    n, d = F.col("non_null_count"), F.col("distinct_count")
    guess = [
        (kind == "boolean", "boolean", 1.0),
        (kind.isin(*DATE_TYPES), "date", 1.0),
        (_hinted(name, DATE_HINTS) & is_text & (F.col("date_rate") >= 0.6), "date", 0.9),
        (_hinted(name, DATE_HINTS), "date", 0.7),
        (_hinted(name, CURRENCY_HINTS) & is_number, "currency", 0.9),
        (_hinted(name, CURRENCY_HINTS) & is_text & (F.col("symbol_rate") >= 0.5), "currency", 0.85),
        (_hinted(name, CURRENCY_HINTS), "currency", 0.7),
        (_hinted(name, CATEGORY_HINTS) & ~is_number, "categorical", 0.8),
        (is_text & (F.col("symbol_rate") >= 0.7), "currency", 0.8),
        (is_number, "numeric", 0.85),
        (is_text & (n == 0), "string", 0.5),
        (is_text & (d <= 20) & (n >= 5) & (d <= n * 0.5), "categorical", 0.75),
        (is_text, "string", 0.6),
    ]
    label, score = F.lit("unknown"), F.lit(0.0)
    for condition, meaning, confidence in reversed(guess):
        hit = F.coalesce(condition, F.lit(False))
        label = F.when(hit, meaning).otherwise(label)
        score = F.when(hit, confidence).otherwise(score)
    return profile.withColumn("semantic_guess", label).withColumn("confidence", score)


def name_tags(name: Column) -> Column:
    """The lower-case letter and digit runs of a name."""
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), F.lit(1)))


def with_broad_type(profile: DataFrame, tags: Column | None = None) -> DataFrame:
    """Add ``broad_type`` and ``match_score``; tags default to the words of the column name."""
    tags = name_tags(F.col("column")) if tags is None else tags
    guess, n, d = F.col("semantic_guess"), F.col("non_null_count"), F.col("distinct_count")
    few = F.greatest(F.lit(10), F.floor(F.greatest(n, F.lit(1)) * 0.25))
    has = lambda word: F.array_contains(tags, word)
    broad = (
        F.when((guess == "date") | has("date"), "date")
        .when((guess == "currency") | has("currency"), "currency")
        .when(guess == "numeric", "numeric")
        .when((guess == "boolean") | has("boolean"), "boolean")
        .when(_tagged(tags, PRODUCT_TAGS), "product")
        .when(_tagged(tags, PAYMENT_TAGS), "payment")
        .when(_tagged(tags, STATUS_TAGS), "status")
        .when(_tagged(tags, IDENTIFIER_TAGS), "identifier")
        .when(F.col("average_text_length") >= 18, "free_text")
        .when(d <= few, "categorical")
        .when(guess == "categorical", "categorical")
        .when(guess == "string", "free_text")
        .otherwise("unknown")
    )
    b = F.col("broad_type")
    base = (
        F.when(b.isin("date", "currency", "numeric", "boolean"), 0.95)
        .when(b.isin("product", "payment", "status", "identifier"), 0.85)
        .when(b == "categorical", 0.75)
        .when(b == "free_text", 0.7)
        .otherwise(0.35)
    )
    sure = F.when(F.col("confidence") >= 0.9, 0.9).otherwise(0.0)
    own = (
        ((b == "product") & _tagged(tags, PRODUCT_TAGS))
        | ((b == "payment") & _tagged(tags, PAYMENT_TAGS))
        | ((b == "status") & _tagged(tags, STATUS_TAGS))
        | ((b == "identifier") & _tagged(tags, IDENTIFIER_TAGS))
    )
    score = F.greatest(base, sure, F.when(own, 0.92).otherwise(0.0))
    return profile.withColumn("broad_type", broad).withColumn("match_score", score).withColumn("tags", tags)


def with_role(profile: DataFrame) -> DataFrame:
    """Add ``role`` and ``role_confidence``: identifier, boolean, temporal, measure, categorical,
    dimension, text or unknown."""
    name, kind, guess = F.col("column"), F.col("data_type"), F.col("semantic_guess")
    n, d = F.col("non_null_count"), F.col("distinct_count")
    share = F.try_divide(d, n)
    known = (n > 0) & (d > 0)
    rules = [
        (name.rlike("(?i)(^id$|^uuid$|_id$)"), "identifier", 0.9),
        ((guess == "boolean") | (kind == "boolean"), "boolean", 0.95),
        ((guess == "date") | kind.isin(*DATE_TYPES), "temporal", 0.9),
        (guess.isin("numeric", "currency") | kind.rlike(NUMBER_TYPES), "measure", 0.85),
        (guess == "categorical", "categorical", 0.8),
        (known & (share <= 0.05) & (d <= 20), "categorical", 0.75),
        (known & (share <= 0.2) & (d <= 50), "dimension", 0.7),
        ((guess == "string") & known & (share > 0.5), "text", 0.7),
        (guess == "string", "text", 0.6),
    ]
    role, score = F.lit("unknown"), F.lit(0.3)
    for condition, label, confidence in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        role = F.when(hit, label).otherwise(role)
        score = F.when(hit, confidence).otherwise(score)
    return profile.withColumn("role", role).withColumn("role_confidence", score)
