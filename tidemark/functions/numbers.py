"""Numeric expressions: lenient parsing, money rounding, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An output whose name contains one of these is rounded to cents.
MONEY_WORDS = (
    "revenue", "price", "amount", "cost", "sales", "profit",
    "total", "sum", "balance", "value", "metric",
)

# Currency symbols and codes removed before a text is read as money.
CURRENCY_SYMBOLS = "$€£¥"
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR")

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_CODES = "|".join(CURRENCY_CODES)
_UNIT = f"([{CURRENCY_SYMBOLS}]|{_CODES})?"
CURRENCY_PATTERN = rf"(?i)^\s*{_UNIT}\s*[-+]?\d{{1,3}}([,\s]?\d{{3}})*(\.\d+)?\s*{_UNIT}\s*$"
CURRENCY_NOISE = rf"(?i)[{CURRENCY_SYMBOLS}]|\b({_CODES})\b"


def no_nan(c: Column) -> Column:
    """NaN and the infinities as null: a table has one missing value."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(c: Column) -> Column:
    """Text as double; anything that is not a plain decimal or scientific number is null."""
    text = c.cast("string")
    return no_nan(F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double")))


def as_number(c: Column, data_type: T.DataType) -> Column:
    """A column as double: numbers by cast, everything else read from its text."""
    return no_nan(c) if isinstance(data_type, T.NumericType) else to_number(c)


def is_money_name(name: str) -> bool:
    """Whether an output name asks for rounding to cents."""
    lowered = name.lower()
    return any(word in lowered for word in MONEY_WORDS)


def round_money(c: Column, name: str) -> Column:
    """Round half-even to two decimals when ``name`` is a money name."""
    return F.bround(c, 2) if is_money_name(name) else c


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero or null denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` in percent, rounded; null when there is nothing to divide by."""
    return F.bround(ratio(part, whole) * 100, digits)
