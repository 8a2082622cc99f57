"""Column-name helpers. They look at the schema only and never touch the data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import MissingColumnError, PlanError


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


ALL_TEXT = "__all_string_columns__"
ALL_NUMERIC = "__all_numeric_columns__"

# Header spellings of the general ledger and their column names.
LEDGER_ALIASES = {
    "date": "voucher_date",
    "entry no": "entry_no",
    "entry_number": "entry_no",
    "sub account": "sub_account",
    "ledger_name": "sub_account",
    "particulars": "details",
    "account class": "class",
    "account_class": "class",
    "account subclass": "sub_class",
    "account_subclass": "sub_class",
    "debit": "debit_amount",
    "credit": "credit_amount",
    "debit amount": "debit_amount",
    "credit amount": "credit_amount",
    "account code": "account_code",
}

# Finance roles, the names that show them, and the column each maps to.
FINANCE_ROLES = {
    "transaction_id": (
        "transaction_id",
        {"transaction_id", "txn_id", "tx_id", "transactionid", "order_id", "invoice_id", "id"},
    ),
    "merchant": (
        "merchant",
        {"merchant", "merchant_name", "vendor", "provider", "payment_method", "payment_type", "gateway"},
    ),
    "gender": ("gender", {"gender", "sex"}),
    "marital_status": (
        "marital_status",
        {"marital_status", "maritalstatus", "relationship_status", "civil_status"},
    ),
    "education": (
        "education_level",
        {"education", "education_level", "degree", "qualification", "academic_qualification"},
    ),
    "quantity": ("quantity", {"quantity", "qty", "qty_ordered", "units", "pieces", "volume", "count"}),
    "payment_value": (
        "payment_value",
        {
            "payment", "payment_value", "amount", "amt", "price", "cost", "value",
            "total", "subtotal", "unit_price", "debit_amount", "credit_amount",
        },
    ),
    "status": ("status", {"status", "transaction_status", "payment_status", "state"}),
    "date": (
        "transaction_date",
        {"date", "transaction_date", "txn_date", "invoice_date", "posting_date", "voucher_date"},
    ),
}

_NUMERIC = (T.NumericType,)
_DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, _NUMERIC)


def is_dated(data_type: T.DataType) -> bool:
    return isinstance(data_type, _DATED)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def require(df: DataFrame, columns) -> None:
    """Raise, listing every name that is not in the table."""
    wanted = [columns] if isinstance(columns, str) else list(columns)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise MissingColumnError(missing, df.columns)


def expand(df: DataFrame, columns) -> list[str]:
    """Column list of an op: a macro, one name, or names."""
    if columns is None or columns == ALL_TEXT or columns == [ALL_TEXT]:
        return text_columns(df)
    if columns == ALL_NUMERIC or columns == [ALL_NUMERIC]:
        return numeric_columns(df)
    names = [columns] if isinstance(columns, str) else list(columns)
    require(df, names)
    return names


def expand_text(df: DataFrame, columns) -> list[str]:
    """The text columns among those an op names."""
    texts = set(text_columns(df))
    return [c for c in expand(df, columns) if c in texts]


def expand_numeric(df: DataFrame, columns) -> list[str]:
    """The numeric columns among those an op names; all numeric columns by default."""
    numbers = set(numeric_columns(df))
    return [c for c in expand(df, ALL_NUMERIC if columns is None else columns) if c in numbers]


def words(name: str) -> list[str]:
    """Lower-case words of a name: cut at blanks, hyphens, underscores and case changes."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[^\s_-])(?=[A-Z][a-z])", " ", name.strip())
    return [w.lower() for w in re.split(r"[\s_-]+", spaced) if w]


def styled(name: str, style: str = "snake_case") -> str:
    """A column name in one of the four styles."""
    parts = words(name)
    if style == "lowercase":
        return name.strip().lower()
    if style == "snake_case":
        return "_".join(parts)
    if style == "camel_case":
        return "".join(w if i == 0 else w.capitalize() for i, w in enumerate(parts))
    if style == "pascal_case":
        return "".join(w.capitalize() for w in parts)
    raise PlanError(f"Unknown name style {style!r}")


def unique_names(names: list[str]) -> list[str]:
    """Add ``_2``, ``_3`` … to names that occur before, so that every column can be addressed."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 1
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def semantic_name(name: str) -> str:
    """Lower case, other characters than a-z and 0-9 as single underscores."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def source_name(name: str) -> str:
    """Header of an uploaded file: ledger alias if known, else the semantic name."""
    return LEDGER_ALIASES.get(name.strip().lower()) or semantic_name(name) or "column"


def ledger_name(name: str) -> str:
    """Header of a ledger file: alias if known, else only lower-cased."""
    lowered = name.strip().lower()
    return LEDGER_ALIASES.get(lowered, lowered)


def profile_name(name: str) -> str:
    """Name form used in profiles: blanks and hyphens as underscores, other signs dropped."""
    underscored = re.sub(r"[\s_-]+", "_", str(name).strip().lower())
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "", underscored)).strip("_")


def finance_roles(name: str) -> list[str]:
    """Every finance role whose names equal this one or have all their words in it."""
    normalized = semantic_name(name)
    tokens = set(normalized.split("_"))
    return [
        role
        for role, (_target, hints) in FINANCE_ROLES.items()
        if normalized in hints or any(set(hint.split("_")) <= tokens for hint in hints)
    ]


def finance_target(name: str) -> str | None:
    """The canonical column of the first role a name shows."""
    roles = finance_roles(name)
    return FINANCE_ROLES[roles[0]][0] if roles else None


def family(columns: list[str], reference: str) -> list[str]:
    """Columns belonging to a plural or singular reference: ``loans`` finds ``loan_amount``."""
    root = semantic_name(reference)
    root = root[:-1] if root.endswith("s") else root
    return [c for c in columns if root and semantic_name(c).startswith(root)]


# Words that make a result a money amount, or a percentage.
MONEY_UNIT_WORDS = (
    "revenue", "price", "amount", "cost", "sales", "profit",
    "total", "balance", "value", "income", "loan",
)
PERCENT_UNIT_WORDS = ("percent", "pct", "rate")


def unit_of(name: str, currency: str = "INR") -> str | None:
    """Unit guessed from a result name: the currency, ``percent`` or none."""
    lowered = name.lower()
    if any(word in lowered for word in MONEY_UNIT_WORDS):
        return currency
    if any(word in lowered for word in PERCENT_UNIT_WORDS):
        return "percent"
    return None
