import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemark.errors import PlanError
from tidemark.functions import dates, names, numbers, text


def one(spark, expr, *values, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return column(df.select("i", expr(F.col("v")).alias("o")), "o", "i")


def test_strip_removes_every_white_space(spark):
    assert one(spark, text.strip, " a\t", "\n b ", None, " \t ") == ["a", "b", None, ""]


def test_title_starts_words_after_every_non_letter(spark):
    given = ["o'neil mc-donald 3RD", "ÉCOLE école", "", None]
    assert one(spark, text.title, *given) == ["O'Neil Mc-Donald 3Rd", "École École", "", None]
    assert [g.title() for g in given[:3]] == one(spark, text.title, *given[:3])


def test_keys(spark):
    assert one(spark, text.word_key, "Pay-Pal  (EU)", "!!") == ["pay pal eu", ""]
    assert one(spark, text.compact_key, "Pay-Pal  (EU)", None) == ["paypaleu", None]


def test_mask(spark):
    given = ["ann@x.org", "@x", "call 555-123-4567", "short", "a much longer note", None]
    shown = ["a***@x.org", "<redacted>", "****4567", "<redacted>", "a ***te", None]
    assert one(spark, text.mask, *given) == shown


def test_multi_value(spark):
    got = one(spark, text.multi_value, "'A' and 007; 2.50, A or b", "sand or band", "")
    assert got == [["A", "7", "2.5", "b"], ["sand", "band"], []]


def test_padded_id_keeps_long_numbers(spark):
    assert one(spark, lambda c: text.padded_id(c, "ID-"), 42, 1234567, schema="v bigint") == ["ID-00042", "ID-1234567"]


def test_to_number_reads_only_plain_numbers(spark):
    given = ["12", " -3.5 ", "1e3", ".5", "1d", "0x1F", "NaN", "Infinity", "1,000", "", None]
    assert one(spark, numbers.to_number, *given) == [12.0, -3.5, 1000.0, 0.5] + [None] * 7


def test_round_money_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.5,)], "v double")
    assert column(df.select(numbers.round_money(F.col("v"), "total").alias("o")), "o") == [0.12, 0.14, 2.5]
    assert column(df.select(numbers.round_money(F.col("v"), "mean_qty").alias("o")), "o") == [0.125, 0.135, 2.5]


def test_parse_date_by_shape(spark):
    given = ["2024-1-5", "2024-01-05 10:20:30.5", "2024/01/05", "1/2/2024", "13/2/2024", "Jan 5, 2024", "5 January 2024", "order 1234", "2024-02-30"]
    got = [None if v is None else v.isoformat() for v in one(spark, dates.parse_date, *given)]
    assert got == [
        "2024-01-05T00:00:00", "2024-01-05T10:20:30.500000", "2024-01-05T00:00:00", "2024-01-02T00:00:00", None,
        "2024-01-05T00:00:00", "2024-01-05T00:00:00", None, None,
    ]
    read = {
        "2024-01-05T10:00:00Z": "2024-01-05T10:00:00", "2024-01-05T10:00:00+02:00": "2024-01-05T08:00:00",
        "2024-01-05 10:00-0530": "2024-01-05T15:30:00", "2024-01-05T10:00:00.250Z": "2024-01-05T10:00:00.250000",
        "20240105": "2024-01-05T00:00:00", "01/02/24": "2024-01-02T00:00:00", "1/2/70": "1970-01-02T00:00:00",
        "05.01.2024": "2024-05-01T00:00:00", "5-Jan-2024": "2024-01-05T00:00:00", "jan 5, 2024": "2024-01-05T00:00:00",
        "5 September 24": "2024-09-05T00:00:00", "Sept. 5, 2024": "2024-09-05T00:00:00", "2024.1.5": "2024-01-05T00:00:00",
        "1/2/2024 3:04 PM": "2024-01-02T15:04:00", "1/2/2024 12:04 am": "2024-01-02T00:04:00",
        "Jan 5, 2024, 11:59:58 PM": "2024-01-05T23:59:58", "13:00 pm": None, "1/2/2024 13:04 PM": None,
        "20240105T101500Z": "2024-01-05T10:15:00", "20240105T101500+0200": "2024-01-05T08:15:00", "20240105T10150099": None,
        "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05T10:00:00", "Friday, 5 Jan 2024 10:00:00 +0100": "2024-01-05T09:00:00",
        "Jan 5th, 2024": "2024-01-05T00:00:00", "3rd March 2024": "2024-03-03T00:00:00", "Sat 2nd Mar 2024": "2024-03-02T00:00:00",
        "2024-01": "2024-01-01T00:00:00", "2024-13": None, "Wed 2024-01-03": "2024-01-03T00:00:00", "Monday": None,
        "on 2024-01-03 we": None, "x" * 70 + " 2024": None,
        "20241305": None, "5-Foo-2024": None, "12345678901": None, "2024-02-30": None, "31-Apr-2024": None,
    }
    assert one(spark, lambda c: dates.iso_text(dates.parse_date(c)), *read) == list(read.values())
    stamp = lambda f: one(spark, lambda c: dates.strftime(dates.parse_date(c), f), "2024-01-05 15:04:09", None)
    assert stamp("%Y-%m-%dT%H:%M:%S") == ["2024-01-05T15:04:09", None]
    assert stamp("%d of %B %Y") == ["05 of January 2024", None]
    assert stamp("%-d/%-m/%Y") == ["5/1/2024", None] and stamp("%Y Q%m") == ["2024 Q01", None]
    assert stamp("%I:%M %p, 100%% 'it''s'") == ["03:04 PM, 100% 'it''s'", None]
    with pytest.raises(PlanError):
        dates.strftime(F.lit(None), "%Q")
    day_first = one(spark, lambda c: dates.parse_date(c, dayfirst=True), "1/2/2024", "13/2/2024", "2/13/2024")
    assert [None if v is None else v.date().isoformat() for v in day_first] == ["2024-02-01", "2024-02-13", None]


def test_parse_date_with_formats(spark):
    got = one(spark, lambda c: dates.parse_date(c, ("dd.MM.yyyy", "yyyyMMdd")), "05.01.2024", "20240105", "x")
    assert [None if v is None else v.date().isoformat() for v in got] == ["2024-01-05", "2024-01-05", None]


def test_name_styles():
    assert names.styled("customerID") == "customer_id"
    assert names.styled(" Total--Amount  due") == "total_amount_due"
    assert names.styled("XMLParser") == "xml_parser"
    assert names.styled("order date", "camel_case") == "orderDate"
    assert names.styled("order date", "pascal_case") == "OrderDate"
    assert names.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_name_lookups():
    assert names.source_name("Entry No") == "entry_no"
    assert names.source_name("Cost / Centre") == "cost_centre"
    assert names.source_name("--") == "column"
    assert names.finance_target("Gateway") == "merchant"
    assert names.finance_target("customer") is None
    assert names.finance_roles("payment status") == ["payment_value", "status"]
    assert names.family(["age", "gender", "loan_amount", "loan_status", "loan_term_months"], "loans") == [
        "loan_amount", "loan_status", "loan_term_months",
    ]
    assert text.is_sensitive_name("Card No") and not text.is_sensitive_name("colour")
    assert [names.unit_of(n) for n in ("loan_amount", "pct_rate", "age")] == ["INR", "percent", None]
