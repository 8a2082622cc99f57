import pytest
from conftest import rows

from tidemark.errors import PlanError
from tidemark.operators import ledger, rules


def report(df, *constraints, **options):
    return [(r["column"], r["rule"], r["invalid_count"], r["sample_values"]) for r in rules.validate(df, list(constraints), **options).collect()]


def k(column, rule, **more):
    return {"column": column, "rule": rule, **more}


def test_substring_ban_on_all_columns(spark):
    df = spark.createDataFrame([(1, "Card"), (2, "PayPal"), (3, "pay pal")], "i int, payment_method string")
    assert report(df, k("*", "forbidden_substring", value="PayPal"), order_by=["i"]) == [
        ("payment_method", "forbidden_substring", 2, ["PayPal", "pay pal"])
    ]
    assert report(df, k("payment_method", "forbidden_substring", value="card"), order_by=["i"])[0][2] == 1


def test_prefix(spark):
    df = spark.createDataFrame([("ACC100",), ("ZCC200",)], "account_number string")
    assert report(df, k("account_number", "starts_with", value="ACC")) == [("account_number", "starts_with", 1, ["ZCC200"])]


def test_future_date(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2031-05-06",)], "invoice_date string")
    found = report(df, k("invoice_date", "date_not_future"), now="2028-01-01")
    assert found == [("invoice_date", "date_not_future", 1, ["2031-05-06T00:00:00"])]


def test_unique_ignores_blanks_and_counts_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, " a"), (3, "b"), (4, ""), (5, " "), (6, None), (7, None), (8, "c"), (9, "c"), (10, "c")], "i int, v string")
    assert report(df, k("v", "unique"), order_by=["i"]) == [("v", "unique", 5, ["a", "c"])]


def test_length_counts_each_row(spark):
    df = spark.createDataFrame([("aaaa",), ("aaaa",), ("b",), (None,)], "v string")
    assert report(df, k("v", "length_range", max_length=3)) == [("v", "length_range", 2, ["aaaa", "aaaa"])]
    assert report(df, k("v", "length_range", min_length=1)) == []


def test_regex_matches_from_the_start_only(spark):
    df = spark.createDataFrame([("a1x",), ("xa1",)], "v string")
    assert report(df, k("v", "regex_match", pattern="a1|q"))[0][2:] == (1, ["xa1"])


def test_ranges(spark):
    df = spark.createDataFrame([("5",), ("x",), ("-1",), ("101",), (None,)], "v string")
    assert report(df, k("v", "numeric_range", min_value=0))[0][2] == 2
    assert report(df, k("v", "percentage_range"))[0][2] == 2
    assert report(df, k("v", "non_negative"))[0][2] == 1
    assert report(df, k("v", "numeric_range")) == []


def test_cross_field(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 1)], "a int, b int")
    assert report(df, k("a", "cross_field_compare", compare_column="b", operator="<")) == [
        ("a", "cross_field_compare", 1, ['{"a":3,"b":2}'])
    ]


def test_order_severity_and_unknown_rule(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    found = rules.validate(df, [k("b", "allowed_values", allowed_values=["y"]), k("a", "required", reason="needed"), k("gone", "required")]).collect()
    assert [(r["rule"], r["severity"], r["reason"]) for r in found] == [("allowed_values", "warning", ""), ("required", "error", "needed")]
    with pytest.raises(PlanError):
        rules.validate(df, [k("a", "mystery")])


def test_only_three_samples_in_order(spark):
    df = spark.range(1000).selectExpr("cast(1000 - id as int) as i", "cast(-id - 1 as string) as v")
    assert report(df, k("v", "non_negative"), order_by=["i"]) == [("v", "non_negative", 1000, ["-1000", "-999", "-998"])]


def test_quarantine_splits_the_table_with_a_hot_value(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then cast(id as string) end as v")
    good, bad = rules.quarantine(df, [k("v", "unique"), k("v", "required")])
    assert good.count() == 1000 and bad.count() == 2000
    assert {tuple(r["errors"]) for r in bad.select("errors").distinct().collect()} == {("v:unique",), ("v:required",)}


def test_constraints_from_filters():
    found = rules.constraints_from_filter(
        [
            {"action": "drop_columns", "columns": ["x"]},
            {"action": "keep_rows", "conditions": [{"all": [{"column": "a", "operator": "in", "value": ["p", "q"]}]}]},
            {"action": "drop_rows", "conditions": [{"column": "b", "operator": "contains", "value": "z"}]},
        ]
    )
    assert [(c["column"], c["rule"]) for c in found] == [("x", "drop_column"), ("a", "allowed_values"), ("b", "forbidden_substring")]
    assert found[1]["allowed_values"] == ["p", "q"]


def test_ledger(spark):
    columns = "idx int, voucher_date string, entry_no string, sub_account string, details string, account_code string, class string, sub_class string, country string, region string, debit_amount string, credit_amount string"
    good = (0, "2024-01-01", "3.2", "s", "d", "a", "c", "sc", "IN", "w", "5", None)
    bad = (1, "soon", "E1", " ", "d", "a", "c", None, "IN", "w", "x", "0")
    df = spark.createDataFrame([good, bad], columns)
    assert ledger.missing_columns(df) == []
    assert ledger.missing_columns(df.drop("country", "credit_amount")) == ["country", "credit_amount"]
    assert rows(ledger.error_report(df, "idx")) == sorted(
        [
            (3, "voucher_date", "Must be a valid date"), (3, "sub_account", "Required value is missing"),
            (3, "sub_class", "Required value is missing"), (3, "entry_no", "Must be in format 'N.N' (e.g. 1.1, 3.2), got 'E1'"),
            (3, "debit_amount/credit_amount", "Each row must have only one of debit_amount or credit_amount, not both"),
            (3, "debit_amount", "Must be numeric"), (3, "credit_amount", "Must be greater than zero"),
        ],
        key=repr,
    )
    derived = ledger.derive(df.filter("idx = 0")).first()
    assert (derived["entry_group"], derived["entry_line"], derived["debit_amount"], derived["credit_amount"]) == (3, 2, 5.0, None)


def test_ledger_report_caps_but_errors_do_not(spark):
    df = spark.range(300).selectExpr("id as idx", "cast(null as string) as voucher_date", "'x' as entry_no")
    assert ledger.row_errors(df, "idx").count() == 600
    capped = ledger.error_report(df, "idx").collect()
    assert len(capped) == 100 and sum(r["field"] == "voucher_date" for r in capped) == 25
