import pytest
from conftest import rows

from tidemark.errors import MissingColumnError, PlanError, UnknownOperatorError
from tidemark.operators import filters


@pytest.fixture(scope="module")
def df(spark):
    data = [(1, "PayPal", 10.0), (2, "cash", 20.0), (3, "pay pal", None), (4, "credit card", 40.0), (5, None, 50.0), (6, " none ", 60.0)]
    return spark.createDataFrame(data, "id int, method string, amount double")


def ids(df, *conditions, **options):
    return sorted(r["id"] for r in filters.apply_filter(df, list(conditions), **options).collect())


def c(column, operator, value=None, **more):
    return {"column": column, "operator": operator, "value": value, **more}


def test_contains_is_literal(spark):
    df = spark.createDataFrame([(1, "A[B]"), (2, "AB"), (3, "C")], "id int, code string")
    assert ids(df, c("code", "contains", "[B]")) == [1]
    assert ids(df, c("code", "contains", "[b]", case_sensitive=True)) == []


def test_in_matches_by_key(df):
    assert ids(df, c("method", "in", ["paypal", "cash"])) == [1, 2, 3]
    assert ids(df, c("method", "not_in", ["paypal", "cash"])) == [4, 5, 6]


def test_negative_predicates_keep_nulls(df):
    assert ids(df, c("method", "neq", "cash")) == [1, 3, 4, 5, 6]
    assert ids(df, c("method", "not_contains", "pa")) == [2, 4, 5, 6]
    assert ids(df, c("method", "eq", "none")) == [6]
    assert ids(df, c("amount", "neq", 10)) == [2, 3, 4, 5, 6]


def test_keep_and_drop_partition_the_table(df):
    conditions = [c("amount", "gt", 15), c("method", "contains", "a")]
    for logic in ("and", "or"):
        keep, drop = (ids(df, *conditions, logic=logic, mode=m) for m in ("keep", "drop"))
        assert sorted(keep + drop) == [1, 2, 3, 4, 5, 6] and not set(keep) & set(drop)


def test_negated_group(df):
    tree = {"any": [c("method", "eq", "cash"), c("amount", "gte", 40)], "negated": True}
    assert sorted(r["id"] for r in filters.apply_filter(df, tree).collect()) == [1, 3]


def test_aggregate_values(df):
    assert ids(df, c("amount", "gt", {"function": "avg"})) == [4, 5, 6]
    assert ids(df, c("amount", "gte", {"function": "median"})) == [4, 5, 6]
    assert ids(df, c("amount", "lt", {"function": "max", "where": {"column": "method", "value": "Cash"}})) == [1]
    with pytest.raises(UnknownOperatorError):
        ids(df, c("amount", "gt", {"function": "mystery"}))


def test_filter_by_value_table(spark, df):
    wanted = spark.createDataFrame([("PAY PAL",), ("cash",), ("cash",), (" ",), (None,)], "m string")
    assert rows(filters.filter_by_values(df, "method", wanted).select("id")) == [(1,), (2,), (3,)]
    assert rows(filters.filter_by_values(df, "method", wanted, negate=True).select("id")) == [(4,), (5,), (6,)]


def test_checks(df):
    with pytest.raises(MissingColumnError, match="gone"):
        ids(df, c("gone", "eq", 1))
    for bad in (c("method", "gt", "a"), c("amount", "between", 1), c("amount", "in", 1), c("amount", "eq")):
        with pytest.raises(PlanError):
            ids(df, bad)
    with pytest.raises(UnknownOperatorError):
        ids(df, c("amount", "resembles", 1))


def test_select_then_limit(df):
    out = filters.apply_filter(df, [c("amount", "gt", 0)], select=["amount"], limit=2)
    assert out.columns == ["amount"] and out.count() == 2


def test_filters_reach_the_scan(tables):
    plan = filters.apply_filter(tables.orders, [c("o_totalprice", "gt", 5000), c("o_custkey", "neq", 3)], select=["o_orderkey"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,5000" in text
    assert "EqualTo(o_custkey,3)" in text
    assert "o_orderdate" not in text.split("ReadSchema")[1]


def test_scopes(spark, df):
    users = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "id int, manager_id int")
    assert rows(filters.owner_scope(df, "id", "manager", 9, users).select("id")) == [(1,), (2,)]
    assert filters.owner_scope(df, "id", "admin", 0).count() == 6
    with pytest.raises(PlanError):
        filters.owner_scope(df, "id", "visitor", 0)


def test_texts_as_numbers_and_dates(df, tables):
    assert ids(df, c("amount", "eq", "20")) == [2]
    assert ids(df, c("amount", "eq", "twenty")) == []
    assert ids(df, c("amount", "neq", "twenty")) == [1, 2, 3, 4, 5, 6]
    assert ids(df, c("id", "in", ["1", 4, "x"])) == [1, 4]
    assert ids(df, c("amount", "gt", "45")) == [5, 6]
    with pytest.raises(PlanError, match="needs numbers"):
        ids(df, c("amount", "gt", "many"))
    with pytest.raises(PlanError, match="Not a date"):
        filters.apply_filter(tables.orders, [c("o_orderdate", "gt", "soon")])
