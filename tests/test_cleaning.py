import pytest
from conftest import column, rows

from tidemark.errors import MissingColumnError, PlanError
from tidemark.operators import cleaning, columns
from tidemark.plans.run import apply_ops


def df_of(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_trim_keeps_nulls(spark):
    df = df_of(spark, "Name string", ("  John  ",), (None,), ("Alice",))
    assert column(cleaning.trim_whitespace(df), "Name") == ["John", None, "Alice"]


def test_currency_and_number(spark):
    df = df_of(spark, "Price string", ("$1,234.56",), ("€500",), ("-£10.5",), (None,), ("n/a",))
    assert column(cleaning.normalize_currency(df, "Price"), "Price") == [1234.56, 500.0, -10.5, None, None]
    df = df_of(spark, "Qty string", ("1,000",), ("2,500.5",), (None,))
    assert column(cleaning.normalize_number(df, "Qty"), "Qty") == [1000.0, 2500.5, None]


def test_drop_duplicates(spark):
    df = df_of(spark, "k string, n int", ("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5))
    assert rows(cleaning.drop_duplicates(df, ["k"], "first", ["n"])) == [("a", 1), ("b", 5), (None, 3)]
    assert rows(cleaning.drop_duplicates(df, ["k"], "last", ["n"])) == [("a", 2), ("b", 5), (None, 4)]
    assert rows(cleaning.drop_duplicates(df, ["k"], keep=False)) == [("b", 5)]
    twice = df.unionAll(df)
    assert rows(cleaning.drop_duplicates(twice)) == rows(df)
    assert rows(cleaning.drop_duplicates(twice, keep=False)) == []


def test_fill_nulls(spark):
    df = df_of(spark, "i int, x double, s string", (1, 1.0, "b"), (2, None, "a"), (3, 4.0, None), (4, 10.0, "a"), (5, None, "b"))
    fill = lambda strategy, c, value=None: column(cleaning.fill_nulls(df, [c], strategy, value), c, "i")
    assert fill("mean", "x") == [1.0, 5.0, 4.0, 10.0, 5.0]
    assert fill("median", "x") == [1.0, 4.0, 4.0, 10.0, 4.0]
    assert fill("zero", "x") == [1.0, 0.0, 4.0, 10.0, 0.0]
    assert fill("mode", "s") == ["b", "a", "a", "a", "b"]
    assert fill("empty_string", "s") == ["b", "a", "", "a", "b"]
    assert fill("constant", "s", "z") == ["b", "a", "z", "a", "b"]
    with pytest.raises(PlanError):
        fill("guess", "x")


def test_drop_nulls_counts_blanks(spark):
    df = df_of(spark, "a string, b string", (" ", "x"), ("y", None), (" ", "\t"), ("y", "x"))
    assert rows(cleaning.drop_nulls(df)) == [("y", "x")]
    assert rows(cleaning.drop_nulls(df, ["a", "b"], "all")) == rows(df_of(spark, "a string, b string", (None, "x"), ("y", None), ("y", "x")))


def test_normalize_date_modes(spark):
    df = df_of(spark, "d string", ("2024-01-05",), ("soon",), (None,))
    assert column(cleaning.normalize_date(df, "d", "%d/%m/%y"), "d") == ["05/01/24", None, None]
    assert column(cleaning.normalize_date(df, "d", "%Y", errors="ignore"), "d") == ["2024", "soon", None]
    with pytest.raises(Exception, match="no date: soon"):
        cleaning.normalize_date(df, "d", errors="raise").collect()


def test_coerce_type(spark):
    df = df_of(spark, "v string", ("1",), ("x",), (None,))
    assert column(cleaning.coerce_type(df, "v", "integer"), "v") == [1, None, None]
    assert column(cleaning.coerce_type(df, "v", "float", "ignore"), "v") == ["1", "x", None]
    assert column(cleaning.coerce_type(df_of(spark, "v string", ("",), ("no",), (None,)), "v", "boolean"), "v") == [False, True, True]
    with pytest.raises(Exception, match="not a whole number"):
        cleaning.coerce_type(df_of(spark, "v string", ("1.5",)), "v", "integer").collect()
    with pytest.raises(Exception, match="not a float"):
        cleaning.coerce_type(df, "v", "float", "raise").collect()


def test_categories_follow_cardinality(spark):
    many = spark.range(200).selectExpr("cast(id as string) as many", "element_at(array(' m', 'FEMALE', 'o', 'x-ray'), cast(id % 4 as int) + 1) as few")
    out = cleaning.normalize_categories(many)
    assert sorted(set(column(out, "few"))) == ["Female", "Male", "Other", "X-Ray"]
    edge = spark.range(51).selectExpr("concat('V', id) as c", "concat('V', id % 50) as d")
    kept = cleaning.normalize_categories(edge.selectExpr("upper(c) as c", "upper(d) as d"))
    assert "V50" in column(kept, "c")


def test_prep_needs_eighty_percent(spark):
    df = spark.range(10).selectExpr(
        "if(id < 8, cast(id as string), 'x') as mostly", "if(id < 7, cast(id as string), 'x') as partly",
        "if(id < 8, concat('$', id, ',000.50'), '?') as money", "if(id < 9, '13/02/2024', '') as day",
    )
    out = cleaning.prepare_for_filter(df)
    assert [f.dataType.typeName() for f in out.schema.fields] == ["double", "string", "double", "timestamp_ntz"]
    assert out.count() == 10
    assert out.filter("mostly is null").count() == 2
    with pytest.raises(PlanError, match="drop_duplicates"):
        cleaning.prepare_for_filter(df, ["drop_duplicates"])


def test_clean_twice_is_clean_once(tables):
    from tidemark.catalog.derived import dirty

    once = cleaning.default_clean(dirty(tables))
    assert rows(cleaning.default_clean(once)) == rows(once)


def test_column_ops(spark):
    df = df_of(spark, "a int, b int, `_c` int", (1, None, None), (None, None, 3))
    assert columns.drop_empty(df).columns == ["a", "_c"]
    assert columns.reorder(df, ["b", "x"]).columns == ["b", "a", "_c"]
    assert rows(columns.hide_internal(df)) == [(1, None)]
    assert columns.rename(df, {"a": "z", "q": "r"}).columns == ["z", "b", "_c"]
    with pytest.raises(MissingColumnError, match="nope"):
        columns.project(df, ["a", "nope"])
    assert columns.normalize_names(df_of(spark, "`A B` int, a_b int", (1, 2))).columns == ["a_b", "a_b_2"]


def test_audit_counts_rows_of_every_step(spark):
    df = df_of(spark, "Name string, n int", (" a ", 1), ("", 2), ("b", 3))
    result = apply_ops(df, [{"type": "trim_whitespace"}, {"type": "drop_nulls", "columns": ["Name"]}, {"type": "rename_columns", "mapping": {"n": "m"}}])
    assert rows(result.df) == [("a", 1), ("b", 3)]
    entries = result.entries()
    assert [(e["input_row_count"], e["output_row_count"]) for e in entries] == [(3, 3), (3, 2), (2, 2)]
    assert entries[2]["columns_modified"] == ["m", "n"]
    assert len({e["params_hash"] for e in entries}) == 3


def test_audit_has_warnings_and_times(spark):
    df = df_of(spark, "`cit y` string, name string, n int, d double", *[("ab"[i % 2], f"name {i}", i, float(i % 4)) for i in range(80)])
    result = apply_ops(df, [
        {"type": "normalize_categorical_values"},
        {"type": "filter", "conditions": [{"column": "n", "operator": "gte", "value": 20}]},
        {"type": "calculate", "calculation": "ratio", "column": "n", "secondary_column": "d", "output_column": "r"},
        {"type": "calculate", "calculation": "running_total", "column": "n", "sort_by": "n"},
        {"type": "calculate", "calculation": "running_total", "column": "n", "sort_by": "n", "partition_by": "name", "output_column": "q"},
    ])
    entries = result.entries()
    assert [e["warnings"] for e in entries] == [
        ["Columns of more than 50 values stay as they are: name"], [], ["15 rows have a zero in d; their ratio is null."],
        ["running_total has no partition_by, but these columns look like one: cit y"], [],
    ]
    assert result.warnings == [w for e in entries for w in e["warnings"]]
    assert [e["changed_values"] for e in entries] == [0, 20, 0, 0, 0]
    assert all(e["duration_ms"] == e["finished_at"] - e["started_at"] >= 0 and e["started_at"] > 1.6e12 for e in entries)
    assert result.audit().count() == 5


def test_audit_counts_all_rows_when_part_is_read(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as name", "id")
    ops = [{"type": "trim_spaces"}, {"type": "filter", "conditions": [{"column": "id", "operator": "lt", "value": 600}]}, {"type": "limit", "n": 10}]
    result = apply_ops(df, ops)
    assert len(result.df.take(5)) == 5
    assert [(e["input_row_count"], e["output_row_count"]) for e in result.entries()] == [(1000, 1000), (1000, 600), (600, 10)]
    assert apply_ops(df, []).entries() == []


def test_no_python_in_builtin_cleaning(tables):
    from tidemark.catalog.derived import dirty

    df = cleaning.normalize_categories(cleaning.text_case(cleaning.trim_whitespace(dirty(tables)), "title"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_replace_values_keeps_unlisted_and_maps_to_null(spark):
    df = df_of(spark, "s string", ("a",), ("b",), (None,))
    assert column(cleaning.replace_values(df, "s", {"a": "z", "q": "r"}), "s") == ["z", "b", None]
    table = df_of(spark, "old string, new string", ("a", "z"))
    assert rows(cleaning.replace_by_table(df, "s", table)) == rows(df_of(spark, "s string", ("z",), ("b",), (None,)))


def test_mask_by_name(spark):
    df = df_of(spark, "email string, colour string", ("ann@x.org", "red"))
    assert rows(cleaning.mask_sensitive(df)) == [("a***@x.org", "red")]


def test_names_with_dots(spark):
    df = df_of(spark, "`a.b` string, `c d` double", (" x ", None), (None, None), ("", 1.0))
    assert rows(columns.project(df, ["c d", "a.b"])) == rows(df.select("`c d`", "`a.b`"))
    assert rows(cleaning.drop_nulls(cleaning.trim_whitespace(df), ["a.b"])) == [("x", None)]
    assert sorted(column(cleaning.drop_empty_rows(df), "a.b")) == ["", " x "]
    assert columns.reorder(df, ["c d"]).columns == ["c d", "a.b"]
    assert cleaning.drop_duplicates(df, ["a.b"]).count() == 3


def test_mode_of_several_columns(spark):
    schema = "n int, x double, s string, d date, e string"
    df = df_of(spark, schema, *[(9, 1.5, "10", None, None), (10, None, "9", None, None), (None, 1.5, None, None, None)])
    df = df.withColumn("d", df["n"].cast("string").try_cast("date"))
    out = cleaning.fill_nulls(df, df.columns, "mode")
    assert out.dtypes == df.dtypes
    assert rows(out) == rows(df_of(spark, schema, (9, 1.5, "10", None, None), (10, 1.5, "9", None, None), (9, 1.5, "10", None, None)))
