import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from tidemark.errors import PlanError, UnknownOperatorError
from tidemark.plans import registry
from tidemark.plans.run import apply_ops, filter_prepared, params_hash, with_auto_prep
from tidemark.session import drop_scratch, path_exists, scratch_path
from tidemark.sources import files, readers, sinks
from tidemark.streaming import ingest, live, state


def test_json_shapes(spark, tmp_path):
    shapes = {
        "list": '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]',
        "flat": '{"a": 1, "b": "x"}',
        "nested": '{"total": 2, "zeta": [{"a": 1, "b": "x"}], "alpha": [{"q": 1}]}',
    }
    for name, text in shapes.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert rows(readers.json_rows(spark, str(tmp_path / "list.json"))) == [(1, "x"), (2, "y")]
    assert rows(readers.json_rows(spark, str(tmp_path / "flat.json"))) == [(1, "x")]
    assert rows(readers.json_rows(spark, str(tmp_path / "nested.json"))) == [(1, "x")]


def test_text_lines_are_numbered_per_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \n\t\nthree")
    (tmp_path / "b.txt").write_text("x\ny\n")
    got = readers.text_lines(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("f"), "line_number", "raw_text")
    assert rows(got) == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, "three"), ("b.txt", 1, "x"), ("b.txt", 2, "y")]


def test_text_lines_over_many_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.text_lines(spark, str(tmp_path)).filter(F.concat(F.lit("line "), F.col("line_number") - 1) != F.col("raw_text"))
        assert got.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_and_empty_rows(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Date,Entry No,Debit,x y\n2024-01-01,1.1,5,\n,,,\n")
    df = readers.csv(spark, str(tmp_path / "l.csv"), headers="source")
    assert df.columns == ["voucher_date", "entry_no", "debit_amount", "x_y"] and df.count() == 1
    assert readers.header(spark, str(tmp_path / "l.csv")) == ["Date", "Entry No", "Debit", "x y"]


def test_signatures(spark):
    data = [
        ("a.csv", b"x,y\n1,2\n"), ("b.csv", b"x,y\n1,2,3\n"), ("c.json", b'{"a": 1}'), ("d.json", b"{a}"), ("e.pdf", b"%PDF-1.7"),
        ("f.jpg", b"\xff\xd8\xff\xe0"), ("g.webp", b"RIFF1234WEBPxx"), ("h.txt", b"plain"), ("i.txt", b"\x00\x01"), ("j.tsv", b"a\tb\n1\t2"), ("k.png", b"nope"),
    ]
    df = files.check_signature(spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in data], "path string, length bigint, content binary"))
    assert {r["path"] for r in df.filter("matches").collect()} == {"a.csv", "c.json", "e.pdf", "f.jpg", "g.webp", "h.txt", "j.tsv"}


def test_inventory_and_guard(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "b.exe").write_text("y")
    found = files.inventory(files.read(spark, str(tmp_path)))
    assert found.count() == 2 and {len(d) for d in column(found, "sha256")} == {64}
    guarded = files.guard(files.read(spark, str(tmp_path)), 10).select(F.element_at(F.split("path", "/"), -1).alias("f"), "reason")
    assert rows(guarded) == [("a.csv", None), ("b.exe", "unsupported_extension")]


def test_output_names_are_plain():
    for bad in ("../evil_prefix", "a/b", "a\\b", ".", "..", ""):
        with pytest.raises(PlanError):
            files.safe_output("/data", bad)
    assert files.safe_output("/data/", "report") == "/data/report"


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(4)], "id int, name string, amount double")
    audit = [{"operation_type": "trim_whitespace", "origin": "filter_prep", "input_columns": ["id"]}, {"operation_type": "sort"}]
    mapping = [{"requested_field": "Name", "matched_column": "name", "confidence": 1.0}]
    parts = sinks.write_bundle(str(tmp_path), "out", df, None, audit, ["careful"], mapping)
    assert list(parts) == ["cleaned_data", "audit_log", "warnings", "column_mapping"]
    log = spark.read.parquet(parts["audit_log"]).orderBy("operation_type").collect()
    assert [(r["step_kind"], r["input_columns"]) for r in log] == [("user_requested", None), ("internal_preparation", '["id"]')]
    empty = sinks.write_bundle(str(tmp_path), "empty", df, df.limit(0))
    assert list(empty) == ["cleaned_data", "filtered_data", "audit_log", "warnings", "column_mapping"]
    assert spark.read.parquet(empty["audit_log"]).columns == list(sinks.AUDIT_COLUMNS)
    assert spark.read.parquet(empty["column_mapping"]).columns == list(sinks.MAPPING_COLUMNS)


def test_text_report(spark, tmp_path):
    df = spark.createDataFrame([(2, "bb"), (10, None)], "n int, s string")
    lines = column(sinks.text_report(df, ["n"], "Hi"), "line", "line_number")
    assert lines == ["Hi", "==", "", " n  s", " 2 bb", "10   "]
    path = sinks.write_text(df, str(tmp_path), "r.txt", ["n"])
    assert rows(spark.read.text(path)) == [(" 2 bb",), (" n  s",), ("10   ",)]


def test_row_store_replaces_only_given_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "key string, v int")
    sinks.replace_keys(df, path, "key", ["v"], 4)
    sinks.replace_keys(spark.createDataFrame([("a", 9)], "key string, v int"), path, "key", ["v"], 4)
    stored = lambda: sinks.stored_rows(spark, path).select("key", "record_index", "payload")
    assert rows(stored()) == [("a", 1, '{"v":9}'), ("b", 1, '{"v":1}')]
    empty = spark.createDataFrame([], "key string, v int")
    sinks.replace_keys(empty, path, "key", ["v"], 4, of_keys=spark.createDataFrame([("a",), (None,)], "key string"))
    assert rows(stored()) == [("b", 1, '{"v":1}')]
    sinks.replace_keys(empty, path, "key", ["v"], 4, of_keys=spark.createDataFrame([("b",)], "key string"))
    assert rows(stored()) == []


# --- plans --------------------------------------------------------------------------------------


def test_registry(spark):
    with pytest.raises(UnknownOperatorError):
        registry.find("mystery")
    with pytest.raises(PlanError):
        registry.register_op("filter", lambda df, o: df)
    with pytest.raises(PlanError, match="missing"):
        registry.check_coverage(["a", "b"], {"a": 1})
    registry.register_op("first_two", lambda df, o: df.limit(2), replace=True)
    assert apply_ops(spark.range(9), [{"type": "first_two"}]).df.count() == 2
    assert len(registry.CLEANING) == 19


def test_auto_prep_goes_before_the_first_filter():
    flt = {"type": "filter", "conditions": []}
    assert [o["type"] for o in with_auto_prep([{"type": "limit", "n": 1}, flt])] == ["limit", "filter_prep", "filter"]
    assert with_auto_prep([{"type": "trim_whitespace"}, flt])[0]["type"] == "trim_whitespace"


def test_filter_on_prepared_values_returns_the_originals(spark):
    df = spark.createDataFrame([(" Female ", "$5"), ("male", "$7")], "`Gender Name` string, pay string")
    out = filter_prepared(df, [{"column": "Gender Name", "operator": "eq", "value": "female"}, {"column": "pay", "operator": "lt", "value": 6}])
    assert rows(out) == [(" Female ", "$5")] and out.columns == ["Gender Name", "pay"]


def test_params_hash_ignores_key_order():
    assert params_hash({"a": 1, "b": 2}) == params_hash({"b": 2, "a": 1}) != params_hash({"a": 2, "b": 2})


# --- streams ------------------------------------------------------------------------------------


def test_stream_clean_equals_batch(spark, tables):
    from tidemark.catalog.streams import STREAM_OPS

    stream = ingest.read_parquet(spark, "/root/testdata/sf0.001/events*.parquet")
    got = ingest.to_table(live.clean(stream, STREAM_OPS), "equal")
    assert rows(got) == rows(apply_ops(tables.events, STREAM_OPS, audit=False).df)


def test_streams_refuse_ops_that_need_the_whole_table(spark):
    stream = ingest.read_parquet(spark, "/root/testdata/sf0.001/events*.parquet")
    for op in ({"type": "fill_nulls", "columns": ["value"], "strategy": "mean"}, {"type": "filter_prep"}):
        with pytest.raises(PlanError):
            live.clean(stream, [op])
    with pytest.raises(PlanError):
        live.flag(stream, [{"column": "value", "rule": "unique"}])
    assert live.clean(stream, [{"type": "fill_nulls", "columns": ["value"], "strategy": "zero"}]).isStreaming


def test_scratch_paths_are_new(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and spark.sparkContext.applicationId in first
    assert not path_exists(spark, first)
    spark.range(3).write.parquet(first)
    assert path_exists(spark, first)


def test_scratch_can_be_dropped(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    drop_scratch(spark)
    assert not path_exists(spark, path)


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"say ""hi"", twice"\n2,"two\nlines"\n')
    assert rows(readers.csv(spark, str(tmp_path / "q.csv"), multiline=True)) == [(1, 'say "hi", twice'), (2, "two\nlines")]
    path = sinks.write_csv(spark.createDataFrame([(1, 'x "y", z')], "a int, b string"), str(tmp_path), "out")
    parts = [f.read_text() for f in (tmp_path / "out").glob("*.csv")]
    assert 'a,b\n1,"x ""y"", z"\n' in parts
    assert rows(readers.csv(spark, path)) == [(1, 'x "y", z')]
