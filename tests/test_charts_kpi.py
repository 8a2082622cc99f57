import datetime

from conftest import column, rows
from pyspark.sql import functions as F

from tidemark.functions import jsons
from tidemark.operators import charts, kpi, tables


def test_identifiers_are_no_measures(spark):
    df = spark.createDataFrame([(1, "F", 10.0), (2, "M", 20.0), (3, "F", 30.0)], "customer_id int, gender string, income double")
    assert {r["id"]: r["role"] for r in charts.fields(df).collect()} == {"customer_id": "identifier", "gender": "dimension", "income": "measure"}
    df = spark.createDataFrame([(1, "p", 1.0)], "order_number int, product string, amount double")
    assert charts.fields(df).first()["role"] == "identifier"
    assert rows(charts.axes(charts.fields(df), "pie")) == [("pie", "product", "amount")]
    assert rows(charts.axes(charts.fields(df), "scatter")) == [("scatter", None, None)]


def test_fitness_reasons(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", None)], "c string, v double")
    roles = {"c": "category", "v": "measure"}
    reason = lambda out: out.first()["reason_code"]
    assert reason(charts.pie_fitness(df, ["c", "v"], roles)) == "pie_incompatible_negative_values"
    assert reason(charts.pie_fitness(df, ["c", "v"], roles, aggregated=False)) == "pie_incompatible_aggregation_required"
    assert reason(charts.pie_fitness(df, ["v"], roles)) == "pie_incompatible_category_count"
    assert reason(charts.scatter_fitness(df, ["c", "v"])) == "scatter_incompatible_insufficient_numeric_fields"
    assert reason(charts.bar_fitness(df.filter("v is null"), ["c", "v"], roles)) == "bar_incompatible_insufficient_rows"
    assert reason(charts.line_fitness(df, "gone", "time")) == "line_incompatible_missing_x_axis"
    assert reason(charts.line_fitness(df, "c", "measure")) == "line_incompatible_invalid_x_role"
    assert reason(charts.histogram_fitness(df, {"c": "category"})) == "histogram_incompatible_missing_measure"
    assert reason(charts.bar_fitness(df, ["c", "v"], roles)) is None


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert column(charts.histogram_bins(df, "v", 3), "n", "bin") == [2, 0, 0]


def test_trend_rollup(spark):
    day = datetime.date(2026, 6, 18)
    data = [(day, s, u, r) for s, u, r in [("queued", 2, 5), ("planning", 1, 0), ("running", 3, 7), ("succeeded", 4, 9), ("failed", 5, 11)]]
    row = kpi.daily_pivot(spark.createDataFrame(data, "day date, status string, uploads bigint, records bigint")).first()
    assert (row["uploads"], row["records"], row["pending"], row["running"], row["succeeded"], row["failed"]) == (15, 32, 3, 3, 4, 5)


def test_run_status(spark):
    steps = [("a", "calc", "succeeded"), ("a", "chart", "failed"), ("b", "calc", "partial"), ("b", "chart", "failed"), ("c", "calc", "succeeded")]
    out = kpi.run_status(spark.createDataFrame(steps, "run_id string, kind string, status string"))
    assert rows(out.select("run_id", "job_status")) == [("a", "completed_with_warnings"), ("b", "failed"), ("c", "complete")]


def test_agreement_counts_unavailable(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, None), (False, False)], "first boolean, second boolean")
    assert rows(kpi.agreement(df)) == [(4, 2, 1, 0.5)]


def test_message_hash_sees_order_and_text(spark):
    data = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "b"), (3, 1, "assistant", "a"), (4, 0, "user", "a")]
    hashes = {r["conv_id"]: r["content_hash"] for r in kpi.message_stats(spark.createDataFrame(data, "conv_id int, turn int, role string, text string")).collect()}
    assert hashes[1] == hashes[2] and len({hashes[1], hashes[3], hashes[4]}) == 3


def test_mixed_sort(spark):
    df = spark.createDataFrame([("b",), ("10",), (None,), ("9",), ("2024-01-02",), ("A",)], "v string")
    assert [r["v"] for r in df.orderBy(*tables.mixed_key(F.col("v"))).collect()] == [None, "9", "10", "2024-01-02", "A", "b"]


def test_lineage(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 1, 3), (4, None, 1)], "id int, parent_id int, version_number int")
    assert rows(tables.lineage(df).select("id", "root_id", "next_version")) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 2)]


# --- JSON ---------------------------------------------------------------------------------------


def payload(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    found = {}
    for r in jsons.explode_payload_rows(df, "p").orderBy("i", "pos").collect():
        found.setdefault(r["i"], []).append(r["row"])
    return [found.get(i, []) for i in range(len(texts))]


def test_payload_rows(spark):
    full = '{"record_count": 3, "cleaned_data": [{"a": 1}, {"a": 2}, {"a": 3}], "cleaned_preview": [{"a": 1}]}'
    cut = '{"record_count": 4621, "cleaned_preview": [{"a": 1}, {"a": 2}], "rows": [{"a": 9}]}'
    internal = '{"records": [{"invoice_id": "7", "vendor": "x", "_source": "s", "_issues": []}, {"_row_status": "ok"}]}'
    mixed = '{"records": [1, {"a": 1}], "data": [{"b": null}]}'
    assert payload(spark, full, cut, internal, mixed, "no json", None, "{}") == [
        [{"a": "1"}, {"a": "2"}, {"a": "3"}], [], [{"invoice_id": "7", "vendor": "x"}], [{"b": None}], [], [], [],
    ]


def test_merge_keeps_protected_keys(spark):
    df = spark.sql("select map('intent_id', 'a', 'note', 'x') as old, map('intent_id', 'b', 'note', 'y', 'extra', 'z', 'data_profile', 'p') as new")
    merged = df.select(jsons.merge_protected(F.col("old"), F.col("new")).alias("m")).first()["m"]
    assert merged == {"intent_id": "a", "note": "y", "extra": "z"}
    assert df.select(jsons.merge_protected(F.lit(None).cast("map<string,string>"), F.col("new")).alias("m")).first()["m"] == {"note": "y", "extra": "z"}


def test_stable_hash_ignores_order(spark):
    df = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '2', 'a', '1', 't', 'now') as y")
    row = df.select(jsons.stable_hash(F.col("x")), jsons.stable_hash(F.col("y"), ("t",))).first()
    assert row[0] == row[1]


def test_reconcile(spark):
    data = [("complete", "", [], None), ("complete", "", ["bad"], None), ("succeeded", "quarantined", [" "], None), ("failed", "complete", [], None), ("odd", "", [], None), ("complete", "", [], "boom"), ("running", "partial", [], None)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, code string, p string, e array<string>, err string")
    out = df.orderBy("i").select(jsons.reconcile_status(F.col("code"), F.col("p"), F.col("e"), F.col("err")).alias("s"))
    assert column(out, "s") == ["succeeded", "failed", "quarantined", "succeeded", None, "failed", "failed"]


def test_stable_hash_tells_objects_apart(spark):
    from tidemark.functions import jsons

    df = spark.sql(r"select map('a', '1\nb=2') v, map('a', '1', 'b', '2') w, map('a', cast(null as string)) x, map('a', 'null') y, map('a=1', '') z")
    row = df.select(*(jsons.stable_hash(df[c]) for c in "vwxyz")).first()
    assert len(set(row)) == 5


def test_recent_planner_runs_without_a_limit(spark, tables):
    from tidemark.catalog.derived import jobs

    every = kpi.recent_planner_runs(jobs(tables)).count()
    assert every == kpi.planner_facts(jobs(tables)).first()["total_runs"] > 5 == kpi.recent_planner_runs(jobs(tables), 5).count()
