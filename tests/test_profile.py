from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import fingerprints, matching, profile, semantics


def test_profile_counts(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x"), (2.0, None), (None, "yy"), (float("nan"), "z")], "ID double, t string")
    found = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert (found["ID"]["null_count"], found["ID"]["non_null_count"], found["ID"]["distinct_count"]) == (2, 3, 2)
    assert (found["ID"]["numeric_min"], found["ID"]["numeric_max"]) == (1.0, 2.0)
    assert (found["t"]["distinct_count"], found["t"]["average_text_length"]) == (3, 1.25)


def test_profile_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    row = semantics.with_guess(profile.profile_columns(df)).first()
    assert (row["distinct_count"], row["semantic_guess"], row["confidence"]) == (0, "string", 0.5)


def test_table_profile(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert rows(profile.table_profile(df)) == [(3, 2, 1)]


def test_rows_differ_by_where_a_null_is(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None), (None, None)], "x string, y string")
    assert rows(profile.table_profile(df)) == [(5, 2, 2)]


def test_long_texts_are_counted_by_digest_and_shown_whole(spark):
    """No text of more than LONG_CHARS characters goes through a shuffle; the shown ones are fetched."""
    long = ["same beginning " * 20 + end for end in ("one", "two", "two", "two")] + ["short", "short", "with \u0000 mark", None]
    df = spark.createDataFrame(list(enumerate(long)), "i int, t string")
    top = {r["rank"]: (r["value"], r["n"]) for r in profile.samples(df, "frequent", 4, ["i"], chars=None).filter("column = 't'").collect()}
    assert top[1] == (long[1], 3) and top[2] == ("short", 2)
    assert {top[3], top[4]} == {(long[0], 1), ("with  mark", 1)}
    assert {r["column"]: r["distinct_count"] for r in profile.distinct_counts(df).collect()} == {"i": 8, "t": 4}
    counts = profile.value_counts(df, ["i"])
    assert max(len(r["key"]) for r in counts.collect()) <= profile.LONG_CHARS
    light = {r["name"]: r["sample_values"] for r in profile.light_profile(df, ["i"]).collect()}
    assert light["t"].split("|") == [long[0], long[1], "short"]


def test_samples_are_masked_and_repeatable(spark):
    df = spark.createDataFrame([(1, "ann@x.org"), (2, "bob@y.org"), (3, "ann@x.org")], "i int, email string")
    frequent = profile.samples(df, "frequent", 1, ["i"]).filter("column = 'email'")
    assert rows(frequent) == [("email", 1, "a***@x.org", 2)]
    assert rows(profile.samples(df, "random", 2, ["i"])) == rows(profile.samples(df.orderBy(F.desc("i")), "random", 2, ["i"]))


def test_light_profile(spark):
    df = spark.createDataFrame([(1, "10", "b"), (2, "x", ""), (3, "9", "a"), (4, None, "b")], "i int, n string, s string")
    found = {r["name"]: r for r in profile.light_profile(df, ["i"]).collect()}
    assert (found["n"]["detected_type"], found["n"]["min_value"], found["n"]["max_value"]) == ("string", "9.0", "10.0")
    assert (found["s"]["distinct_count"], found["s"]["sample_values"], found["s"]["min_value"]) == (2, "b|a", "")
    assert found["i"]["detected_type"] == "number" and found["n"]["nullable"]


def test_fingerprints_change_with_the_schema_not_the_order(spark):
    a = spark.createDataFrame([(1, "x")], "A int, b string")
    b = a.select("b", F.col("A").alias("a"))
    digest = lambda df: fingerprints.schema_fingerprint(df).first()[0]
    assert digest(a) == digest(b) and len(digest(a)) == 64
    assert digest(a) != digest(a.withColumn("A", F.col("A").cast("bigint")))
    values = lambda df: fingerprints.profile_fingerprint(df).first()[0]
    assert values(a) == values(a) != values(a.withColumn("b", F.lit("y")))


def test_versions_of_a_path_are_paired_once(spark):
    made = lambda *data: spark.createDataFrame(data, "path string, sha256 string")
    before = made(("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"), ("d", "1"), (None, "1"), ("e", None))
    now = made(("a", "2"), ("a", "1"), ("b", "2"), ("b", "3"), ("c", "2"), ("c", "3"), ("n", "1"), (None, "1"), ("e", "1"))
    found = fingerprints.changed_files(now, before)
    assert rows(found.where("path <> 'n'")) == rows(spark.createDataFrame([
        ("a", "unchanged"), ("a", "unchanged"), ("b", "unchanged"), ("b", "changed"), ("c", "changed"), ("c", "new"), ("d", "gone"),
        ("e", "changed")], "path string, state string"))
    assert rows(found.where("path is null or path = 'n'")) == sorted([(None, "unchanged"), ("n", "new")], key=repr)
    many = fingerprints.changed_files(made(*[("p", str(i)) for i in range(9000)]), made(*[("p", str(i + 10)) for i in range(9010)]))
    assert {r["state"]: r["count"] for r in many.groupBy("state").count().collect()} == {"unchanged": 8990, "changed": 10, "gone": 10}


def test_roles(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, f"2024-01-0{i % 9 + 1}", "ab"[i % 2], f"text {i}") for i in range(60)], "user_id int, ok boolean, created string, grade string, note string")
    found = semantics.with_role(semantics.with_guess(profile.profile_columns(df)))
    assert {r["column"]: r["role"] for r in found.collect()} == {
        "user_id": "identifier", "ok": "boolean", "created": "temporal", "grade": "categorical", "note": "text",
    }


# --- matching -----------------------------------------------------------------------------------


def scores(spark, fn, *pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [round(r[0], 6) for r in df.orderBy("i").select(fn(F.col("a"), F.col("b"))).collect()]


def test_token_overlap(spark):
    pairs = [("payment method", "payment_method"), ("amount", "total_amount"), ("", ""), ("XMLParser", "xml_parser"), ("paymentMethod", "method")]
    assert scores(spark, matching.token_overlap, *pairs) == [1.0, 0.5, 0.0, 1.0, 0.5]


def test_name_similarity(spark):
    pairs = [("Payment_Method", "payment_method"), ("abc", "xyz"), ("", ""), ("a", ""), ("amount", "amounts")]
    assert scores(spark, matching.name_similarity, *pairs) == [1.0, 0.0, 1.0, 0.0, 0.857143]


def test_value_concept(spark):
    df = spark.createDataFrame(
        [(0, "paypal", ["PayPal ", "cash"]), (1, "unknown", ["cash"]), (2, "credit card", ["my credit card"]), (3, "credit slip", ["credit", "x"]), (4, "", ["a"]), (5, "a", [])],
        "i int, r string, v array<string>",
    )
    got = df.orderBy("i").select(matching.value_concept(F.col("r"), F.col("v"))).collect()
    assert [round(r[0], 6) for r in got] == [1.0, 0.0, 0.8, 0.3, 0.0, 0.0]


def test_alignment(spark):
    pairs = [("semantic_concept", "measure"), ("value_implied", "categorical"), ("generic_reference", "text"), ("odd", "text"), ("column_group", "measure")]
    assert scores(spark, matching.type_alignment, *pairs) == [0.7, 0.8, 0.3, 0.2, 0.4]


def test_blocking_changes_no_decision(spark):
    """Every reference scored against every column by brute force gives the same winners."""
    names_ = ["order_date", "totalAmount", "payment_method", "status", "customer_name", "amount"]
    values = [["2024"], ["10"], ["PayPal", "cash"], ["open", "closed"], ["Ann"], ["7"]]
    references = ["order date", "amount", "PayPal", "status", "customer", "zebra", "total amount"]
    columns = spark.createDataFrame([("d", n, "categorical", v) for n, v in zip(names_, values)], "dataset string, column_name string, role string, sample_values array<string>")
    refs = spark.createDataFrame([("d", r, "explicit_name") for r in references], "dataset string, reference_text string, kind string")
    decided = {r["reference_text"]: (r["best_column"], r["decision"]) for r in matching.decide(matching.candidates(refs, columns), 0.6).collect()}
    ref, col = F.col("reference_text"), F.col("column_name")
    total = 0.25 * (matching.token_overlap(ref, col) + matching.value_concept(ref, F.col("sample_values")) + 0.5 + matching.name_similarity(ref, col))
    every = refs.join(columns, "dataset").select("reference_text", "column_name", total.alias("s")).collect()
    for reference in references:
        ranked = sorted(((r["s"], r["column_name"]) for r in every if r["reference_text"] == reference), key=lambda p: (-round(p[0], 9), p[1]))
        resolved = ranked[0][0] >= 0.6 and round(ranked[0][0] - ranked[1][0], 9) >= 0.1
        assert (decided.get(reference, (None, "ambiguous"))[1] == "resolved") == resolved
        if resolved:
            assert decided[reference][0] == ranked[0][1]


def test_tiers(spark):
    df = spark.createDataFrame(
        [(0, "Amount", "amount", "currency"), (1, "total amount", "total_amount", "currency"), (2, "price", "net", "currency"), (3, "amounts", "amount", "string"), (4, "xyz", "amount", "string")],
        "i int, r string, c string, g string",
    )
    got = df.orderBy("i").select(matching.tier_score(F.col("r"), F.col("c"), F.col("g")).alias("t")).select("t.*").collect()
    assert [(round(r["score"], 2), r["reason"]) for r in got] == [
        (1.0, "exact"), (0.95, "normalized"), (0.85, "synonym"), (0.86, "fuzzy"), (0.0, "low_confidence"),
    ]


def test_value_presence(spark):
    df = spark.createDataFrame([("Female",), ("Male",), ("Female",), (None,)], "gender string")
    row = matching.value_presence(df, "gender", "eq", "Female").first()
    assert (row["matched"], row["match_kind"], row["match_count"], row["sample_matches"]) == (True, "exact", 1, ["Female"])
    assert matching.value_presence(df, "gender", "contains", "male").first()["match_count"] == 2
    assert matching.value_presence(df, "gender", "eq", "x").first()["match_kind"] == "unresolved"


def test_grounding_by_values(spark):
    df = spark.createDataFrame([("Female", "PhD", "Single"), ("Male", "MSc", "Married")], "gender string, education_level string, marital_status string")
    for reference, value, expected in (("gender", "female", "gender"), ("education", "PhD", "education_level"), ("marital status", "single", "marital_status")):
        found = matching.ground_values(df, reference, [value]).filter("supported").collect()
        assert [(r["column"], r["selection_mode"]) for r in found] == [(expected, "single")]


def test_value_concepts():
    assert matching.value_concepts("credit card") == {"text", "payment"}
    assert matching.value_concepts("2024-01-05") == {"numeric", "date"}
    assert matching.value_concepts("a@b.org") >= {"identifier"}
    assert matching.value_concepts(5) == {"numeric"}


def test_references_without_candidate_are_ambiguous(spark):
    refs = spark.createDataFrame([("d", "turnover", "measure")], "dataset string, reference_text string, kind string")
    columns = spark.createDataFrame([("d", "order_id", "identifier", ["1"])], "dataset string, column_name string, role string, sample_values array<string>")
    row = matching.decide(matching.candidates(refs, columns), 0.6, refs=refs).first()
    assert (row["reference_text"], row["best_column"], row["decision"]) == ("turnover", None, "ambiguous")


def test_more_spellings_of_comparisons():
    from tidemark.operators.filters import operator_name

    spelled = {"equal_to": "eq", "is_equal": "eq", "not_equal_to": "neq", "more_than": "gt", "greater_than_or_equal_to": "gte", "below": "lt", "less_than_or_equal_to": "lte", "contains_any": "in", "not_in_list": "not_in"}
    assert {k: operator_name(k) for k in spelled} == spelled
