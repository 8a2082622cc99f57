"""MAT: column and value matching over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.catalog.derived import DIRTY, dirty
from tidemark.operators import matching as ops
from tidemark.operators import ordered

catalog = Catalog()
query = catalog.query

TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[_\\s]+'), lambda x: x <> ''))"


def overlap_sql(a: str, b: str) -> str:
    x, y = TOKENS.format(c=a), TOKENS.format(c=b)
    return f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))"


def similarity_sql(a: str, b: str) -> str:
    return f"1.0 - levenshtein(lower({a}), lower({b})) / CAST(greatest(length({a}), length({b})) AS DOUBLE)"


PHRASE = "p_type || '_' || p_name"


@query("mat1_token_overlap", f"SELECT p_partkey, round({overlap_sql('p_name', PHRASE)}, 9) AS score FROM part")
def _(t: Tables):
    return t.part.select(
        "p_partkey", F.round(ops.token_overlap(F.col("p_name"), F.concat_ws("_", "p_type", "p_name")), 9).alias("score")
    )


@query("mat1_tokenize", "SELECT c_custkey, 'customer|name|' || c_custkey || 'x' AS tokens FROM customer")
def _(t: Tables):
    name = F.concat(F.lit("customerName_"), F.col("c_custkey").cast("string"), F.lit("X"))
    return t.customer.select("c_custkey", F.array_join(ops.tokens(name), "|").alias("tokens"))


@query("mat2_name_similarity", f"SELECT p_partkey, round({similarity_sql('p_name', 'p_type')}, 9) AS score FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.round(ops.name_similarity(F.col("p_name"), F.col("p_type")), 9).alias("score"))


VALUES = "[p_type, p_type || ' ' || split_part(p_name, ' ', 1) || ' x', p_brand]"


@query(
    "mat3_value_concept",
    f"""SELECT p_partkey, round(CASE WHEN list_contains(list_transform({VALUES}, lambda v: lower(v)), lower(ref)) THEN 1.0
  WHEN len(list_filter({VALUES}, lambda v: list_has_all({TOKENS.format(c='v')}, {TOKENS.format(c='ref')}))) > 0 THEN 0.8
  ELSE 0.6 * len(list_intersect({TOKENS.format(c='ref')}, flatten(list_transform({VALUES}, lambda v: {TOKENS.format(c='v')})))) / len({TOKENS.format(c='ref')}) END, 9) AS score
  FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE lower(p_type) || ' ' || split_part(p_name, ' ', 1) END AS ref FROM part)""",
)
def _(t: Tables):
    first = F.split("p_name", " ")[0]
    ref = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.col("p_name"))
    ref = ref.otherwise(F.concat_ws(" ", F.lower("p_type"), first))
    values = F.array("p_type", F.concat_ws(" ", "p_type", first, F.lit("x")), "p_brand")
    return t.part.select("p_partkey", F.round(ops.value_concept(ref, values), 9).alias("score"))


@query(
    "mat4_type_alignment",
    """SELECT p_partkey, CASE WHEN kind = 'semantic_concept' THEN CASE WHEN role IN ('measure', 'categorical') THEN 0.7 ELSE 0.4 END
  WHEN kind = 'value_implied' THEN CASE WHEN role = 'categorical' THEN 0.8 ELSE 0.3 END
  WHEN kind = 'explicit_name' THEN 0.5 ELSE 0.2 END::DOUBLE AS score FROM (
  SELECT p_partkey, ['semantic_concept', 'value_implied', 'explicit_name', 'other'][CAST(p_partkey % 4 AS INTEGER) + 1] AS kind,
  ['measure', 'categorical', 'text'][p_size % 3 + 1] AS role FROM part)""",
)
def _(t: Tables):
    kind = F.expr("element_at(array('semantic_concept', 'value_implied', 'Explicit_Name ', 'other'), cast(p_partkey % 4 as int) + 1)")
    role = F.expr("element_at(array('measure', 'Categorical', 'text'), p_size % 3 + 1)")
    return t.part.select("p_partkey", ops.type_alignment(kind, role).alias("score"))


def _schemas(t: Tables):
    """Part types as columns of their brand's dataset, with frequent names as sample values, and part
    names as references."""
    counts = t.part.groupBy("p_brand", "p_type", "p_name").count()
    top = ordered.first_per_key(counts, ["p_brand", "p_type"], [F.desc("count"), F.col("p_name")], 5)
    columns = top.groupBy(F.col("p_brand").alias("dataset"), F.col("p_type").alias("column_name")).agg(
        F.array_sort(F.collect_list("p_name")).alias("sample_values")
    ).withColumn("role", F.lit("categorical"))
    refs = t.part.select(
        F.col("p_brand").alias("dataset"), F.col("p_name").alias("reference_text"), F.lit("value_implied").alias("kind")
    ).distinct()
    return refs, columns


SCORED = f"""counts AS (SELECT p_brand, p_type, p_name, count(*) AS n FROM part GROUP BY ALL),
  cols AS (SELECT p_brand AS dataset, p_type AS column_name, list(p_name) AS vals FROM (SELECT * FROM counts
    QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY n DESC, p_name) <= 5) GROUP BY ALL),
  refs AS (SELECT DISTINCT p_brand AS dataset, p_name AS ref FROM part),
  pairs AS (SELECT r.dataset, ref, column_name, flatten(list_transform(vals, lambda v: {TOKENS.format(c='v')})) AS vt, vals FROM refs r JOIN cols c USING (dataset)),
  scored AS (SELECT dataset, ref, column_name, round(0.25 * ({overlap_sql('ref', 'column_name')}) + 0.25 * 0.8 + 0.25 * ({similarity_sql('ref', 'column_name')})
    + 0.25 * (CASE WHEN list_contains(list_transform(vals, lambda v: lower(v)), lower(ref)) THEN 1.0
      WHEN len(list_filter(vals, lambda v: list_has_all({TOKENS.format(c='v')}, {TOKENS.format(c='ref')}))) > 0 THEN 0.8
      ELSE 0.6 * len(list_intersect({TOKENS.format(c='ref')}, vt)) / len({TOKENS.format(c='ref')}) END), 9) AS total_score
    FROM pairs WHERE len(list_intersect({TOKENS.format(c='ref')}, list_concat(vt, {TOKENS.format(c='column_name')}))) > 0)"""


@query(
    "mat5_ranked_candidates",
    f"""WITH {SCORED} SELECT dataset, ref AS reference_text, column_name, total_score,
  CAST(row_number() OVER (PARTITION BY dataset, ref ORDER BY total_score DESC, column_name) AS INTEGER) AS rank FROM scored""",
)
def _(t: Tables):
    scored = ops.candidates(*_schemas(t))
    return scored.select("dataset", "reference_text", "column_name", F.round("total_score", 9).alias("total_score"), "rank")


@query(
    "mat6_decision",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, ref ORDER BY total_score DESC, column_name) AS rank FROM scored),
  top AS (SELECT dataset, ref, max(CASE WHEN rank = 1 THEN column_name END) AS best, max(CASE WHEN rank = 1 THEN total_score END) AS s1,
    coalesce(max(CASE WHEN rank = 2 THEN total_score END), 0) AS s2 FROM r GROUP BY ALL)
  SELECT dataset, ref AS reference_text, best AS best_column, CASE WHEN s1 >= 0.6 AND round(s1 - s2, 9) >= 0.1 THEN 'resolved' ELSE 'ambiguous' END AS decision FROM top""",
)
def _(t: Tables):
    scored = ops.candidates(*_schemas(t))
    return ops.decide(scored, threshold=0.6).select("dataset", "reference_text", "best_column", "decision")


@query(
    "mat7_tiered_match",
    f"""SELECT p_partkey, round(CASE WHEN lower(req) = lower(p_name) THEN 1.0 WHEN replace(lower(req), ' ', '_') = replace(lower(p_name), ' ', '_') THEN 0.95
  WHEN req = 'price' AND guess = 'currency' THEN 0.85 ELSE {similarity_sql('sreq', 'scol')} END, 9) AS score FROM (
  SELECT *, array_to_string(list_sort(string_split(lower(req), ' ')), ' ') AS sreq, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS scol FROM (
  SELECT *, ['currency', 'string'][CAST(p_partkey % 2 AS INTEGER) + 1] AS guess, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_')
    WHEN 2 THEN 'price' ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS req FROM part))""",
)
def _(t: Tables):
    req = F.expr(
        """case p_partkey % 4 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '_') when 2 then 'price'
           else concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) end"""
    )
    guess = F.expr("element_at(array('currency', 'string'), cast(p_partkey % 2 as int) + 1)")
    tier = ops.tier_score(req, F.col("p_name"), guess)
    return t.part.select("p_partkey", F.round(tier["score"], 9).alias("score"))


@query(
    "mat7_low_confidence_policy",
    f"SELECT CASE WHEN {similarity_sql('p_name', 'p_type')} >= 0.75 THEN 'allow' ELSE 'quarantine' END AS decision, count(*) AS n FROM part GROUP BY 1",
)
def _(t: Tables):
    decision = ops.low_confidence(ops.name_similarity(F.col("p_name"), F.col("p_type")), "quarantine")
    return t.part.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_KEY = "regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def presence(name: str, operator: str, value, condition: str, exact: str):
    @query(
        name,
        f"""WITH {DIRTY}, d AS (SELECT DISTINCT trim(segment, ' ') AS v FROM dirty WHERE trim(segment, ' ') <> ''), m AS (SELECT v FROM d WHERE {condition})
  SELECT 'segment' AS "column", count(*) > 0 AS matched, CASE WHEN count(*) = 0 THEN 'unresolved' WHEN count(*) FILTER (v IN ({exact})) > 0 THEN 'exact'
  ELSE 'normalized' END AS match_kind, count(*) AS match_count, (SELECT coalesce(string_agg(v, '|' ORDER BY v), '') FROM (SELECT v FROM m ORDER BY v LIMIT 5)) AS samples FROM m""",
    )
    def _(t: Tables):
        found = ops.value_presence(dirty(t), "segment", operator, value)
        return found.select("column", "matched", "match_kind", "match_count", F.array_join("sample_matches", "|").alias("samples"))


presence("mat8_presence_eq", "eq", "Mach inery", f"{_KEY.format(c='v')} = 'machinery'", "'Mach inery'")
presence("mat8_presence_in", "in", ["BUILDING", "furniture"], f"{_KEY.format(c='v')} IN ('building', 'furniture')", "'BUILDING', 'furniture'")
presence("mat8_presence_contains", "contains", "hold", f"contains({_KEY.format(c='v')}, 'hold')", "'hold'")
presence("mat8_presence_starts_with", "starts_with", "auto", f"starts_with({_KEY.format(c='v')}, 'auto')", "'auto'")
presence("mat8_presence_ends_with", "ends_with", "ure", f"suffix({_KEY.format(c='v')}, 'ure')", "'ure'")
presence("mat8_presence_none", "eq", "bicycle", f"{_KEY.format(c='v')} = 'bicycle'", "'bicycle'")

REQUESTED = ["Female", "male", "machinery"]


def _coverage_sql(columns: list[str]) -> str:
    keys = "('female', 'male', 'machinery')"
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {_KEY.format(c=c)}) FILTER ({_KEY.format(c=c)} IN {keys}) AS matched_values,
  3::BIGINT AS requested_values, round(count(DISTINCT {_KEY.format(c=c)}) FILTER ({_KEY.format(c=c)} IN {keys}) / 3.0::DOUBLE, 9) AS value_coverage FROM dirty"""
        for c in columns
    )


@query("mat9_value_coverage", f"WITH {DIRTY} " + _coverage_sql(["full_name", "segment", "money", "quantity", "signup", "gender"]))
def _(t: Tables):
    return ops.value_coverage(dirty(t), REQUESTED).withColumn("value_coverage", F.round("value_coverage", 9))


@query(
    "mat9_ground_values",
    f"""WITH {DIRTY}, c AS ({_coverage_sql(['full_name', 'segment', 'gender'])})
  SELECT "column", round(0.7 * value_coverage + CASE WHEN "column" = 'gender' THEN 0.3 ELSE 0 END + 0.05 + 0.05, 9) AS final_score,
  'none' AS selection_mode FROM c""",
)
def _(t: Tables):
    df = dirty(t).select("full_name", "segment", "gender")
    found = ops.ground_values(df, "gender", REQUESTED, "in")
    return found.select("column", F.round("final_score", 9).alias("final_score"), "selection_mode")


@query(
    "mat9_ground_single",
    f"""WITH {DIRTY} SELECT 'gender' AS "column", 'single' AS selection_mode FROM dirty
  WHERE lower(trim(gender)) IN ('female', 'male') GROUP BY ALL HAVING count(DISTINCT lower(trim(gender))) = 2""",
)
def _(t: Tables):
    df = dirty(t).select("full_name", "segment", "gender")
    return ops.ground_values(df, "gender", ["Female", "male"], "in").filter("supported").select("column", "selection_mode")


@query(
    "mat10_clause_score",
    """SELECT "column", score::DECIMAL(6, 3) AS score FROM (VALUES ('payment_method', 0.0), ('order_status', 1.0), ('o_totalprice', 0.24), ('customer_no', 0.88)) AS v("column", score)
  WHERE (SELECT count(*) FROM orders) > 0""",
)
def _(t: Tables):
    df = t.orders.selectExpr(
        "o_orderpriority as payment_method", "o_orderstatus as order_status", "o_totalprice", "concat('c', o_custkey) as customer_no"
    )
    scored = ops.score_clause(ops.profiled(df), "status", "eq", "completed")
    return scored.select("column", F.round("score", 6).cast("decimal(6,3)").alias("score"))
