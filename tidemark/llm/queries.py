"""One registered query for each text operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.llm import chat, ctw, langid, line_rules, merge_dropout, minhash, mixing, pii, repair, simhash, spotsigs, url_rules, vptree

catalog = Catalog()


@catalog.query("op1_mix_sources")
def op1_mix_sources(t):
    return mixing.mix(t.documents)


@catalog.query("op2_simhash_groups")
def op2_simhash_groups(t):
    return simhash.groups(t.documents)


@catalog.query("op8_line_rules")
def op8_line_rules(t):
    return line_rules.judge(t.documents)


@catalog.query("op10_url_rules")
def op10_url_rules(t):
    return url_rules.judge(t.pages)


@catalog.query("op9_language")
def op9_language(t):
    return langid.identify(t.documents)


@catalog.query("op7_context_tree_scores")
def op7_context_tree_scores(t):
    return ctw.score(t.documents)


@catalog.query("op3_merge_dropout")
def op3_merge_dropout(t):
    return merge_dropout.encoded(t.documents.select("doc_id", "text")).drop("text")


@catalog.query("op4_spot_signatures")
def op4_spot_signatures(t):
    return spotsigs.compared(t.documents)


@catalog.query(
    "op5_chat_format",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
        CAST(sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
            + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id
    """,
)
def op5_chat_format(t):
    extra = r"\### Assistant: </turn> ok"
    table = t.conversations.select("conv_id", "turn", "role", "text")
    added = t.spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], table.schema)
    return chat.read_back(chat.formatted(table.unionByName(added)))


@catalog.query("op6_personal_data")
def op6_personal_data(t):
    return pii.report(t.documents)


@catalog.query("op11_conversation_repair")
def op11_conversation_repair(t):
    """Faults planted in all conversations, found and repaired; the repaired texts as digests."""
    found = repair.repaired(repair.damaged(t.conversations), present="present")
    return found.withColumn("repaired_sha256", F.sha2(F.encode("repaired", "UTF-8"), 256)).drop("repaired")


def _kmeans_sql(rounds: int) -> str:
    """Assignment and means of every round as table expressions; lists hold the integer vectors."""
    ctes = ["""kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
        FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY 1, 2 LIMIT 16))"""]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS v, min(s) AS s FROM (SELECT rid, vec_id, kept.v AS x,
        {{'d': CAST(list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{n}.v[i]) * (kept.v[i] - c{n}.v[i]))) AS BIGINT), 'c': c}} AS s
        FROM kept, c{n}) GROUP BY rid)""")
        if n < rounds:
            ctes.append(f"""m{n} AS (SELECT c, list(q ORDER BY pos) AS v FROM (SELECT c, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
        FROM (SELECT s.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{n}) GROUP BY c, pos) GROUP BY c),
        c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} ON m{n}.c = c{n}.c)""")
    return f"""WITH {", ".join(ctes)} SELECT vec_id, CAST(s.c AS INTEGER) AS cluster, s.d AS distance,
        CAST(sum(s.d) OVER (PARTITION BY s.c) AS BIGINT) AS cluster_inertia, CAST(sum(s.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = s.c"""


@catalog.query("op12_vptree_clusters", _kmeans_sql(3))
def op12_vptree_clusters(t):
    found = vptree.clustered(t.embeddings)
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


@catalog.query(
    "op13_minhash_groups",
    r"""
    WITH RECURSIVE words AS (
        SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), sets AS (
        SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
        FROM words
    ), nodes AS (
        SELECT s, min(doc_id) AS node FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s
    ), shingles AS (SELECT node, len(s) AS n, unnest(s) AS x FROM nodes),
    links AS (
        SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node <> b.node
        GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
    ), reach AS (
        SELECT node AS a, node AS b FROM nodes
        UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
    ), least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM (
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least.component_id, doc_id) AS component_id
        FROM sets LEFT JOIN nodes ON nodes.s = list_sort(sets.s) LEFT JOIN least ON least.node = nodes.node)
    """,
)
def op13_minhash_groups(t):
    return minhash.near_duplicates(t.documents)
