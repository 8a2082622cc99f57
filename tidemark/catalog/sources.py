"""SRC and SNK: files written from the given tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Tables
from tidemark.errors import PlanError
from tidemark.functions import jsons
from tidemark.plans.run import apply_ops
from tidemark.session import scratch_path
from tidemark.sources import files, readers, sinks

catalog = Catalog()
query = catalog.query


def _out(t: Tables, label: str) -> str:
    return scratch_path(t.spark, label)


@query("src1_csv", "SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(t: Tables):
    path = sinks.write_csv(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), _out(t, "csv"), "orders")
    return readers.csv(t.spark, path)


@query("src1_csv_schema", "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate FROM orders")
def _(t: Tables):
    path = sinks.write_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), _out(t, "csv"), "orders")
    return readers.csv(t.spark, path, schema="o_orderkey bigint, o_totalprice double, o_orderdate string")


@query("src2_tsv", "SELECT l_orderkey::INTEGER AS l_orderkey, l_quantity, l_returnflag FROM lineitem")
def _(t: Tables):
    path = _out(t, "tsv")
    t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag").write.option("header", True).option("sep", "\t").csv(path)
    return readers.tsv(t.spark, path)


def _order_documents(t: Tables, wrap):
    """One JSON document per order with its line items."""
    item = F.struct("l_linenumber", "l_partkey")
    return t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(item)).alias("items")).select(wrap.alias("value"))


@query("src3_json_list", "SELECT l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem")
def _(t: Tables):
    path = _out(t, "json-list")
    _order_documents(t, F.col("items")).write.text(path)
    return readers.json_lines(t.spark, path)


@query("src3_json_split", "SELECT l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem")
def _(t: Tables):
    """Lists of objects that any number of tasks read from the middle."""
    path = _out(t, "json-split")
    _order_documents(t, F.col("items")).write.text(path)
    return readers.json_rows(t.spark, path, "l_linenumber bigint, l_partkey bigint", splittable=True)


@query("src3_json_nested", "SELECT l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem")
def _(t: Tables):
    path = _out(t, "json-nested")
    document = F.concat(F.lit('{"name": "order", "rows": '), F.col("items"), F.lit("}"))
    _order_documents(t, document).write.text(path)
    return readers.json_rows(t.spark, path, lines=True)


@query("src3_json_flat", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    path = _out(t, "json-flat")
    t.events.select("event_id", "event_type", "value").write.json(path)
    return readers.json_rows(t.spark, path, lines=True)


@query("src3_json_documents", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(t: Tables):
    path = _out(t, "json-documents")
    item = F.struct("n_nationkey", "n_name")
    documents = t.nation.groupBy("n_regionkey").agg(
        F.concat(F.lit('{"total": 1, "rows": '), F.to_json(F.collect_list(item)), F.lit("}")).alias("value")
    )
    documents.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.json_rows(t.spark, f"{path}/*")


@query(
    "src4_text_lines",
    """SELECT raw_text, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')), ' ' || chr(9)) AS raw_text FROM documents)
  WHERE raw_text <> '' GROUP BY 1""",
)
def _(t: Tables):
    path = _out(t, "text")
    t.documents.select("text").write.text(path)
    return readers.text_lines(t.spark, path).groupBy("raw_text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src4_line_numbers",
    """SELECT count(*) AS lines, true AS numbered FROM (SELECT trim(unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')), ' ' || chr(9)) AS raw_text FROM documents)
  WHERE raw_text <> ''""",
)
def _(t: Tables):
    path = _out(t, "text")
    t.documents.select("text").write.text(path)
    per_file = readers.text_lines(t.spark, path).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_number").alias("low"), F.max("line_number").alias("high"),
        F.sum("line_number").alias("total"),
    )
    gapless = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("total") * 2 == F.col("n") * (F.col("n") + 1))
    return per_file.agg(F.sum("n").alias("lines"), F.bool_and(gapless).alias("numbered"))


@query(
    "src5_headers",
    "SELECT o_orderkey::INTEGER AS entry_no, o_orderpriority AS sub_account, o_totalprice AS debit_amount, o_custkey::INTEGER AS cost_centre, "
    "o_orderstatus AS column FROM orders",
)
def _(t: Tables):
    path = _out(t, "headers")
    named = t.orders.selectExpr(
        "o_orderkey as `Entry No`", "o_orderpriority as `Ledger_Name`", "o_totalprice as `Debit`", "o_custkey as `Cost / Centre`",
        "o_orderstatus as `--`",
    )
    named.write.option("header", True).csv(path)
    return readers.csv(t.spark, path, headers="source")


@query(
    "src6_drop_empty_rows",
    "SELECT o_custkey::INTEGER AS o_custkey, o_orderpriority FROM (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders) WHERE o_custkey IS NOT NULL OR o_orderpriority IS NOT NULL",
)
def _(t: Tables):
    path = _out(t, "empty-rows")
    df = t.orders.select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    df.write.option("header", True).csv(path)
    return readers.csv(t.spark, path, headers="ledger")


@query("src7_preview", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 50")
def _(t: Tables):
    return readers.preview(t.orders.select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


@query(
    "src8_combine",
    """SELECT c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS sub_account FROM customer
  UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier""",
)
def _(t: Tables):
    a = t.customer.selectExpr("c_name as `Name`", "c_acctbal as `Balance `", "c_nationkey as ` `")
    b = t.supplier.selectExpr("s_name as `name`", "s_acctbal as `balance`", "'supplier' as `Sub Account`")
    return readers.combine([a, b])


def _as_files(t: Tables):
    """Pages and documents as files: path, length and content."""
    pages = t.pages.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    texts = t.documents.select(F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    both = pages.unionByName(texts)
    return both.select("path", F.octet_length("content").alias("length"), "content")


FILES = "files AS (SELECT url AS path, html AS body FROM pages UNION ALL SELECT 'doc/' || doc_id || '.txt', text FROM documents)"


@query("src9_inventory", f"WITH {FILES} SELECT path, strlen(body) AS length, sha256(body) AS sha256 FROM files")
def _(t: Tables):
    return files.inventory(_as_files(t))


@query("src9_inventory_of_files", "SELECT count(*) AS same FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def _(t: Tables):
    path = _out(t, "inventory")
    t.orders.select("o_orderstatus", "o_orderkey").repartition("o_orderstatus").write.partitionBy("o_orderstatus").csv(path)
    first = files.inventory(files.read(t.spark, path, "*.csv"))
    again = files.inventory(files.read(t.spark, path, "*.csv"))
    return first.join(again, ["path", "length", "sha256"]).agg(F.count(F.lit(1)).alias("same"))


def _typed_files(t: Tables):
    """Orders as small files of six kinds, some with the wrong extension."""
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 7
    table = lambda sep: F.concat(F.lit(f"a{sep}b\n"), key, F.lit(sep), "o_orderstatus", F.lit("\n"))
    magic = lambda code: F.concat(F.unhex(F.lit(code)), F.encode(key, "UTF-8"))
    content = (
        F.when(kind == 0, F.encode(F.concat(F.lit('{"id": '), key, F.lit("}")), "UTF-8"))
        .when(kind == 1, F.encode(table(","), "UTF-8"))
        .when(kind == 2, F.encode(table("\t"), "UTF-8"))
        .when(kind == 3, magic("255044462D"))
        .when(kind == 4, magic("89504E470D0A1A0A"))
        .when(kind == 5, magic("FFD8FF"))
        .otherwise(F.encode(F.concat(F.lit("plain "), key), "UTF-8"))
    )
    right = F.element_at(F.array(*[F.lit(e) for e in (".json", ".csv", ".tsv", ".pdf", ".PNG", ".jpeg", ".txt")]), (kind + 1).cast("int"))
    wrong = F.col("o_orderpriority") == "1-URGENT"
    path = F.concat(F.lit("f/"), key, F.when(wrong, F.lit(".webp")).otherwise(right))
    return t.orders.select(path.alias("path"), F.octet_length(content).alias("length"), content.alias("content"))


@query("src10_signature", "SELECT o_orderpriority <> '1-URGENT' AS matches, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    return files.check_signature(_typed_files(t)).groupBy("matches").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src10_formats",
    """SELECT ['.csv+.txt', '.tsv+.txt', '.pdf+.txt', '.png', '.jpeg+.jpg', '.txt', '.json+.txt'][CAST((o_orderkey + 6) % 7 AS INTEGER) + 1] AS formats, count(*) AS n
  FROM orders GROUP BY 1""",
)
def _(t: Tables):
    # Latin-1 text is text too, so JPEG and PDF magic bytes decode to printable characters.
    found = files.with_formats(_typed_files(t))
    named = F.array_join(F.array_sort(F.filter("formats", lambda e: ~((e == ".txt") & F.array_contains("formats", ".jpg")))), "+")
    return found.groupBy(named.alias("formats")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src11_guard",
    f"""WITH {FILES} SELECT CASE WHEN NOT ends_with(lower(path), '.txt') THEN 'unsupported_extension' WHEN strlen(body) > 5000 THEN 'too_large' END AS reason,
  count(*) AS n FROM files GROUP BY 1""",
)
def _(t: Tables):
    return files.guard(_as_files(t), 5000).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src12_header_only",
    "SELECT unnest(['s_suppkey', 's_name', 's_nationkey']) AS name, unnest([1, 2, 3]) AS place, (SELECT count(*) FROM supplier) AS rows",
)
def _(t: Tables):
    path = _out(t, "header")
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    found = readers.header(t.spark, path)
    rows = [(i + 1, c) for i, c in enumerate(found)]
    total = t.supplier.agg(F.count(F.lit(1))).scalar()
    return t.spark.createDataFrame(rows, "place int, name string").withColumn("rows", total)


@query("src13_parquet", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


# --- sinks --------------------------------------------------------------------------------------


@query("snk1_csv", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type, props FROM events")
def _(t: Tables):
    path = sinks.write_csv(t.events.select("event_id", "ts", "event_type", "props"), _out(t, "sink"), "events.csv")
    return readers.csv(t.spark, path, schema="event_id bigint, ts string, event_type string, props string")


@query("snk2_json", "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, 'Orders' AS title FROM orders")
def _(t: Tables):
    path = sinks.write_json(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), _out(t, "sink"), "orders.json", "Orders")
    title = t.spark.read.schema("title string").json(f"{path}/metadata")
    data = t.spark.read.schema("o_orderkey bigint, o_orderstatus string, o_orderdate string").json(f"{path}/data")
    return data.withColumn("title", title.scalar())


TEXT = """w AS (SELECT greatest(max(length(CAST(c_custkey AS VARCHAR))), 9) AS w0, greatest(max(length(c_name)), 6) AS w1, greatest(max(length(c_mktsegment)), 12) AS w2 FROM customer)
  SELECT 1::BIGINT AS line_number, 'Customers' AS line UNION ALL SELECT 2, '=========' UNION ALL SELECT 3, ''
  UNION ALL SELECT 4, lpad('c_custkey', w0::INTEGER, ' ') || ' ' || lpad('c_name', w1::INTEGER, ' ') || ' ' || lpad('c_mktsegment', w2::INTEGER, ' ') FROM w
  UNION ALL SELECT 4 + row_number() OVER (ORDER BY c_custkey),
   lpad(CAST(c_custkey AS VARCHAR), w0::INTEGER, ' ') || ' ' || lpad(c_name, w1::INTEGER, ' ') || ' ' || lpad(c_mktsegment, w2::INTEGER, ' ') FROM customer, w"""


@query("snk3_text", f"WITH {TEXT}")
def _(t: Tables):
    return sinks.text_report(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], "Customers")


@query("snk3_text_file", f"WITH r AS (WITH {TEXT}) SELECT line, count(*) AS n FROM r GROUP BY 1")
def _(t: Tables):
    df = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    path = sinks.write_text(df, _out(t, "sink"), "customers.txt", ["c_custkey"], "Customers")
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


BUNDLE = [
    {"type": "filter_prep", "steps": ["trim_whitespace", "categorical_value_normalization"]},
    {"type": "filter", "conditions": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}]},
]


@query(
    "snk4_bundle",
    """SELECT 'cleaned_data' AS part, count(*) AS n FROM orders UNION ALL SELECT 'filtered_data', count(*) FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'audit_log', 2 UNION ALL SELECT 'warnings', 1 UNION ALL SELECT 'column_mapping', 0""",
)
def _(t: Tables):
    cleaned = apply_ops(t.orders, BUNDLE[:1], audit=False).df
    result = apply_ops(t.orders, BUNDLE)
    paths = sinks.write_bundle(_out(t, "sink"), "bundle", cleaned, result.df, result.entries(), ["one warning"], [])
    parts = [
        t.spark.read.parquet(path).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")) for part, path in paths.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "snk5_audit_shape",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'internal_preparation' ELSE 'user_requested' END AS step_kind, event_type AS operation_type,
  '["' || event_type || '","x"]' AS input_columns FROM events""",
)
def _(t: Tables):
    origin = F.when(F.col("event_type") == "error", F.lit("filter_prep"))
    audit = t.events.select(
        "event_id", F.col("event_type").alias("operation_type"), origin.alias("origin"), F.array("event_type", F.lit("x")).alias("input_columns")
    )
    return sinks.shape_audit(audit).drop("origin")


_PAYLOAD = """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS record_index,
  '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload FROM orders"""


def _payloads(t: Tables):
    df = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    out = sinks.payload_table(df, "o_custkey", ["o_orderdate", "o_orderkey"])
    kept = F.to_json(F.from_json("payload", "o_orderkey bigint, o_orderstatus string"))
    return out.withColumn("payload", kept)


@query("snk6_payload_table", _PAYLOAD)
def _(t: Tables):
    return _payloads(t)


@query(
    "snk6_replace_keys",
    """SELECT o_custkey, count(*) AS n, max(record_index) AS last_index FROM (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS record_index FROM orders
  LEFT JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' OR o_orderstatus = 'F') GROUP BY 1""",
)
def _(t: Tables):
    path = _out(t, "row-store")
    df = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    sinks.replace_keys(df, path, "o_custkey", ["o_orderkey"], 16)
    building = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    fewer = df.filter("o_orderstatus = 'F'").join(building, "o_custkey", "left_semi")
    sinks.replace_keys(fewer, path, "o_custkey", ["o_orderkey"], 16, of_keys=building)
    return sinks.stored_rows(t.spark, path).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("record_index").alias("last_index"))


@query("snk6_emptied_buckets", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority >= '3' GROUP BY 1")
def _(t: Tables):
    """Few keys in many buckets, so that the buckets of the removed keys go empty."""
    path, df = _out(t, "row-store"), t.orders.select("o_orderpriority", "o_orderkey")
    sinks.replace_keys(df, path, "o_orderpriority", ["o_orderkey"], 64)
    gone = df.filter("o_orderpriority < '3'").select("o_orderpriority")
    sinks.replace_keys(df.filter("o_orderkey is null"), path, "o_orderpriority", ["o_orderkey"], 64, of_keys=gone)
    return sinks.stored_rows(t.spark, path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("snk7_rebuild", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t: Tables):
    return jsons.typed_rows(_payloads(t), "payload", "o_orderkey bigint, o_orderstatus string", ["o_custkey", "record_index"])


@query("snk8_safe_output", "SELECT count(*) AS n, 4 AS refused FROM nation")
def _(t: Tables):
    refused = 0
    for name in ("../evil", "a/b", "..", ""):
        try:
            files.safe_output("/data", name)
        except PlanError:
            refused += 1
    path = sinks.write_csv(t.nation, _out(t, "sink"), "nation.csv")
    return readers.csv(t.spark, path).agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))
