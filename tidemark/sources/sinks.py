"""Writers: CSV, JSON and text reports, the audit bundle, and the keyed row store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, names
from tidemark.operators import ordered
from tidemark.session import materialize, path_exists
from tidemark.sources.files import safe_output

# Columns of empty bundle parts.
AUDIT_COLUMNS = (
    "step_kind", "operation_id", "operation_type", "summary", "input_row_count",
    "output_row_count", "started_at", "finished_at", "duration_ms",
)
MAPPING_COLUMNS = ("requested_field", "matched_column", "semantic_type", "confidence", "reason")


def _texts(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, nested values as JSON text: what text formats can hold."""
    out = {}
    for f in df.schema.fields:
        if names.is_dated(f.dataType):
            out[f.name] = dates.iso_text(names.col(f.name))
        elif f.dataType.typeName() in ("array", "map", "struct"):
            out[f.name] = F.to_json(names.col(f.name))
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, base: str, name: str) -> str:
    path = safe_output(base, name)
    _texts(df).write.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, base: str, name: str, title: str | None = None) -> str:
    """Rows as JSON lines under ``data`` and one metadata row with the title under ``metadata``."""
    path = safe_output(base, name)
    _texts(df).write.option("ignoreNullFields", False).json(f"{path}/data")
    meta = df.sparkSession.createDataFrame([(title or "Report",)], "title string")
    meta.coalesce(1).write.json(f"{path}/metadata")
    return path


def text_report(df: DataFrame, order_by: list[str], title: str | None = None) -> DataFrame:
    """Fixed-width lines ``line_number, line``: title and underline, header, then the rows, every
    column right-aligned to its longest value. One aggregate finds the widths."""
    spark, shown = df.sparkSession, _shown(df)
    widest = [F.max(F.length(c)) for c in shown.values()]
    widths = df.agg(
        *[F.greatest(F.coalesce(w, F.lit(0)), F.lit(len(n))).alias(f"w{i}") for i, (n, w) in enumerate(zip(shown, widest))]
    )

    def aligned(cells: list[Column]) -> Column:
        return F.concat_ws(" ", *[F.lpad(c, widths.select(f"w{i}").scalar(), F.lit(" ")) for i, c in enumerate(cells)])

    top = [title, "=" * len(title), ""] if title else []
    header = spark.range(1).select(
        F.lit(len(top) + 1).cast("bigint").alias("line_number"), aligned([F.lit(n) for n in shown]).alias("line")
    )
    at = F.struct(*[names.col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    lines = df.select(at.alias("at"), aligned(list(shown.values())).alias("line"))
    body = ordered.row_index(lines, [], ["at"], "n").select(
        (F.col("n") + len(top) + 1).alias("line_number"), "line"
    )
    if top:
        titled = spark.createDataFrame(list(enumerate(top, 1)), "line_number bigint, line string")
        header = titled.unionByName(header)
    return header.unionByName(body)


def _shown(df: DataFrame) -> dict[str, Column]:
    """Every column as text, null as empty."""
    shown = {}
    for f in df.schema.fields:
        c = names.col(f.name)
        if names.is_dated(f.dataType):
            c = dates.iso_text(c)
        elif f.dataType.typeName() in ("array", "map", "struct"):
            c = F.to_json(c)
        shown[f.name] = F.coalesce(c.cast("string"), F.lit(""))
    return shown


def write_text(df: DataFrame, base: str, name: str, order_by: list[str], title: str | None = None) -> str:
    """The text report as files that hold the lines in order."""
    path = safe_output(base, name)
    lines = text_report(df, order_by, title)
    lines.repartitionByRange("line_number").sortWithinPartitions("line_number").select("line").write.text(path)
    return path


# --- audit bundle -------------------------------------------------------------------------------


def audit_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Audit entries as a table of texts: ``step_kind`` first, then all keys in first-seen order;
    nested values as JSON. Entries stamped by the preparation are internal, others user-requested."""
    if not entries:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in AUDIT_COLUMNS))
    keys = list(dict.fromkeys(k for e in entries for k in e if k != "step_kind"))
    rows = []
    for e in entries:
        marked = str(e.get("origin", "")).lower() == "filter_prep" or {"origin": "filter_prep"} in [
            v for v in e.values() if isinstance(v, dict)
        ]
        kind = "internal_preparation" if marked else "user_requested"
        rows.append((kind, *[_cell(e.get(k)) for k in keys]))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["step_kind", *keys]))


def _cell(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (bool, int, float)):
        return str(value)
    return json.dumps(value, default=str, ensure_ascii=False)


def shape_audit(audit: DataFrame) -> DataFrame:
    """The same for an audit table: ``step_kind`` from its ``origin``, nested columns as JSON text."""
    kind = F.when(F.lower("origin") == "filter_prep", "internal_preparation").otherwise("user_requested")
    rest = [c for c in audit.columns if c != "step_kind"]
    return _texts(audit).select(kind.alias("step_kind"), *[names.col(c) for c in rest])


def write_bundle(
    base: str, name: str, cleaned: DataFrame, filtered: DataFrame | None = None, audit: list[dict] | None = None,
    warnings: list[str] | None = None, mapping: list[dict] | None = None, fmt: str = "parquet",
) -> dict[str, str]:
    """Five named outputs in one folder; ``filtered_data`` only when a filter ran, empty ones with
    their columns."""
    path, spark = safe_output(base, name), cleaned.sparkSession
    parts = {"cleaned_data": cleaned}
    if filtered is not None:
        parts["filtered_data"] = filtered
    parts["audit_log"] = audit_rows(spark, audit or [])
    parts["warnings"] = spark.createDataFrame([(str(w),) for w in warnings or []], "warning string")
    rows = [tuple(_cell(m.get(c)) for c in MAPPING_COLUMNS) for m in mapping or []]
    parts["column_mapping"] = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in MAPPING_COLUMNS))
    for part, df in parts.items():
        out = _texts(df) if fmt == "csv" else df
        out.write.format(fmt).option("header", True).option("escape", '"').save(f"{path}/{part}")
    return {part: f"{path}/{part}" for part in parts}


# --- row store ----------------------------------------------------------------------------------


def payload_table(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """``key, record_index, payload``: rows of each key numbered from 1, the row as JSON."""
    data = [c for c in df.columns if c != key]
    indexed = ordered.row_index(df, [key], order_by)
    return indexed.select(
        F.col("`" + key.replace("`", "``") + "`"), "record_index",
        F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in data])).alias("payload"),
    )


def replace_keys(
    df: DataFrame, path: str, key: str, order_by: list[str], buckets: int = 256, of_keys: DataFrame | None = None
) -> None:
    """Replace all stored rows of the keys in ``df`` and of those in ``of_keys``, which may have no rows
    any more.

    Keys are spread over a fixed number of buckets, one folder each, and only the folders of touched
    keys are rewritten: many small keys do not become many small files, and untouched buckets stay.
    Each touched bucket also gets one marker without payload, so a bucket that loses its last key is
    rewritten like any other; ``stored_rows`` leaves the markers out. A key with very many rows is
    written by several tasks, a million rows each. Null is a key like others.
    """
    spark = df.sparkSession
    name = F.col("`" + key.replace("`", "``") + "`")
    bucket = F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket")
    new = payload_table(df, key, order_by).select("*", bucket)
    out = new
    if path_exists(spark, path):
        gone = (df if of_keys is None else df.select(name).union(of_keys.select(name)))
        gone = gone.select(name.cast(df.schema[key].dataType).alias("__gone")).distinct()
        touched = gone.select(F.pmod(F.xxhash64("__gone"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
        stored = spark.read.parquet(path).filter("payload is not null").join(F.broadcast(touched), "bucket", "left_semi")
        kept = stored.join(gone, name.eqNullSafe(F.col("__gone")), "left_anti")
        markers = touched.select(
            F.lit(None).cast(df.schema[key].dataType).alias(key), F.lit(0).cast("bigint").alias("record_index"),
            F.lit(None).cast("string").alias("payload"), "bucket",
        )
        out = materialize(new.unionByName(kept.select(*new.columns)).unionByName(markers), "row-store")
    (
        out.repartition("bucket", F.floor(F.col("record_index") / 1_000_000)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(path)
    )


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a row store: ``key, record_index, payload``."""
    return spark.read.parquet(path).filter("payload is not null").drop("bucket")
