"""Readers for delimited, JSON and text files, and combining of extracted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import names, text
from tidemark.operators import columns, ordered
from tidemark.sources import splittable as splittable_files


def delimited(
    spark: SparkSession, path, sep: str = ",", schema: T.StructType | str | None = None, headers: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV or other delimited files with a header row. Give a schema for large inputs: inferring the
    types reads the files once more. ``headers`` is None, ``source`` or ``ledger`` normalization;
    with it, rows without any value are dropped too. Quotes inside a value are doubled. Values with
    line breaks need ``multiline``; with a schema such files are read by all their splits, without one
    every file is one task's work."""
    if multiline and schema is not None:
        return _named(splittable_files.csv_records(spark, path, schema, sep), headers)
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multiline)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return _named(df, headers)


def _named(df: DataFrame, headers: str | None) -> DataFrame:
    if headers is None:
        return df
    named = columns.normalize_headers(df, ledger=headers == "ledger")
    return named.filter(columns.has_value(named, named.columns, "all"))


def csv(spark: SparkSession, path, **options) -> DataFrame:
    return delimited(spark, path, ",", **options)


def tsv(spark: SparkSession, path, **options) -> DataFrame:
    return delimited(spark, path, "\t", **options)


def header(spark: SparkSession, path, sep: str = ",") -> list[str]:
    """Column names without reading data beyond the first line."""
    return spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path).columns


def json_rows(
    spark: SparkSession, path, schema: T.StructType | str | None = None, lines: bool = False, splittable: bool = False,
) -> DataFrame:
    """Rows of JSON documents: a list of objects, one flat object, or an object whose first list of
    objects holds the rows.

    One file is one document, read by one task; with ``lines`` every line is one, and files are
    split. With ``splittable`` files that are a list of objects, or one flat object, are read by all
    their splits.
    """
    if splittable:
        return splittable_files.json_array(spark, path, schema)
    reader = spark.read.option("multiLine", not lines)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    for f in _in_document_order(df, spark, path, schema, lines):
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return df.select(F.inline(names.col(f.name)))
    return df


def _in_document_order(df: DataFrame, spark: SparkSession, path, schema, lines: bool) -> list[T.StructField]:
    """The fields in the order the documents have them. Inference sorts the names, so the first list
    is looked up in one document when there is a choice; the places of the names are all that leaves it."""
    lists = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if schema or len(lists) < 2:
        return df.schema.fields
    places = [F.locate(f'"{f.name}"', F.col("value")) for f in df.schema.fields]
    found = spark.read.text(path, wholetext=not lines).limit(1).select(*places).first()
    return [f for _, f in sorted(zip(found, df.schema.fields), key=lambda x: x[0])]


def json_lines(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per line; splittable."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def text_lines(spark: SparkSession, path) -> DataFrame:
    """Non-blank lines as ``path, line_number, raw_text``, stripped and numbered from 1 per file.

    Lines are read split by split. Their order in a file is the split's offset and then the order
    inside the split, and the numbering runs over any number of splits.
    """
    lines = spark.read.text(path).select(
        "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"),
        text.strip(F.col("value")).alias("raw_text"),
    )
    kept = lines.filter("raw_text <> ''")
    numbered = ordered.row_index(kept, ["file_path"], ["file_block_start", "at"], "line_number")
    return numbered.select(F.col("file_path").alias("path"), "line_number", "raw_text")


def preview(df: DataFrame, n: int = 50, order_by: list | None = None) -> DataFrame:
    """The first ``n`` rows with the true number of all rows in ``total_rows``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order_by) if order_by else df
    return rows.limit(n).withColumn("total_rows", total)


def combine(tables: list[DataFrame]) -> DataFrame:
    """Extracted tables as one: normalized names, aligned by name, unnamed columns and empty rows
    dropped."""
    from tidemark.operators.tables import concat

    named = []
    for t in tables:
        kept = t.select(*[names.col(c) for c in t.columns if c.strip()])
        named.append(kept.toDF(*names.unique_names([names.source_name(c) for c in kept.columns])))
    return concat(named)


def telemetry(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """Log entries, one JSON object per line."""
    return json_lines(spark, path, schema)
