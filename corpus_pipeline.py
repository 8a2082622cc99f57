"""A corpus from raw documents to pieces: quality rules, near duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, folder) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them for the next one, so a
lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_rules, merge_dropout, mixing, pii, simhash
from tidemark.session import materialize


def sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many documents of their source share."""
    return sized(line_rules.cleaned(docs))


def dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest id."""
    return simhash.deduplicated(docs)


def privacy(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with the name of its kind in place of each piece of personal data."""
    return sized(pii.masked(docs))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them (three times at most).

    Equal rows are one document of the mix that counts several times.
    """
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text", "source"))
    taken = mixing.mix(keyed, id="__row").where("taken > 0")
    times = taken.groupBy("__row").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    once = keyed.dropDuplicates(["__row"]).join(times, "__row")
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with their pieces, a digest of the decoded text and whether it is the text."""
    return merge_dropout.encoded(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", dedup),
    ("personal_data", privacy),
    ("source_mix", mixture),
    ("merge_dropout", encoding),
]

#: Hash orders, expectation-maximisation and merges are beyond SQL; tests compare with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
