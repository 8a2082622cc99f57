"""Helpers shared by the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_path

__all__ = ["materialize", "Scratch", "words", "lower_ascii", "WHITE", "documents", "crc_mod", "split_runs"]

#: The white space between words (space and U+0009 to U+000D) and the pattern of a word.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """All words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as the text ``null``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null"))) % modulus


def crc_mod_py(value, modulus: int) -> int:
    return zlib.crc32(("null" if value is None else str(value)).encode()) % modulus


def split_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` from batches sorted by it: a run that reaches the end of a
    batch waits for the next one, so only one batch and one run are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


class Scratch:
    """Tables stored in the shared folder on the way to a result, deleted together once that is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all tables, or all but the first ``keep``."""
        for path in self.paths[keep:]:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del self.paths[keep:]
