"""Records of one large document, read by many tasks: JSON arrays and CSV with quoted line breaks.

A file is cut at a character at which a record may end, wherever the splits of the file lie. Whether a
record does end there depends on the quotes and brackets before it. So every split is summarised for each
state it may start in, the summaries of a file's splits are composed in order, and a second scan, which
knows its true start, gives the records. Only records that cross splits are moved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, scratch_path

#: What a fragment does: the parity of its quotes, and its brackets opened less closed if it starts outside and
#: if it starts inside a text.
Measure = Callable[[str], tuple[int, int, int]]

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_TEXT = re.compile(r'"[^"]*(?:"|$)')
_REST = re.compile(r'^[^"]*(?:"|$)')


def json_measure(fragment: str) -> tuple[int, int, int]:
    """Of a piece of JSON before a ``}``, which counts as closed where it is not inside a text."""
    plain = _ESCAPED.sub("", fragment) if "\\" in fragment else fragment
    parity = plain.count('"') & 1
    outside, inside = _TEXT.sub("", plain), _TEXT.sub("", _REST.sub("", plain))
    return parity, outside.count("{") - (1 - parity), inside.count("{") - parity


def csv_measure(fragment: str) -> tuple[int, int, int]:
    """Of a line: quotes inside a value are doubled, so only their parity counts."""
    return fragment.count('"') & 1, 0, 0


def _fragments(spark: SparkSession, path, end: str) -> DataFrame:
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", end).text(path).select(*meta, F.col("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """((path, block), rows) pieces in the order of the scan, 1,000 rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            columns = [c.to_pylist() for c in whole.slice(at, 1000).columns]
            start, names = 0, list(zip(columns[0], columns[1]))
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[start]:
                    yield names[start], [c[start:k] for c in columns[2:]]
                    start = k


def _starts(fragments: DataFrame, measure: Measure) -> DataFrame:
    """(path, block, inside, depth): the true state at the start of every split; one row a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list[int]] = {}
        for name, (values,) in _runs(batches):
            state = totals.setdefault(name, [0, 0, 0])
            for v in values:
                parity, outside, inside = measure(v)
                one, two = (inside, outside) if state[0] else (outside, inside)
                state[0], state[1], state[2] = state[0] ^ parity, state[1] + one, state[2] + two
        rows = [(*name, *state) for name, state in totals.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), *[pa.int64()] * 4])],
            names=["path", "block", "parity", "outside", "inside"])

    sums = fragments.mapInArrow(run, "path string, block long, parity long, outside long, inside long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("parity").over(before), F.lit(0)), F.lit(2))
    known = sums.select("path", "block", inside.alias("start"), F.when(inside == 1, F.col("inside")).otherwise(F.col("outside")).alias("delta"))
    return known.select("path", "block", "start", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"))


def _records(spark: SparkSession, path, end: str, measure: Measure, finish: Callable[[str, bool], str | None]) -> DataFrame:
    """(record) of all files. ``finish`` turns the text of a record, and whether it is its file's first, into what
    is kept of it, or None."""
    fragments = _fragments(spark, path, end)
    starts = _starts(fragments, measure)
    #: A record inside a split is done at once; pieces at the ends of a split wait for their neighbours.
    DONE, LAST, OPEN = 0, 1, 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, held, inside, depth, ended, number = None, [], 0, 0, False, 0

        def close() -> None:
            if held:
                out.append((*at, number, OPEN, end.join(held) + end))

        for name, (values, first, level) in _runs(batches):
            if name != at:
                if at is not None:
                    close()
                at, held, inside, depth, ended, number = name, [], first[0], level[0], False, 0
            for v in values:
                parity, outside, within = measure(v)
                depth += within if inside else outside
                inside ^= parity
                held.append(v)
                if not inside and depth == 0:
                    text = end.join(held)
                    whole = ended or at[1] == 0
                    done = finish(text, at[1] == 0 and not ended) if whole else text
                    if done is not None:
                        out.append((*at, number, DONE if whole else LAST, done))
                    held, ended, number = [], True, number + 1
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if at is not None:
            close()
        yield _batch(out)

    pieces = fragments.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "value", "start", "depth")
    pieces = pieces.mapInArrow(run, "path string, block long, number long, kind int, record string")
    # Not partitioned by kind, which would sort all records of a split; the few that cross are found by statistics.
    stored = materialize(pieces, "records")
    # At most two pieces a split: what runs out of it, and what ends in it.
    before = Window.partitionBy("path").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    crossing = stored.where(F.col("kind") > DONE).withColumn("group", F.coalesce(F.sum(F.when(F.col("kind") == LAST, 1).otherwise(0)).over(before), F.lit(0)))
    joined = crossing.groupBy("path", "group").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "record"))).alias("parts"), F.max((F.col("kind") == LAST).cast("int")).alias("ends"))
    whole = joined.select("ends", F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("record"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [finish(r if e else r[: -len(end)], False) for e, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r for r in kept if r is not None], pa.string())], names=["record"])

    return stored.where(F.col("kind") == DONE).select("record").unionByName(whole.mapInArrow(finished, "record string"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "block", "number", "kind", "record"])


def _object(text: str, first: bool) -> str | None:
    start = text.find("{")
    return None if start < 0 else re.sub(r"[\r\n]", " ", text[start:]) + "}"


def json_array(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """The objects of documents that are lists of objects, or single objects, one row each.

    Every file is read by as many tasks as it has splits. Braces and quotes inside texts are no structure.
    Values of a list that are no objects are left out. Without a schema it is inferred from the records, which
    takes one more scan of them.
    """
    records = _records(spark, path, "}", json_measure, _object)
    if schema is not None:
        kind = schema if isinstance(schema, str) else schema.toDDL()
        return records.select(F.from_json("record", kind).alias("r")).select("r.*")
    lines = scratch_path(spark, "json-lines")
    records.write.text(lines)
    return spark.read.json(lines)


def csv_records(spark: SparkSession, path, schema: T.StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    """Rows of CSV whose quoted values may hold line breaks, each file read by as many tasks as it has splits.

    Quotes inside a value are doubled. Columns go by their place. Empty lines are left out.
    """

    def line(text: str, first: bool) -> str | None:
        text = text.removesuffix("\r")
        return None if not text or (header and first) else text

    kind = schema if isinstance(schema, str) else schema.toDDL()
    records = _records(spark, path, "\n", csv_measure, line)
    options = {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"}
    return records.select(F.from_csv("record", kind, options).alias("r")).select("r.*")
