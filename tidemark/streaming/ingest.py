"""Ingest of event streams: ids, replays, late events, and running a stream into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.functions import jsons
from tidemark.session import scratch_path


def event_id(given: Column, subject: Column, payload: Column) -> Column:
    """The id an event carries or, failing that, one derived from its subject and payload map."""
    derived = F.concat(F.lit("callback:"), subject.cast("string"), F.lit(":"), jsons.stable_hash(payload))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), derived)


def once(events: DataFrame, key: str) -> DataFrame:
    """Every event once: an id that came before is ignored, however long ago. The ids are kept in the state
    store on disk, whose Bloom filters answer for new ids without reading; memory stays bounded."""
    return events.dropDuplicates([key])


def once_within(events: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """Every event once, with the ids of the allowed lateness kept only: replays older than that are dropped as
    late events, and counted, but so is a new event that comes too late."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def read_parquet(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over Parquet files with the schema they have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


#: State on local disk, with its changes written to the checkpoint after each micro-batch.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start(writer: DataStreamWriter, path: str | None = None, settings: dict[str, str] | None = None) -> StreamingQuery:
    """Start a writer with the state store of this library; the session's own settings stay as they are."""
    conf, settings = SparkSession.active().conf, STATE_STORE | (settings or {})
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return writer.start(path) if path else writer.start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def run(writer: DataStreamWriter, path: str | None = None, settings: dict[str, str] | None = None) -> StreamingQuery:
    """Start a writer on the data available now and wait for its end."""
    query = start(writer.trigger(availableNow=True), path, settings)
    query.awaitTermination()
    return query


def to_table(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an append stream into Parquet (exactly once, by its checkpoint) and return the table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
    run(stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint), path)
    return spark.read.schema(stream.schema).parquet(path)


def dropped_late(query: StreamingQuery) -> int:
    """Rows the stateful operators of a query dropped because they came after the watermark."""
    return sum(
        int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"]
    )
