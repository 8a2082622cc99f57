"""Keyed state inside a running stream, and the tables read back from its state store.

State lives in the stream's checkpoint, a key with its state in one partition. Reading it touches the
newest state version only, however many micro-batches there were; a restart goes on from it.

A call into the state store costs far more than a row. Where a micro-batch changes very many keys, these are
dealt by a hash to packs, whose keys are read, changed as columns, and written at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import jsons
from tidemark.session import scratch_path
from tidemark.streaming.ingest import run


def _stored(spark: SparkSession, checkpoint: str, state: str) -> DataFrame:
    """One state variable as a table, as of the last finished micro-batch."""
    return spark.read.format("statestore").option("stateVarName", state).load(checkpoint)


def _keep_state(stream: DataFrame, checkpoint: str) -> None:
    """Run a stream for its state alone. Batches without data would do nothing, but never end where state has
    a time to live."""
    writer = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    run(writer, settings={"spark.sql.streaming.noDataMicroBatches.enabled": "false"})


#: Packs that keys are dealt to.
PACKS = 2048


def _pack_of(key: str, packs: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(packs)).alias("pack")


def _packed(frame: pd.DataFrame) -> bytes:
    """The keys of a pack as Arrow data."""
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


# --- the newest row per key ---------------------------------------------------------------------


class NewestRow(StatefulProcessor):
    """Keeps the row with the greatest (``at``, ``seq``) of a key; of equal ones the first to come."""

    def __init__(self, fields: T.StructType):
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.row.get()
        best = before
        for r in rows:
            if best is None or (r["__at"], r["__seq"]) > (best[0], best[1]):
                best = tuple(r[f.name] for f in self.fields)
        if best is not before:
            self.row.update(best)
        yield from ()

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, keys: list[str], at: str, seq: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream and return the newest row of every key: one row per key, inserted or refreshed.

    ``at`` is a timestamp, ``seq`` a whole number that decides between rows of one time. Rows without a time
    are left out. With a ``checkpoint`` the stream goes on from where it stopped.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "newest")
    rest = [f for f in stream.schema.fields if f.name not in keys]
    # Times travel as microseconds, so no zone of a worker matters.
    clock = lambda f: isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    sent = [(F.unix_micros(F.col(f.name).cast("timestamp")) if clock(f) else F.col(f.name)).alias(f.name) for f in rest]
    payload = T.StructType([T.StructField(f.name, T.LongType() if clock(f) else f.dataType) for f in rest])
    slim = stream.where(F.col(at).isNotNull()).select(
        *keys, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), F.coalesce(F.col(seq).cast("long"), F.lit(-1)).alias("__seq"), *sent,
    )
    fields = T.StructType([T.StructField("__at", T.LongType()), T.StructField("__seq", T.LongType()), *payload.fields])
    kept = slim.groupBy(*keys).transformWithState(NewestRow(fields), outputStructType="n long", outputMode="Update", timeMode="None")
    _keep_state(kept, checkpoint)
    back = lambda f: F.timestamp_micros(F.col(f"value.`{f.name}`")).cast(f.dataType) if clock(f) else F.col(f"value.`{f.name}`")
    return _stored(spark, checkpoint, "row").select(*(F.col(f"key.`{k}`").alias(k) for k in keys), *(back(f).alias(f.name) for f in rest))


# --- latest fields per job ----------------------------------------------------------------------


class LatestFields(StatefulProcessor):
    """A map from field to its newest value and when that came."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "value string, at long, seq long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        for r in rows:
            for field, value in dict(r.changes).items():  # a map comes as its entries
                if field not in newest or (r.at, r.seq) > newest[field][1:]:
                    newest[field] = (value, r.at, r.seq)
        for field, entry in newest.items():
            held = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
            if held is None or entry[1:] > (held[1], held[2]):
                self.fields.updateValue((field,), entry)
        yield from ()

    def close(self) -> None:
        pass


def latest_fields(
    stream: DataFrame, key: str, at: str, seq: str, status: Column, payload: Column, checkpoint: str | None = None, ttl_ms: int | None = None,
) -> DataFrame:
    """Run a stream of events and return (key, state): the newest value of each field of each job, and its
    status, as a map. Protected fields of a payload change nothing.

    A field's newest event decides, so late and replayed events do no harm. Only changed fields are written.
    Fields that no event has set for ``ttl_ms`` of processing time are forgotten; without it none is, and the map
    of a job has as many entries as its payloads have keys.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "fields")
    fields = F.map_filter(F.coalesce(payload, F.create_map().cast("map<string,string>")), lambda k, _v: ~k.isin("status", *jsons.PROTECTED_KEYS))
    slim = stream.where(F.col(at).isNotNull()).select(
        F.col(key).alias(key), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.coalesce(F.col(seq).cast("long"), F.lit(-1)).alias("seq"),
        F.map_concat(fields, F.create_map(F.lit("status"), status)).alias("changes"),
    )
    kept = slim.groupBy(key).transformWithState(
        LatestFields(ttl_ms), outputStructType="n long", outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None"
    )
    _keep_state(kept, checkpoint)
    stored = _stored(spark, checkpoint, "fields")
    value = F.col("user_map_value.value.value") if ttl_ms else F.col("user_map_value.value")
    entry = F.struct(F.col("user_map_key.field").alias("key"), value.alias("value"))
    return stored.groupBy(F.col(f"key.`{key}`").alias(key)).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("state"))


def merged_state(state: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """New state over stored summaries (``key, summary`` map); protected fields keep the stored value."""
    both = stored.join(state, key, "full")
    return both.select(key, jsons.merge_protected(F.col("summary"), F.col("state")).alias("summary"))


# --- session timeout ----------------------------------------------------------------------------

#: Fixed value: the reason given for an expired session.
EXPIRED = "Clarification session timed out"


class Timeout(StatefulProcessor):
    """A session that a timer ends: the outcome is given when the watermark passes the deadline."""

    def __init__(self, minutes: int, forget_minutes: int):
        self.span, self.forget = minutes * 60_000_000, forget_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "opened long, answered long, ended boolean")

    def _deadline(self, opened: int) -> int:
        """In milliseconds, never early."""
        return -(-(opened + self.span) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.session.get()
        opened, answered, ended = held if held is not None else (None, None, False)
        if ended:
            return
        timer = self._deadline(opened) if opened is not None else None
        for r in rows:
            opened = r.us if opened is None else min(opened, r.us)
            if r.answer:
                answered = r.us if answered is None else min(answered, r.us)
        if opened is None:
            return
        self.session.update((opened, answered, False))
        if timer != self._deadline(opened):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._deadline(opened))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        opened, answered, ended = self.session.get()
        if ended:
            self.session.clear()
            return
        deadline = opened + self.span
        resolved = answered is not None and answered <= deadline
        forgotten = self._deadline(opened) + self.forget
        if forgotten > timerValues.getCurrentWatermarkInMs():
            self.session.update((opened, answered, True))
            self.handle.registerTimer(forgotten)
        else:
            self.session.clear()
        yield Row(session_id=key[0], opened=opened, ended=answered if resolved else deadline, resolved=resolved)

    def close(self) -> None:
        pass


#: The time of an answer that was not given.
NEVER = np.iinfo(np.int64).max


class TimeoutPack(StatefulProcessor):
    """The sessions of a pack, which end as those of ``Timeout`` do. Its one timer is for the first that is due."""

    def __init__(self, minutes: int, forget_minutes: int):
        self.span, self.forget = minutes * 60_000_000, forget_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pack = handle.getValueState("pack", "timer long, sessions binary")

    def _due(self, sessions: pd.DataFrame) -> pd.Series:
        """When a session ends or, ended, is forgotten: in milliseconds, never early."""
        return -(-(sessions["opened"] + self.span) // 1000) + sessions["ended"] * self.forget

    @staticmethod
    def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        out = pd.concat(parts, ignore_index=True).groupby("session_id", dropna=False, sort=False, as_index=False)
        out = out.agg(opened=("opened", "min"), answered=("answered", "min"))
        return out.assign(session_id=out["session_id"].astype(object).where(out["session_id"].notna(), None))

    def _keep(self, sessions: pd.DataFrame, timer: int | None, fired: bool) -> None:
        if not len(sessions):
            self.pack.clear()
            return
        first = int(self._due(sessions).min())
        if first != timer or fired:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.pack.update((first, _packed(sessions)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.pack.get()
        new = self._merged([self._merged([df.assign(opened=df["us"], answered=df["us"].where(df["answer"].astype(bool), NEVER))]) for df in rows])
        if held is None:
            self._keep(new.assign(ended=False), None, False)
            return
        sessions = _unpacked(held[1])
        over, open_ = sessions[sessions["ended"]], sessions[~sessions["ended"]]
        new = new[~new["session_id"].isin(over["session_id"])]
        self._keep(pd.concat([over, self._merged([open_, new]).assign(ended=False)], ignore_index=True), held[0], False)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, data = self.pack.get()
        sessions, now = _unpacked(data), max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        ending = sessions[~sessions["ended"] & (self._due(sessions) <= now)]
        sessions = sessions.assign(ended=sessions["ended"] | sessions.index.isin(ending.index))
        self._keep(sessions[self._due(sessions) > now], timer, True)
        if len(ending):
            deadline = ending["opened"] + self.span
            resolved = ending["answered"] <= deadline
            yield pd.DataFrame({
                "session_id": ending["session_id"], "opened": ending["opened"], "ended": ending["answered"].where(resolved, deadline), "resolved": resolved,
            })

    def close(self) -> None:
        pass


def session_timeouts(
    events: DataFrame, minutes: int = 30, lateness: str = "10 minutes", forget_minutes: int = 60, packs: int | None = None,
) -> DataFrame:
    """Sessions that end a fixed time after their first event, as a stream of outcomes.

    ``events``: ``session_id, at, answer`` (boolean). An answer within the time resolves a session; without one it
    expires and is quarantined. The outcome is emitted once the watermark (the newest event time less
    ``lateness``) has passed the deadline, without a further event of that session, so an answer that comes late
    but was given in time still counts. Events of an ended session are ignored for ``forget_minutes`` of event
    time; then nothing of it is left. Events later than ``lateness`` are dropped; ``ingest.dropped_late`` counts them.
    Events without a time are left out.

    Without ``packs`` a session has a state and a timer of its own, for streams that touch few sessions at a time.
    With it, sessions are dealt to so many packs with a state and a timer each, for very many sessions at a time.
    """
    at = F.col("at").cast("timestamp")
    timed = events.select("session_id", at.alias("at"), F.unix_micros(at).alias("us"), F.coalesce("answer", F.lit(False)).alias("answer"))
    timed, fields = timed.where("at is not null").withWatermark("at", lateness), "session_id string, opened long, ended long, resolved boolean"
    if packs is None:
        out = timed.groupBy("session_id").transformWithState(Timeout(minutes, forget_minutes), fields, outputMode="Append", timeMode="EventTime")
    else:
        dealt = timed.select("*", _pack_of("session_id", packs)).groupBy("pack")
        out = dealt.transformWithStateInPandas(TimeoutPack(minutes, forget_minutes), fields, outputMode="Append", timeMode="EventTime")
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select(
        "session_id", moment("opened").alias("opened_at"), moment("ended").alias("ended_at"),
        F.when(F.col("resolved"), "resolved").otherwise("quarantined").alias("outcome"),
        F.when(~F.col("resolved"), EXPIRED).alias("reason"),
    )


# --- cells that follow their jobs ---------------------------------------------------------------


#: The day, in days since 1970, of a job without one.
NO_DAY = -(1 << 31)


class JobPack(StatefulProcessor):
    """The jobs of a pack, each with its cell (day, status) and its number of records. A job that changes leaves
    its old cell for the new one; a batch gives the changes of a pack's cells."""

    JOB, COLUMNS = ["id", "at", "seq", "day", "status"], ["id", "at", "seq", "day", "status", "known", "records"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pack = handle.getValueState("pack", "jobs binary")

    @staticmethod
    def _newest(jobs: pd.DataFrame) -> pd.DataFrame:
        """Of equal events of a job the first."""
        return jobs.sort_values(["at", "seq"], ascending=False, kind="stable").drop_duplicates("id")

    @staticmethod
    def _cells(jobs: pd.DataFrame) -> pd.DataFrame:
        return jobs[jobs["known"]].groupby(["day", "status"], dropna=False, sort=False).agg(uploads=("id", "size"), records=("records", "sum")).reset_index()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.pack.get()
        old = _unpacked(held[0]) if held is not None else None
        jobs, counts = ([], []) if old is None else ([old.loc[old["known"], self.JOB]], [old.set_index("id")["records"]])
        for df in rows:
            own = df["is_job"].astype(bool)
            jobs.append(self._newest(df.loc[own, self.JOB]))
            counts.append(df.loc[~own, "id"].value_counts())
        jobs = self._newest(pd.concat(jobs, ignore_index=True)).set_index("id")
        counts = pd.concat(counts).groupby(level=0).sum()
        ids = jobs.index.union(counts.index)
        now = pd.DataFrame({
            **{c: jobs[c].reindex(ids, fill_value=0) for c in ("at", "seq", "day")}, "status": jobs["status"].reindex(ids),
            "known": ids.isin(jobs.index), "records": counts.reindex(ids, fill_value=0).astype("int64"),
        }, index=ids).rename_axis("id").reset_index()
        self.pack.update((_packed(now[self.COLUMNS]),))
        cells = [self._cells(now)]
        if old is not None:
            before = self._cells(old)
            cells.append(before.assign(uploads=-before["uploads"], records=-before["records"]))
        changes = pd.concat(cells, ignore_index=True).groupby(["day", "status"], dropna=False, sort=False, as_index=False)[["uploads", "records"]].sum()
        changes = changes[(changes["uploads"] != 0) | (changes["records"] != 0)]
        if len(changes):
            yield changes.assign(status=changes["status"].astype(object).where(changes["status"].notna(), None))

    def close(self) -> None:
        pass


def cell_changes(jobs: DataFrame, records: DataFrame, packs: int = PACKS) -> DataFrame:
    """The change log (day, status, uploads, records) of the daily trend, retractions included.

    ``jobs``: ``id, at, seq, day, status``, one event per change of a job; ``records``: ``id``, one row per stored
    record. Records of a job that is not known yet wait for it. State is one row per job, dealt to ``packs``, so
    nothing is late; a batch reads and writes the packs of the jobs that it names.
    """
    day, micros = F.coalesce(F.unix_date("day"), F.lit(NO_DAY)), F.unix_micros(F.col("at").cast("timestamp"))
    changed = jobs.where("at is not null and id is not null").select(
        "id", micros.alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), day.alias("day"), "status", F.lit(True).alias("is_job"))
    zero = F.lit(0).cast("long")
    added = records.where("id is not null").select(
        "id", zero.alias("at"), zero.alias("seq"), F.lit(0).alias("day"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("is_job"))
    dealt = changed.unionByName(added).select("*", _pack_of("id", packs)).groupBy("pack")
    out = dealt.transformWithStateInPandas(JobPack(), "day int, status string, uploads long, records long", outputMode="Append", timeMode="None")
    return out.withColumn("day", F.date_from_unix_date(F.nullif("day", F.lit(NO_DAY))))
