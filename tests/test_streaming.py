"""Streams over several micro-batches and restarts."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd
import pytest
from conftest import column, rows
from pyspark.sql import functions as F

from tidemark.functions import jsons
from tidemark.streaming import ingest, keyed, live, state


def events(spark, *data):
    return spark.createDataFrame(list(data), "id string, at string, kind string").withColumn("at", F.col("at").cast("timestamp"))


def waves(spark, tmp_path, *tables, name="in"):
    """A stream over a folder that gets one file set per wave; yields after each is written."""
    path = str(tmp_path / name)
    for i, t in enumerate(tables):
        t.coalesce(1).write.parquet(f"{path}/wave={i}")
        yield spark.readStream.schema(t.schema).parquet(f"{path}/wave=*")


def test_replays_are_ignored_across_restarts_and_years(spark, tmp_path):
    one = events(spark, ("a", "2024-01-01 10:00:00", "x"), ("b", "2024-01-01 10:01:00", "x"), ("a", "2024-01-01 10:00:00", "x"))
    two = events(spark, ("d", "2025-06-01 10:02:00", "x"), ("c", "2024-01-01 10:03:00", "x"))
    three = events(spark, ("a", "2024-01-01 10:00:00", "x"), ("b", "2025-06-02 10:01:00", "x"), ("e", "2020-01-01 00:00:00", "x"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for stream in waves(spark, tmp_path, one, two, three):
        table = ingest.to_table(ingest.once(stream, "id"), "once", out, checkpoint)
    assert sorted(column(table, "id")) == ["a", "b", "c", "d", "e"]


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    one = events(spark, ("a", "2024-01-02 10:00:00", "x"))
    two = events(spark, ("late", "2024-01-01 10:00:00", "x"), ("b", "2024-01-02 10:30:00", "x"))
    out, checkpoint, dropped = str(tmp_path / "out"), str(tmp_path / "cp"), []
    for stream in waves(spark, tmp_path, one, two):
        query = ingest.once_within(stream, "id", "at", "1 hour").writeStream.format("parquet").option("checkpointLocation", checkpoint)
        dropped.append(ingest.dropped_late(ingest.run(query, out)))
    assert dropped == [0, 1]
    assert sorted(column(spark.read.parquet(out), "id")) == ["a", "b"]


def test_settings_of_the_session_stay(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ingest.STATE_STORE}
    for stream in waves(spark, tmp_path, events(spark, ("a", "2024-01-01 10:00:00", "x"))):
        ingest.to_table(ingest.once(stream, "id"), "once")
    assert {k: spark.conf.get(k, None) for k in ingest.STATE_STORE} == before


def session_events(spark, *data):
    rows_ = [(s, dt.datetime.fromisoformat(f"2024-01-01 {t}"), a) for s, t, a in data]
    return spark.createDataFrame(rows_, "session_id string, at timestamp_ntz, answer boolean")


def test_sessions_end_by_answer_or_timer(spark, tmp_path):
    """b expires in the second wave without an event of its own; a's answer comes late, but in time; c's comes
    too late; d opens again long after it was forgotten."""
    made = [
        session_events(spark, ("a", "10:00:00", False), ("b", "10:00:00", False), ("c", "10:05:00", False), ("d", "08:00:00", False)),
        session_events(spark, ("a", "10:20:00", True), ("x", "10:41:00", False)),
        session_events(spark, ("c", "10:50:00", True), ("b", "10:52:00", True), ("x", "10:53:00", True)),
        session_events(spark, ("d", "15:00:00", False), ("y", "18:00:00", False)),
    ]
    out, checkpoint, seen = str(tmp_path / "out"), str(tmp_path / "cp"), []
    for stream in waves(spark, tmp_path, *made):
        table = ingest.to_table(keyed.session_timeouts(stream), "sessions", out, checkpoint)
        seen.append(rows(table.select("session_id", "outcome", F.date_format("ended_at", "HH:mm"))))
    first = [("d", "quarantined", "08:30")]
    second = sorted([*first, ("a", "resolved", "10:20"), ("b", "quarantined", "10:30")])
    third = sorted([*second, ("c", "quarantined", "10:35")])
    assert seen[0] == first and seen[1] == second and seen[2] == third
    assert seen[3] == sorted([*third, ("x", "resolved", "10:53"), ("d", "quarantined", "15:30")])
    held = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    assert {r["id"] for r in held.select(F.col("key.session_id").alias("id")).collect()} == {"y"}
    reasons = spark.read.parquet(out).groupBy("outcome").agg(F.collect_set("reason").alias("r"))
    assert rows(reasons) == [("quarantined", [keyed.EXPIRED]), ("resolved", [])]


def test_packs_end_sessions_as_single_timers_do(spark, tmp_path):
    """The same outcomes after every wave; a session has no name; an ended one is
    ignored until it is forgotten."""
    made = [
        session_events(spark, ("a", "10:00:00", False), ("b", "10:00:00", None), ("c", "10:05:00", False), ("d", "08:00:00", False), (None, "10:06:00", True)),
        session_events(spark, ("a", "10:20:00", True), ("x", "10:41:00", False), ("b", "09:59:00", False)),
        session_events(spark, ("c", "10:50:00", True), ("b", "10:52:00", True), ("x", "10:53:00", True), ("a", "10:54:00", False)),
        session_events(spark, ("d", "15:00:00", False), ("y", "18:00:00", False)),
        session_events(spark, ("y", "18:01:00", True), ("z", "20:00:00", False)),
    ]
    seen = {packs: [] for packs in (None, 2)}
    for stream in waves(spark, tmp_path, *made):
        for packs, found in seen.items():
            out, checkpoint = str(tmp_path / f"out-{packs}"), str(tmp_path / f"cp-{packs}")
            table = ingest.to_table(keyed.session_timeouts(stream, packs=packs), "sessions", out, checkpoint)
            found.append(rows(table))
    assert seen[2] == seen[None]
    assert [len(r) for r in seen[None]] == [1, 3, 5, 7, 8]
    held = spark.read.format("statestore").option("stateVarName", "pack").load(str(tmp_path / "cp-2"))
    assert held.count() == 1  # z: nothing is left of a pack without sessions


def test_very_many_sessions_take_few_calls_of_the_state_store(spark):
    """One state and one timer a pack, however many sessions it has."""

    class Handle:
        calls = 0
        held = None

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

        def registerTimer(self, _):
            self.calls += 1

        deleteTimer = registerTimer

    handle, pack = Handle(), keyed.TimeoutPack(30, 60)
    pack.init(handle)
    hour = 3_600_000_000
    frame = pd.DataFrame({"session_id": [f"s{i}" for i in range(5000)], "us": [hour + i for i in range(5000)], "answer": [i % 2 == 0 for i in range(5000)]})
    assert list(pack.handleInputRows((0,), iter([frame[:3000], frame[2000:]]), None)) == []
    assert handle.calls == 3
    time = SimpleNamespace(getCurrentWatermarkInMs=lambda: hour // 1000 + 30 * 60_000 + 10)
    out = pd.concat(pack.handleExpiredTimer((0,), time, SimpleNamespace(getExpiryTimeInMs=lambda: hour // 1000 + 30 * 60_000)))
    assert handle.calls == 6 and len(out) == 5000 and out["resolved"].sum() == 2500


def test_stream_and_table_give_the_same_sessions(spark, tmp_path):
    data = session_events(spark, ("a", "10:00:00", False), ("a", "10:29:00", True), ("b", "10:01:00", False), ("b", "10:31:01", True), ("end", "20:00:00", False))
    for stream in waves(spark, tmp_path, data):
        got = ingest.to_table(keyed.session_timeouts(stream), "sessions")
    assert rows(got) == [r for r in rows(state.sessions(data)) if r[0] != "end"]


def job_events(spark, n):
    """Waves of two jobs: newer, older and replayed events, and a protected field."""
    base = dt.datetime(2024, 1, 1)
    for k in range(n):
        late = [("j", base, 0, "old", {"a": "0", "intent_id": "changed"})]
        now = [("j", base + dt.timedelta(hours=k), k, f"s{k}", {"a": str(k), f"f{k % 3}": str(k)}), ("k", base, k, "only", {})]
        yield spark.createDataFrame(late + now, "job string, at timestamp_ntz, seq long, status string, payload map<string,string>")


def test_fields_of_a_job_over_many_batches(spark, tmp_path):
    """Every wave is a micro-batch and a restart; the read sees the newest state only."""
    checkpoint, n = str(tmp_path / "cp"), 12
    for stream in waves(spark, tmp_path, *job_events(spark, n)):
        got = keyed.latest_fields(stream, "job", "at", "seq", F.col("status"), F.col("payload"), checkpoint)
    want = {"status": "s11", "a": "11", "f0": "9", "f1": "10", "f2": "11"}
    assert {r["job"]: r["state"] for r in got.collect()} == {"j": want, "k": {"status": "only"}}
    stored = spark.createDataFrame([("j", {"intent_id": "kept", "status": "x"}), ("other", {"q": "1"})], "job string, summary map<string,string>")
    merged = {r["job"]: r["summary"] for r in keyed.merged_state(got, stored, "job").collect()}
    assert merged == {"j": {**want, "intent_id": "kept"}, "k": {"status": "only"}, "other": {"q": "1"}}
    assert "intent_id" in jsons.PROTECTED_KEYS
    metadata = spark.read.format("state-metadata").load(checkpoint).first()
    assert metadata["maxBatchId"] >= n - 1


def test_fields_are_forgotten_after_their_time(spark, tmp_path):
    for stream in waves(spark, tmp_path, *job_events(spark, 1)):
        got = keyed.latest_fields(stream, "job", "at", "seq", F.col("status"), F.col("payload"), str(tmp_path / "cp"), ttl_ms=3_600_000)
    one = {r["job"]: sorted(r["state"]) for r in got.collect()}
    assert one == {"j": ["a", "f0", "status"], "k": ["status"]}


def test_newest_row_is_refreshed(spark, tmp_path):
    make = lambda *data: spark.createDataFrame([(u, dt.datetime.fromisoformat(t), s, v) for u, t, s, v in data], "u string, at timestamp_ntz, seq long, v double")
    made = [make(("a", "2024-01-01 10:00:00.123456", 1, 1.5), ("b", "2024-01-01 10:00:00", 1, None)),
            make(("a", "2024-01-01 09:00:00", 9, 2.5), ("b", "2024-01-01 10:00:00", 2, 3.5)), make(("a", "2024-01-02 09:00:00", 0, None))]
    got = [rows(keyed.newest_rows(s, ["u"], "at", "seq", str(tmp_path / "cp"))) for s in waves(spark, tmp_path, *made)]
    at = dt.datetime(2024, 1, 1, 10, 0, 0, 123456)
    assert got[0] == [("a", at, 1, 1.5), ("b", at.replace(microsecond=0), 1, None)]
    assert got[1] == [("a", at, 1, 1.5), ("b", at.replace(microsecond=0), 2, 3.5)]
    assert got[2][0] == ("a", dt.datetime(2024, 1, 2, 9), 0, None) and got[2][1] == got[1][1]


def test_trend_follows_status_changes(spark, tmp_path):
    """A job leaves its old cell with its records; records may come before their job; a repeated batch counts once."""
    make = lambda *data: spark.createDataFrame(
        [(i, dt.datetime.fromisoformat(t), s, dt.date.fromisoformat(d), x) for i, t, s, d, x in data], "id long, at timestamp_ntz, seq long, day date, status string")
    records = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    made = [make((1, "2024-01-01 10:00", 0, "2024-01-01", "queued"), (2, "2024-01-01 10:00", 0, "2024-01-01", "queued")),
            make((1, "2024-01-01 11:00", 0, "2024-01-01", "succeeded"), (1, "2024-01-01 09:00", 0, "2023-12-31", "planning")),
            make((2, "2024-01-02 00:00", 0, "2024-01-02", "failed"), (3, "2024-01-02 00:00", 0, "2024-01-02", "failed"))]
    rec = [records(1, 1, 3), records(2, 1), records(9)]
    path, checkpoint, seen = str(tmp_path / "trend"), str(tmp_path / "cp"), []
    for jobs, added in zip(waves(spark, tmp_path, *made), waves(spark, tmp_path, *rec, name="records")):
        cells = live.live_daily(jobs, added, path, checkpoint)
        seen.append(sorted((r["day"].isoformat(), r["status"], r["uploads"], r["records"]) for r in cells.current().collect()))
    assert seen[0] == [("2024-01-01", "queued", 2, 2)]
    assert seen[1] == [("2024-01-01", "queued", 1, 1), ("2024-01-01", "succeeded", 1, 3)]
    assert seen[2] == [("2024-01-01", "succeeded", 1, 3), ("2024-01-02", "failed", 2, 2)]
    kept = cells.versions()
    assert len(kept) == 2
    change = spark.createDataFrame([(dt.date(2024, 1, 2), "failed", -1, -1)], "day date, status string, uploads long, records long")
    for _ in range(2):
        cells.apply(change, kept[-1] + 1)
    assert sorted(r["uploads"] for r in cells.current().collect()) == [1, 1]


def test_jobs_of_a_pack_change_together(spark):
    """One read and one write of the state for 5,000 jobs, whose changes come as sums of cells. A job without day
    or status has a cell too; of equal events the first counts; names of jobs may be texts."""

    class Handle:
        calls = 0
        held = None

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    handle, pack = Handle(), keyed.JobPack()
    pack.init(handle)

    def batch(*data):
        frame = pd.DataFrame(list(data), columns=["id", "at", "seq", "day", "status", "is_job"])
        half = len(frame) // 2
        found = pd.concat([pd.DataFrame(columns=["day", "status", "uploads", "records"]), *pack.handleInputRows((0,), iter([frame[:half], frame[half:]]), None)])
        return sorted((tuple(r) for r in found.itertuples(index=False)), key=repr)

    record = lambda i: (i, 0, 0, 0, None, False)
    assert batch(*[(f"j{i}", 5, 0, 100, "queued", True) for i in range(5000)], record("j1"), record("new"), record("new")) == [(100, "queued", 5000, 1)]
    assert handle.calls == 2
    assert batch(("j1", 5, 0, 100, "other", True), ("j1", 4, 9, 99, "late", True), record("j1")) == [(100, "queued", 0, 1)]
    moved = batch(("new", 6, 0, keyed.NO_DAY, None, True), ("j1", 6, 0, 101, "done", True))
    assert moved == sorted([(100, "queued", -1, -2), (101, "done", 1, 2), (keyed.NO_DAY, None, 1, 2)], key=repr)
    assert batch(record("x")) == [] and handle.calls == 8


def test_lateness_is_stated(spark, tmp_path):
    for stream in waves(spark, tmp_path, events(spark, ("a", "2024-01-01 10:00:00", "x"))):
        with pytest.raises(TypeError):
            live.daily_counts(stream, "at", ["kind"])
        assert live.daily_counts(stream, "at", ["kind"], "1 hour").isStreaming
