import hashlib
import random

import duckdb
from text_helpers import SMALL, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import chat, queries

MARKS = ["", "\\", "### ", "</turn>\n", "a:b", "\\### Assistant: </turn> ok", "é\r\n", "<", "#", ": "]


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    expected = sorted(db.execute(queries.catalog.sql["op5_chat_format"]).fetchall())
    got = queries.catalog.queries["op5_chat_format"](spark, SMALL)
    assert sorted(map(tuple, got.collect())) == expected and expected[0][:2] == (-7, 2)


def brute(events):
    """Play the log event by event."""
    held = {}
    for conv, _, kind, message, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        key = (conv, message)
        if kind == "delete":
            held.pop(key, None)
            continue
        now = held.setdefault(key, ["", ""])
        if kind == "open":
            now[0] = role
        elif kind == "delta":
            now[1] += text
        else:
            now[1] = text if kind == "edit" else ""
    return {k: tuple(v) for k, v in held.items()}


def test_fold_and_render(spark):
    rng = random.Random(3)
    events = []
    for conv in range(12):
        for message in range(rng.randrange(1, 5)):
            events.append((conv, len(events), "open", message, rng.choice(["user", "assistant", "a:b#"]), None))
            for _ in range(rng.randrange(6)):
                events.append((conv, len(events), rng.choice(["delta", "delta", "edit", "regenerate"]), message, None, rng.choice(MARKS)))
            if rng.random() < 0.1:
                events.append((conv, len(events), "delete", message, None, None))
    shuffled = events + events[::3]  # delivered twice
    rng.shuffle(shuffled)
    log = spark.createDataFrame(shuffled, "conv_id long, seq long, kind string, message long, role string, text string")
    said = chat.messages(log)
    expected = brute(events)
    assert {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in said.collect()} == expected
    for part in (1, 40, 1 << 20):
        back = {r["conv_id"]: r for r in chat.read_back(chat.rendered(said, part)).collect()}
        assert back.keys() == {c for c, _ in expected}
        for conv, r in back.items():
            turns = [expected[k] for k in sorted(expected) if k[0] == conv]
            learned = "".join(t for role, t in turns if role == "assistant")
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "first", "x"), (None, 1, "assistant", "y" * 30000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 30000
    assert chat.formatted(df).where("conv_id = 1").first()["formatted"].startswith("### : first</turn>\n")
    assert chat.read_back(chat.formatted(df.where("turn > 5"))).collect() == []
