import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from text_helpers import SMALL

from tidemark.llm import queries, repair

FULL = re.compile("(s?(ua)+)?")


def cheapest(codes):
    """All sequences of edits in order of cost and audit, until one gives the pattern. The number of rows
    out is bounded by what can pay off."""
    heap = [(0, "", 0, "")]
    while True:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(codes) and FULL.fullmatch(roles):
            return cost, audit
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        for c in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + c))
        if i < len(codes):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if codes[i] != "-":
                more = 5 * codes[i].isupper()
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + codes[i].lower()))
                for c in "ua":
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + c))


def test_audits_of_all_short_conversations():
    for n in range(5):
        for codes in map("".join, itertools.product("sua-xA", repeat=n)):
            assert repair.solve(codes) == cheapest(codes), codes


def test_audits_of_longer_conversations():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choices("suaSUAx-", [1, 5, 5, 1, 1, 1, 1, 1], k=rng.randint(6, 9)))
        assert repair.solve(codes) == cheapest(codes), codes


def test_long_conversation_is_linear():
    cost, audit = repair.solve("uaUa-u" * 3000)
    assert len(audit.replace("I", "")) == 18000 and cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in audit) + 5 * sum(
        c in "KR" and x.isupper() for c, x in zip(audit.replace("I", ""), "uaUa-u" * 3000))


def damage(table):
    out = {}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    counts, codes = {"blank": 0, "duplicate": 0, "truncated": 0}, ""
    for i, (_, role, text) in enumerate(rows):
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "" if body[-1] in ".!?" else "truncated"
        if fault:
            counts[fault] += 1
        code = role[0] if role[:1] in ("s", "u", "a") else "x"
        codes += "-" if fault in ("blank", "duplicate") else code.upper() if fault else code
    cost, audit = cheapest(codes)
    out, left = [], list(rows)
    for c in audit:
        _, role, text = left.pop(0) if c != "I" else (None, "", "")
        if c != "D":
            other = "assistant" if out and out[-1][0] == "u" else "user"
            out.append(f"{role if c == 'K' else other}:{text}")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_brute_force(spark):
    table = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in queries.catalog.queries["op11_conversation_repair"](spark, SMALL).collect()}
    assert got == {conv: expected(rows) for conv, rows in damage(table).items()}
    assert sum(v[5] > 0 for v in got.values()) > 5


ROWS = [
    (None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "So!"),
    (1, 0, "user", "a" * 100_000 + "."), (1, 0, "user", "a" * 100_000 + "."), (1, 5, "assistant", "é😀 ok?\n"),
    (2, 3, "tool", "x."), (2, 3, "", "y."), (2, 4, "System", ""), (3, None, "user", "A."), (3, None, "assistant", "B."),
    (4, 7, "assistant", " \t\n"),
]


def test_odd_rows(spark):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "conv_id long, turn long, role string, text string, audit string, id string")
    got = {r["conv_id"]: r for r in repair.repaired(table).collect()}
    plain = {}
    for conv, turn, role, text in ROWS:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in plain.items():
        want = expected(rows)
        assert tuple(got[conv][c] for c in NAMES[:-1]) == want[:-1]
        assert hashlib.sha256(got[conv]["repaired"].encode()).hexdigest() == want[-1]
    assert got[4]["audit"] == "D" and got[4]["repaired"] == "" and got[1]["gaps"] == 4
    assert repair.repaired(table.where("false")).collect() == []


def test_dropped_rows_name_their_conversation(spark):
    table = spark.createDataFrame([(i, t, "user", "Yes.") for i in range(200) for t in range(1)], "conv_id long, turn long, role string, text string")
    hurt = repair.damaged(table)
    got = {r["conv_id"]: r for r in repair.repaired(hurt, present="present").collect()}
    want = damage([tuple(r) for r in table.collect()])
    assert set(got) == set(want) and any(not rows for rows in want.values())
    assert all((got[i]["audit"], got[i]["cost"], got[i]["repaired"]) == ("", 0, "") for i, rows in want.items() if not rows)


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(spark, partitions):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(partitions)
    assert sorted(map(str, repair.repaired(table).collect())) == sorted(map(str, repair.repaired(table.coalesce(1)).collect()))
