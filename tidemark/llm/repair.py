"""Repair of conversation structure: the cheapest edits that make the roles alternate.

The rows of a conversation and the states of the pattern ``(s?(ua)+)?`` span a lattice. Node (i, state)
means that i rows are used up; edits are its edges. The cheapest way is searched from both ends, and
among equally cheap ways the least sequence of edit initials is taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE

#: The costs of edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial leads to from a state; Rerole and Insert go to ``TURN`` of a state.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Adjacent initials in order.
LEGAL = {"su", "ua", "au"}
#: Conversations of up to this many rows keep their answer for others of the same shape.
SHORT, HELD = 64, 50_000


def _forward(codes: str, node: tuple[int, int]) -> list[tuple[str, tuple[int, int], int]]:
    """(initial, next node, cost) of the edits at a node, in ASCII order. A row's code is the initial of its
    role (x for any other), upper case if it is truncated, or - if it must be deleted."""
    i, state = node
    out = []
    if i < len(codes):
        out.append(("D", (i + 1, state), DELETE))
    out.append(("I", (i, TURN[state]), INSERT))
    if i < len(codes) and codes[i] != "-":
        more = TRUNCATED if codes[i].isupper() else 0
        after = STEP.get((state, codes[i].lower()))
        if after is not None:
            out.append(("K", (i + 1, after), KEEP + more))
        out.append(("R", (i + 1, TURN[state]), REROLE + more))
    return out


def _backward(codes: str, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int]]:
    """(previous node, cost) of the edits that lead to a node."""
    i, state = node
    before = [s for s in range(4) if TURN[s] == state]
    for s in before:
        yield (i, s), INSERT
    if i == 0:
        return
    code = codes[i - 1]
    yield (i - 1, state), DELETE
    if code == "-":
        return
    more = TRUNCATED if code.isupper() else 0
    for s in before:
        yield (i - 1, s), REROLE + more
    for s in range(4):
        if STEP.get((s, code.lower())) == state:
            yield (i - 1, s), KEEP + more


def solve(codes: str) -> tuple[int, str]:
    """The least cost, and the least audit of that cost, of the rows ``codes`` of one conversation.

    Both searches go on until the sum of their next distances is above the best crossing, so every node of
    every cheapest way is settled from one side at least, and all equal crossings are finished. The walk
    then takes the least initial that stays on a cheapest way: initials at a node differ, so the audit is
    least as a whole. Work and memory are linear in the rows but for the heaps' logarithm.
    """
    start, goals = (0, START), [(len(codes), START), (len(codes), ASSISTANT)]
    seen = ({start: 0}, dict.fromkeys(goals, 0))
    heaps = ([(0, start)], [(0, g) for g in sorted(goals)])
    done: tuple[dict, dict] = ({}, {})
    best = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        d, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = d
        ways = ((n, w) for _, n, w in _forward(codes, node)) if side == 0 else _backward(codes, node)
        for after, w in ways:
            if d + w < seen[side].get(after, best + 1):
                seen[side][after] = d + w
                heapq.heappush(heaps[side], (d + w, after))
            if after in seen[1 - side]:
                best = min(best, d + w + seen[1 - side][after])
        if node in seen[1 - side]:
            best = min(best, d + seen[1 - side][node])
    ahead, behind = done
    good: set = set()  # settled forward, on a cheapest way

    def stays(spent: int, node: tuple[int, int]) -> bool:
        """Whether a node reached at a cost is on a cheapest way."""
        return spent + behind.get(node, best + 1) == best or node in good and spent == ahead[node]

    for node in sorted(ahead, key=lambda n: (-n[0], -ahead[n])):
        ends = node in goals and ahead[node] == best
        if ends or stays(ahead[node], node) or any(stays(ahead[node] + w, after) for _, after, w in _forward(codes, node)):
            good.add(node)
    audit, node, spent = [], start, 0
    while spent < best or node not in goals:
        initial, node, w = next(x for x in _forward(codes, node) if stays(spent + x[2], x[1]))
        audit.append(initial)
        spent += w
    return best, "".join(audit)


_solved = lru_cache(maxsize=HELD)(solve)


def edits(codes: str) -> tuple[int, str]:
    return _solved(codes) if len(codes) <= SHORT else solve(codes)


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits of an audit."""
    out, at, state = [], iter(rows), START
    for c in audit:
        if c == "I":
            state = TURN[state]
            out.append((ROLE[state], ""))
            continue
        role, text = next(at)
        if c == "K":
            state = STEP[state, role[:1]]
            out.append((role, text))
        elif c == "R":
            state = TURN[state]
            out.append((ROLE[state], text))
    return out


def examined(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of the rows (turn, role, text) of
    one conversation in order."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts, codes, earlier, initials = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set(), []
    for _, role, text in rows:
        initial = role[:1]
        end = text.rstrip(WHITE)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in earlier else "truncated" if end not in ".!?" else None
        earlier.add((role, text))
        if fault:
            counts[fault] += 1
        code = initial if initial and initial in "sua" else "x"
        codes.append("-" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        initials.append(initial)
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cost, audit = edits("".join(codes))
    kept = apply_audit([(role, text) for _, role, text in rows], audit)
    return (gaps, *counts.values(), illegal, cost, audit, "\n".join(f"{role}:{text}" for role, text in kept))


COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def repaired(
    rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the repaired conversation.

    Rows go by turn (nulls first), equal turns by role and text. Faults of a row, the first counts: ``blank``
    (nothing but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (does not end with
    one of ``.!?``). Blank and duplicate rows are deleted. ``audit`` has an initial per edit: Keep, Rerole,
    Delete, Insert; ``repaired`` is one ``role:text`` line per row. Null roles and texts count as one space;
    null ids are one conversation; an empty role has no initial and cannot be kept. Rows whose column
    ``present`` is false only name their conversation; one without other rows has zeros and empty texts. An
    empty table gives no rows. Other columns are not read.

    A conversation is one task's work, held one at a time; rows of all others only pass through.
    """
    kind = rows.schema[id].dataType.simpleString()
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    slim = rows.select(
        F.col(id).alias("id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"), there.alias("there"),
    )
    slim = slim.select("id", "turn", "there", *(F.when(F.col("there"), F.col(c)).alias(c) for c in ("role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(ids, schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        schema, name, held, any_row = None, None, [], False
        for whole in batches:
            if schema is None:
                longs = [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in COLUMNS.split(", ")]
                schema = pa.schema([("id", whole.schema.field("id").type), *longs])
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000).to_pydict()
                for i, t, r, x, here in zip(part["id"], part["turn"], part["role"], part["text"], part["there"]):
                    if any_row and i != name:
                        ids.append(name)
                        out.append(examined(held))
                        held = []
                        if len(ids) == 500:
                            yield flush()
                            ids, out = [], []
                    name, any_row = i, True
                    if here:
                        held.append((t, r, x))
        if any_row:
            ids.append(name)
            out.append(examined(held))
            yield flush()

    ordered = slim.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    found = ordered.select("id", "turn", "role", "text", "there").mapInArrow(run, f"id {kind}, {COLUMNS}")
    return found.withColumnRenamed("id", id)


def damaged(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``id:turn`` modulo 20: 0 drops a row (``present``
    is false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user; nulls are one
    space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(id), F.lit(":"), space(turn))) % 20
    slim = rows.select(id, turn, space(role).alias(role), space(text).alias(text), fault.alias("fault"))
    hurt = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return slim.select(
        id, turn, F.when(F.col("fault") == 4, "user").otherwise(F.col(role)).alias(role), hurt.alias(text),
        (F.col("fault") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")
