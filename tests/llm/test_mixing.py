from collections import defaultdict

import pytest
from text_helpers import SMALL, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import mixing, queries


def filled(sizes, cycle=(1, 2, 3), repeats=3):
    """Water filling by rounds: cap what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        out = {s: repeats * sizes[s] if s in full else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in full and out[s] > repeats * sizes[s]}
        if not above:
            return out
        full |= above


def brute(rows, goal):
    """Queue every round of every document by finish time and take until the budget is spent."""
    spent, taken = 0, defaultdict(int)
    for _, i, size in sorted(rows):
        spent += size
        if spent > goal:
            break
        taken[i] += size
    return taken


def test_targets_and_budget(spark, docs):
    got = queries.catalog.queries["op1_mix_sources"](spark, SMALL).collect()
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert len(got) == len(sources)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    largest = max(r["size"] for r in got)
    for r in got:
        s = sources[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    expected = filled(size)
    assert target == pytest.approx(expected)
    assert all(r["source_size"] == size[sources[r["doc_id"]]] for r in got)
    assert all(abs(taken[s] - target[s]) <= largest + 1 for s in target)
    assert sum(size.values()) - largest <= sum(taken.values()) <= sum(size.values())


def test_caps_and_reruns(spark):
    rows = [(i, "abc"[min(2, i % 40)], "w " * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, cycle=(5, 1, 1))
    first = {r["doc_id"]: tuple(r) for r in got.collect()}
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    expected = filled(sizes, (5, 1, 1))
    assert {s: first[i][3] for i, s, _ in rows} == pytest.approx(expected)
    assert expected["a"] == 3 * sizes["a"]
    again = mixing.mix(df.repartition(3), cycle=(5, 1, 1))
    assert {r["doc_id"]: tuple(r) for r in again.collect()} == first
    # The same queue in plain Python, from the stored shuffled order.
    order = {r["doc_id"]: r["k"] for r in df.selectExpr("doc_id", "xxhash64(doc_id, 17) k").collect()}
    queue = []
    for s in "abc":
        until = 0
        for _, i, n in sorted((order[i] % 2**64, i, len(t.split())) for i, x, t in rows if x == s):
            until += n
            queue += [((until + k * sizes[s]) / expected[s], i, n) for k in range(3) if n]
    taken = brute(queue, sum(sizes.values()))
    assert sum(abs(first[i][4] - taken[i]) for i, _, _ in rows) <= 12  # ties at the edge


def test_odd_rows(odd, none):
    got = sorted(tuple(r) for r in mixing.mix(odd).collect())
    assert len(got) == odd.count() and all(r[4] == 0 for r in got if r[1] == 0)
    assert mixing.mix(none).collect() == []
