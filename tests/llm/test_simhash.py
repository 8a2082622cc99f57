import itertools
import random

import numpy as np
import xxhash
from text_helpers import SMALL, found, lower, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import bktree, components, queries, simhash


def brute(text, width=3):
    w = found(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), seed=42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, links):
    name = {n: n for n in nodes}

    def root(n):
        while name[n] != n:
            n = name[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        name[b] = a
    return {n: root(n) for n in nodes}


def test_query_against_all_pairs(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.catalog.queries["op2_simhash_groups"](spark, SMALL).collect()}
    fps = {i: brute(r["text"]) for i, r in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    roots = union(fps, links)
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}


def test_crowded_shards_lose_no_link(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(20)] + [0]
    fps = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(40)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    expected = {n: r for n, r in union(signed, links).items() if any(n in x for x in links)}
    for limit in (4096, 3):
        edges = simhash.fingerprint_links(df, limit)
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
        assert {r["node"]: r["root"] for r in components.connected_components(edges).collect()} == expected


def test_tree_search_is_exact():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, (400, 1), np.uint64) & np.uint64(0xFFF)
    tree = bktree.BKTree(prints)
    got = {(int(a), int(b)) for q, m in tree.search(prints, 2) for a, b in zip(q, m)}
    assert got == {(i, j) for i in range(400) for j in range(400) if int(prints[i, 0] ^ prints[j, 0]).bit_count() <= 2}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(5, 5), (None, 3), (70, 71), (71, 70)]
    got = components.connected_components(spark.createDataFrame(edges, "x long, y long"))
    names = {r["node"]: r["root"] for r in got.collect()}
    assert all(names[i] == i // 20 * 20 for i in range(59)) and names[71] == 70


def test_odd_rows(odd, none):
    got = sorted(tuple(r) for r in simhash.groups(odd).collect())
    zero = [r for r in got if r[1] == "0" * 16]
    assert [r[0] for r in zero] == [1, 2, 4] and {r[2] for r in zero} == {1}
    assert len(got) == odd.count() and simhash.groups(none).collect() == []
