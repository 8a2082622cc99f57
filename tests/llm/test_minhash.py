import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from check import rows_of
from text_helpers import SMALL, docs, found, lower, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import minhash, pairs, queries
from tidemark.llm.simhash import shingle_hashes

NAME = "op13_minhash_groups"


def shingles(text, width=4):
    w = found(lower(text))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def expected(rows, width=4, percent=80):
    """(id, n, component, kept) of every row, by comparing all distinct sets that have a shingle in common."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t, width), []).append(i)
    nodes = [s for s in sets if s]
    owners = {}
    for n, s in enumerate(nodes):
        for x in s:
            owners.setdefault(x, []).append(n)
    root = list(range(len(nodes)))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in {p for o in owners.values() for p in itertools.combinations(o, 2)}:
        both = len(nodes[a] & nodes[b])
        if 100 * both >= percent * (len(nodes[a]) + len(nodes[b]) - both):
            root[top(a)] = top(b)
    least = {}
    for n, s in enumerate(nodes):
        ids = [i for i in sets[s] if i is not None]
        least[top(n)] = min([*ids, *([least[top(n)]] if least.get(top(n)) is not None else [])], default=None)
    where = {s: top(n) for n, s in enumerate(nodes)}
    out = []
    for i, t in rows:
        s = shingles(t, width)
        c = least[where[s]] if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_sql_and_brute_force(spark, texts):
    got = queries.catalog.queries[NAME](spark, SMALL)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert rows_of(got.toArrow()) == rows_of(db.sql(queries.catalog.sql[NAME]).to_arrow_table())
    assert plain(got) == expected([(i, r["text"]) for i, r in texts.items()])


def family(rng, words, members, edits):
    """Texts that differ from one text in some words each."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    for _ in range(members):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, edits)):
            own[at] = f"x{rng.randrange(10**9)}"
        yield " ".join(own)


@pytest.mark.parametrize("shard_rows", [2048, 16])
def test_families_around_the_limit(spark, shard_rows):
    """Half of the pairs of a family are a little above 0.8, half a little below; one family is large, and a
    third of all rows is one text."""
    rng = random.Random(7)
    made = [*family(rng, 150, 150, 8), *(t for _ in range(25) for t in family(rng, rng.randint(30, 200), 6, 5))]
    rows = [(n, t) for n, t in enumerate([*made, *["same text " * 30] * (len(made) // 2)])]
    rng.shuffle(rows)
    want = expected(rows)
    assert 20 < sum(r[3] for r in want) < len(made)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert plain(minhash.near_duplicates(table, shard_rows=shard_rows)) == want


def test_pairs_just_below_the_limit_are_not_verified_one_by_one(spark, monkeypatch):
    """Most pairs of 160 texts are at 0.76, which no signature tells from 0.8. Sets are compared for the pivots'
    pairs and then for fewer pairs than there are texts, of 12,720."""
    rng, verified, counts = random.Random(5), pairs.verified, []
    base, rows = [f"w{k}" for k in range(600)], []
    for n in range(160):
        own = list(base)
        for at in rng.sample(range(4, 596, 4), 10):
            own[at] = f"x{n}y{at}"
        rows.append((n, " ".join(own)))
    monkeypatch.setattr(pairs, "verified", lambda found, *rest: (counts.append(found.count()), verified(found, *rest))[1])
    assert plain(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
    assert len(counts) > 1 and sum(counts[1:]) < len(rows), counts


def test_parities_bound_the_difference_of_two_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 500, 520, 9000):
        for only in (0, 1, n // 10, n // 3):
            both, one, two = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (n, only, 2 * only))
            odd = pa.chunked_array([pa.array([pairs.parities(np.concatenate(x)) for x in ((both, one), (both, two), (both,))], pa.binary())])
            a, b = np.array([0, 1, 2, 0]), np.array([1, 2, 0, 0])
            least, real = pairs.apart(odd, a, b), np.array([3 * only, 2 * only, only, 0])
            assert (least <= real).all() and (least >= 0.7 * real - 4).all()
            size, label = np.array([n + only, n + 2 * only, n]), np.arange(3)
            similar = 100 * (size[a] + size[b] - real) >= 80 * (size[a] + size[b] + real)
            left = set(zip(*(x.tolist() for x in pairs.still_open(odd, size, label, a, b, 80, False))))
            assert left >= {(int(x), int(y)) for x, y in zip(a[similar], b[similar])}


def test_pairs_that_join_labels_once():
    odd = pa.chunked_array([pa.array([pairs.parities(np.arange(100, 200 + k, dtype=np.uint64)) for k in range(4)], pa.binary())])
    size, label = np.arange(100, 104), np.array([7, 8, 8, 9])
    a, b = (np.array(x) for x in zip(*itertools.combinations(range(4), 2)))
    one, two = pairs.still_open(odd, size, label, a, b, 80, True)
    assert list(zip(one.tolist(), two.tolist())) == [(0, 1), (2, 3)] and len(set(label)) == 1
    assert [len(x) for x in pairs.still_open(pa.chunked_array([odd.chunk(0)[:0]], pa.binary()), size[:0], label[:0], a[:0], b[:0], 80, True)] == [0, 0]


def test_recall_of_pairs_at_the_limit(spark):
    """1,500 pairs between 0.80 and 0.85: every one is found."""
    rng, rows = random.Random(3), []
    for n in range(1500):
        size = rng.randint(60, 160)
        one = [f"p{n}x{k}" for k in range(size)]
        two = list(one)
        at = 10
        while True:  # edits far apart cost four shingles each
            again = list(two)
            again[at] = "changed"
            a, b = shingles(" ".join(one)), shingles(" ".join(again))
            if at + 8 >= size or len(a & b) < 0.8 * len(a | b):
                break
            two, at = again, at + 6
        rows += [(2 * n, " ".join(one)), (2 * n + 1, " ".join(two))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i // 2 * 2 for i in got)


def test_batches_drop_what_the_posterior_says():
    least = minhash.least_matches(80, 1e-4)
    assert least == sorted(least) and len(least) == 16 and 350 < least[-1] < 410
    rng = np.random.default_rng(0)
    n, lanes = 4000, minhash.LANES
    one = rng.integers(0, 1 << 16, (n, lanes)).astype(np.uint16)
    rows = np.arange(n)
    for similarity, low, high in ((0.8, 0.99, 1.0), (0.5, 0.0, 0.01)):
        two = np.where(rng.random((n, lanes)) < similarity, one, one + np.uint16(1))
        left, matches = minhash.surviving(one, two, rows, rows, least)
        assert low <= len(left) / n <= high and (matches == (one == two).sum(axis=1)[left]).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (5, 40, 400, 9000):
        for _ in range(20):
            both, a, b = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (4 * n, n // 2 + 1, n // 2 + 1))
            one, two = np.concatenate([both, a]), np.concatenate([both, b])
            errors.append((minhash.signature(one) == minhash.signature(two)).mean() - len(both) / (len(both) + len(a) + len(b)))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.11


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert plain(minhash.near_duplicates(odd)) == expected(rows)
    assert plain(minhash.near_duplicates(none)) == []
    long = " ".join(f"w{k}" for k in range(12_000))
    more = [(None, "a b c d e f"), (None, "a b c d e f"), (8, "A b c\td e f"), (None, "alone here"), (None, None), (9, long), (10, long + " end"), (9, "other words of this id")]
    table = spark.createDataFrame([(*r, 1, 2) for r in more], "doc_id long, text string, node int, key int")
    assert plain(minhash.near_duplicates(table)) == expected(more)


def test_scratch_is_deleted(spark, docs, monkeypatch):
    made = []
    store = minhash.Scratch.store
    monkeypatch.setattr(minhash.Scratch, "store", lambda self, df, label: (made.append(self), store(self, df, label))[1])
    out = minhash.near_duplicates(docs.limit(50))
    assert made and not any(s.paths for s in made) and out.count() == 50


def test_sets_are_those_of_the_texts(texts):
    for r in list(texts.values())[:40]:
        assert len(np.unique(shingle_hashes(r["text"], 4))) == len(shingles(r["text"]))
