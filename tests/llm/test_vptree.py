import hashlib
import math

import duckdb
import numpy as np
import pytest
from check import rows_of
from text_helpers import SMALL

from tidemark.llm import queries, vptree

NAME = "op12_vptree_clusters"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k=16, rounds=3, dims=64):
    """Clusters by comparing every vector with every centroid, in Python integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: "null" if i is None else str(i)
    first = sorted((hashlib.sha256(f"1:{text(i)}".encode()).hexdigest(), v) for i, v in kept)
    points = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        own = [[] for _ in points]
        for _, v in kept:
            own[near(v)[1]].append(v)
        points = [[sum(x) // len(o) for x in zip(*o)] if o else p for o, p in zip(own, points)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = [sum(d for _, c, d in found if c == n) for n in range(len(points))]
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, total[c], sum(total), sha[c]) for i, c, d in found), key=str)


def run(spark, table):
    spark_rows = vptree.clustered(table).collect()
    sha = lambda p: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()
    return sorted(((r[0], r[1], r[2], r[3], r[4], sha(r[5])) for r in spark_rows), key=str)


def test_query_against_sql_and_plain_code(spark):
    got = queries.catalog.queries[NAME](spark, SMALL)
    names, _, rows = rows_of(got.toArrow())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want_names, _, want = rows_of(db.execute(queries.catalog.sql[NAME]).to_arrow_table())
    assert (names, rows) == (want_names, want)
    table = db.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain(table)


@pytest.mark.parametrize("spread", [1, 2, 40])
def test_tree_equals_all_comparisons(spread):
    """Small spreads make many ties, equal points too."""
    rng = np.random.default_rng(spread)
    for n in (1, 2, 5, 16, 90):
        points, vectors = rng.integers(-spread, spread + 1, (n, 6)), rng.integers(-spread, spread + 1, (300, 6))
        number, distance = vptree.VPTree(points).nearest(vectors)
        every = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_large_components_are_exact():
    points = np.array([[vptree.LARGEST - 1] * 64, [vptree.LARGEST - 2] * 64, [-vptree.LARGEST + 1] * 64])
    number, distance = vptree.VPTree(points, leaf=1).nearest(points)
    assert list(number) == [0, 1, 2] and not distance.any()


def test_pruning_spares_comparisons(monkeypatch):
    """Well separated centroids: most are never compared."""
    rng = np.random.default_rng(3)
    points = rng.integers(-10_000, 10_000, (200, 2))
    tree, seen = vptree.VPTree(points), []
    squares = vptree._squares
    monkeypatch.setattr(vptree, "_squares", lambda rows, one: seen.append(len(rows)) or squares(rows, one))
    tree.nearest(points[rng.integers(0, 200, 1000)] + 1)
    assert sum(seen) < 1000 * 200 / 4


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    some = lambda: [float(x) for x in rng.normal(size=64).astype(np.float32)]
    rows = [(i % 25, some()) for i in range(40)] + [(None, some()), (None, some()), (50, None), (51, []), (52, some()[:63]), (53, some() + [0.0])]
    rows += [(54, [None] + some()[1:]), (55, [float("nan")] + some()[1:]), (56, [float("-inf")] + some()[1:]), *[(57, [0.5] * 64)] * 30]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, cluster string, v string")
    assert run(spark, table.repartition(5)) == plain(rows)
    few = rows[:7]
    assert run(spark, spark.createDataFrame(few, "vec_id long, embedding array<float>")) == plain(few)
    assert run(spark, table.where("false")) == [] and run(spark, table.where("vec_id = 52")) == []


def test_equal_vectors_leave_later_centroids_empty(spark):
    rows = [(i, [1.0] * 64) for i in range(20)]
    assert run(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == plain(rows)


def test_out_of_range_is_an_error(spark):
    table = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="out of range"):
        vptree.clustered(table).collect()
