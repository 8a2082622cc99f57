"""Centroid clustering of vectors with exact integers; nearest centroids come from a vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Centroids of a leaf, and vectors searched at a time.
LEAF, BLOCK = 4, 4096
#: Scaled components lie below this, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27


class VPTree:
    """A vantage-point tree over integer points of shape (n, dims).

    An inner node has a vantage point and two children: the points within the median distance of it, and
    the others; each child knows the least and the greatest distance of its points to the vantage point.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = np.asarray(points, np.int64)
        self.vantage: list[int] = []  # -1 for a leaf
        self.members: list[np.ndarray] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if len(self.points):
            self._build(np.arange(len(self.points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> None:
        stack: list[tuple[np.ndarray, int, int]] = [(rows, -1, -1)]
        while stack:
            own, parent, place = stack.pop()
            me = len(self.vantage)
            if parent >= 0:
                _, least, most = self.children[parent][place]
                self.children[parent][place] = (me, least, most)
            if len(own) <= leaf:
                self.vantage.append(-1)
                self.members.append(own)
                self.children.append([])
                continue
            pivot, rest = int(own[0]), own[1:]
            far = np.sqrt(_squares(self.points[rest], self.points[pivot]).astype(float))
            middle = np.median(far)
            self.vantage.append(pivot)
            self.members.append(own[:1])
            self.children.append([])
            for side in (far <= middle, far > middle):
                if side.any():
                    stack.append((rest[side], me, len(self.children[me])))
                    self.children[me].append((-1, float(far[side].min()), float(far[side].max())))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of every vector's nearest point; ties go to the smaller number.

        Best first: each vector opens, of its open nodes, the one with the least lower bound, until that
        bound is above its radius. The radius is inclusive, so equally near points are found. Bounds are
        floating point with an allowance for rounding; distances themselves are exact integers. Vectors
        that open the same node are handled together.
        """
        n = len(vectors)
        number, best = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
        bounds = np.full((n, len(self.vantage)), np.inf)
        bounds[:, 0] = 0
        active = np.arange(n)
        while len(active):
            node = bounds[active].argmin(axis=1)
            bound = bounds[active, node]
            radius = np.sqrt(best[active].astype(float)) * (1 + 1e-9) + 1e-6
            going = np.isfinite(bound) & (bound <= radius)
            active, node = active[going], node[going]
            for k in np.unique(node):
                asked = active[node == k]
                bounds[asked, k] = np.inf
                here = None
                for m in self.members[k]:
                    here = _squares(vectors[asked], self.points[m])
                    better = (here < best[asked]) | (here == best[asked]) & (m < number[asked])
                    best[asked[better]], number[asked[better]] = here[better], m
                if self.vantage[k] >= 0:
                    away = np.sqrt(here.astype(float))
                    for child, least, most in self.children[k]:
                        bounds[asked, child] = np.maximum(np.maximum(away - most, least - away), 0)
        return number, best


def _squares(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return ((rows - one) ** 2).sum(axis=1)


def quantised(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 64.0) -> DataFrame:
    """(id, v) of the vectors with exactly ``dims`` components, none null or not finite; v holds the integers
    floor(scale * x), calculated in double. A component of 2^27 or more after scaling is an error, as no
    long could hold the squared distance."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long"))
    checked = F.transform(whole, lambda e: F.when(F.abs(e) < LARGEST, e).otherwise(
        F.raise_error(F.concat(F.lit("A scaled component is out of range: "), e.cast("string"))).cast("long")))
    return vectors.where((F.size(x) == dims) & fine).select(F.col(id).alias("id"), checked.alias("v"))


def _matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The vectors of a batch, in the order of its rows."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def seeds(kept: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The first centroids: the k vectors whose sha256 of ``seed:id`` is least, in that order; repeated ids
    by their vectors. A top-k, so k rows reach the driver."""
    key = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), "UTF-8"), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _sums(kept: DataFrame, tree: Broadcast, dims: int) -> DataFrame:
    """(cluster, place, total): the sum of each component over each cluster's vectors; place -1 is their
    number. A task sends one row per cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.value.points)
        total = np.zeros((k, dims + 1), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                v = _matrix(whole.slice(at, BLOCK), "v", dims)
                number, _ = tree.value.nearest(v)
                for c in np.unique(number):
                    own = v[number == c]
                    total[c, :-1] += own.sum(axis=0)
                    total[c, -1] += len(own)
        used = np.flatnonzero(total[:, -1])
        place = np.r_[np.arange(dims), -1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims + 1)), pa.array(np.tile(place, len(used))), pa.array(total[used].ravel())],
            names=["cluster", "place", "total"],
        )

    parts = kept.select("v").mapInArrow(run, "cluster long, place long, total long")
    return parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"))


def centroids(kept: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> np.ndarray:
    """The centroids after ``rounds`` of assignment and replacement by the componentwise floor of the mean.
    Empty clusters keep theirs. The driver sees k * (dims + 1) sums a round; the tree is built anew there and
    broadcast, k points whatever the data."""
    spark, points = kept.sparkSession, seeds(kept, k, seed)
    for _ in range(rounds if len(points) else 0):
        sums = np.zeros((len(points), dims + 1), object)
        tree = spark.sparkContext.broadcast(VPTree(points))
        for r in _sums(kept, tree, dims).collect():
            sums[r["cluster"], r["place"]] = r["total"]
        full = sums[:, -1] > 0
        points = points.copy()
        points[full] = (sums[full, :-1] // sums[full, -1:]).astype(np.int64)  # floor of Python integers
    return points


def assigned(kept: DataFrame, points: np.ndarray, dims: int = 64) -> DataFrame:
    """(id, cluster, distance): every vector's nearest of ``points`` and the squared distance to it."""
    tree = kept.sparkSession.sparkContext.broadcast(VPTree(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                part = whole.slice(at, BLOCK)
                number, distance = tree.value.nearest(_matrix(part, "v", dims))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.select("id", "v").mapInArrow(run, f"id {kind}, cluster int, distance long")


def clustered(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 64.0,
    k: int = 16, rounds: int = 3, seed: int = 1,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) for every vector kept by ``quantised``.

    ``centroid`` holds the integers of the final centroid; inertias are sums of squared distances over the
    cluster and over all vectors. Fewer than k vectors are as many clusters; equal seeds leave the later
    one empty, as ties go to the smaller number. Repeated rows stay repeated and count each; a null id
    stays null; an empty table, or one without a vector to keep, gives no rows. Other columns are not read.

    All that grows with the data stays in tasks: per round one pass that sends k * (dims + 1) sums a task.
    The table is read rounds + 3 times instead of being stored.
    """
    kept = quantised(vectors, id, vector, dims, scale)
    points = centroids(kept, k, rounds, dims, seed)
    if not len(points):
        points = np.zeros((1, dims), np.int64)
    out = assigned(kept, points, dims)
    total = {r["cluster"]: r["total"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    shape = T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
        T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType())),
    ])
    rows = [(c, total[c], sum(total.values()), [int(x) for x in points[c]]) for c in sorted(total)]
    about = vectors.sparkSession.createDataFrame(rows, shape)  # k rows at most
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
