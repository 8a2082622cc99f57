"""Connected components of a graph given as a table of edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge to a smaller node, or none and only larger neighbours."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return counts.where("up > 1 or (up = 1 and n > 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest one around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (
        moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    )


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node reachable.

    ``edges`` has two columns of one type. Nulls, loops and repeats are ignored; no edges give no rows.
    Each round is stored in the shared folder, so neither lineage nor lost executors pile up work;
    the number of rounds grows with the logarithm of the longest path, and stars need none. Minima are summed before the
    shuffle, and a node with very many edges is split by adaptive joins. A round's rows are deleted once the
    next are written; the last ones are left to ``scratch``.
    """
    kept, own = scratch or Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    a, b = edges.columns
    edges = (
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a <> b").distinct()
    )
    edges = own.store(edges, "edges")
    while not _are_stars(edges):
        edges = own.store(_small_star(_large_star(edges)), "stars")
        last = own.paths.pop()
        own.drop()
        own.paths.append(last)
    kept.paths, own.paths = kept.paths + own.paths, []
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
