"""Groups of similar sets: pairs from shared keys, sketches that prune them, sets that decide.

Sets of shingles are named by nodes. What a key's members have in common is found without forming all
pairs of a key: a few pivots of it meet all others, which is linear, members of one group need no
comparison afterwards, and only pairs between groups are searched, inside tasks, by their sketches.
Parities of the sets then drop most of the pairs that cannot be similar, and never one that is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components

#: Bits of a set's parities for each of its members, at least, and the fewest of any set.
BITS, FEWEST = 8, 4096
#: Bytes of parities compared at a time.
PIECE = 1 << 22


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes falls on each of 2^k bits (an odd sketch)."""
    bits = max(FEWEST, 1 << (BITS * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(odd: pa.ChunkedArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows ``a`` and ``b`` of parities, the bits in which they differ: two sets have at least so many members
    that only one of them has. The wider parities are folded to the width of the others, which keeps them parities."""
    sizes = pc.binary_length(odd).to_numpy()
    width, out = np.minimum(sizes[a], sizes[b]), np.zeros(len(a), np.int64)
    for w in np.unique(width):
        of, step = np.flatnonzero(width == w), max(1, PIECE // int(w))
        for part in (of[at : at + step] for at in range(0, len(of), step)):
            rows, where = np.unique(np.r_[a[part], b[part]], return_inverse=True)
            words = (np.frombuffer(odd[int(row)].as_py(), np.uint64).reshape(-1, w // 8) for row in rows)
            folded = np.stack([np.bitwise_xor.reduce(x, axis=0) for x in words])
            one, two = folded[where[: len(part)]], folded[where[len(part) :]]
            out[part] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
    return out


def still_open(
    odd: pa.ChunkedArray, size: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, once: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows ``a`` and ``b`` whose parities allow ``percent`` of a hundred of the union in common; all
    similar pairs are among them. With ``once``, only those that join labels not joined by pairs before them, nearest
    first, and ``label`` is changed to the joined ones."""
    least, both = apart(odd, a, b), size[a] + size[b]
    able = 100 * (both - least) >= percent * (both + least)
    a, b, least = a[able], b[able], least[able]
    if not once:
        return a, b
    joins = []
    for i in np.argsort(least, kind="stable"):
        one, two = label[a[i]], label[b[i]]
        if one != two:
            label[label == two] = one
            joins.append(i)
    joins = np.array(joins, np.int64)
    return a[joins], b[joins]


def sets_of(docs: DataFrame, prints: DataFrame, members: DataFrame, hashes: Callable[[str | None], np.ndarray], id: str, text: str) -> DataFrame:
    """(node, shingles): the sorted set of each node of ``members``, made anew from one of its texts, so that no
    set of a text without partner is ever stored or moved. ``prints`` has id, key (xxhash64 of the text) and
    node of every row; a null id counts as 0 here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [hashes(t.as_py()) for t in batch.column(1)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                flat = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["node", "shingles"])

    named = prints.select(F.coalesce("id", F.lit(0)).alias("id"), "key", "node").join(members.select("node").distinct(), "node", "left_semi")
    one = named.groupBy("node").agg(F.min("id").alias("id"), F.min_by("key", "id").alias("key"))
    texts = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    found = texts.join(one, ["id", "key"]).select("node", "text")
    return found.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both nodes, as ``<column>_a`` and ``<column>_b``. A node of very many pairs
    is a skewed partition of the second join, which adaptive execution splits."""
    one, two = (table.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
    return pairs.join(two, "b").join(one, "a")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share ``percent`` of a hundred or more of their union."""
    both = beside(pairs.select("a", "b"), sets, ["shingles"])
    counted = both.select(
        "a", "b", F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long").alias("common"),
        (F.size("shingles_a") + F.size("shingles_b")).cast("long").alias("sizes"),
    )
    return counted.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")


def _labelled(table: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``table`` with the group of a node; a node without links is a group of its own."""
    return table.join(labels.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _blocks(members: DataFrame, rows: int) -> DataFrame:
    """Shards of at most about twice ``rows`` members: a larger key is dealt to blocks by its nodes, and every
    two blocks, and each block alone, are a shard. Any two members of a key meet in one shard."""
    blocks = F.ceil(F.col("n") / rows).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("key", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other"))).select("key", "band", "node", "label", "side")


def members_of(postings: DataFrame) -> DataFrame:
    """(band, key, node, pivots, n) of the keys that two or more nodes share. ``postings`` has band, key and
    node; copies of a text are one posting, also before they are moved. The pivots are up to four members of the
    key, first and last by name and by a hash."""
    once = postings.distinct().repartition("key")
    hashed = F.xxhash64("node")
    pivots = [F.min("node"), F.max("node"), F.min_by("node", hashed), F.max_by("node", hashed)]
    shared = once.groupBy("key").agg(*(p.alias(f"p{i}") for i, p in enumerate(pivots)), F.count("*").alias("n")).where("n > 1")
    return once.join(shared.select("key", "n", F.array(*(f"p{i}" for i in range(len(pivots)))).alias("pivots")), "key")


def similar_groups(
    members: DataFrame, sets: DataFrame, star: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame, bool], DataFrame],
    percent: int, scratch: Scratch, shard_rows: int = 2048,
) -> DataFrame:
    """(node, root): the groups of all similar sets that share a key, joined by verified links; sets without a
    link are not in it. Stored in ``scratch``.

    ``star`` prunes pairs (a, b) by their sketches; ``search`` finds such pairs between different labels inside
    shards (key, band, node, label, side). First every member of a key meets its pivots: no more pairs than four
    times the members, and as a node has many keys they join most of a group. What is still between groups afterwards is
    searched twice: first for pairs that join labels of a shard once, fewer than its members, then, between the groups
    that are left, for all pairs, which are verified whole. No pair that the sketches let pass and that may be a link
    between groups is left out.
    """
    met = members.select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
    stars = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = scratch.store(verified(scratch.store(star(stars), "stars"), sets, percent), "links")
    labels = connected_components(links, scratch)
    for once in (True, False):
        named = scratch.store(_labelled(members.select("band", "key", "node"), labels, "node", "label"), "named")
        several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        shards = _blocks(named.join(several.select("key", "n"), "key"), shard_rows)
        found = scratch.store(search(shards, once), "pairs")
        new = scratch.store(verified(found, sets, percent), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = connected_components(links, scratch)
    return labels


def batches_of(values: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of one length as rows of ``width`` numbers."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(-1, width)


def tasks(df: DataFrame) -> int:
    """Partitions for rows that are few bytes but much work, which adaptive execution would join."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_batch(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """Pairs (a, b) with the smaller node first."""
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])
