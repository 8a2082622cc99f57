"""SimHash fingerprints, their links found in BK-trees, and the groups of linked documents."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import pairs
from tidemark.llm.bktree import BKTree, forest
from tidemark.llm.common import Scratch, materialize, split_runs
from tidemark.llm.components import connected_components

SEED = 42
#: Shingles turned into bits at a time.
PIECE = 1 << 18


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of all shingles of a text, repeats included. Only A-Z are lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space and letters only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= width:
        shingles, n = [b" ".join(found)], 1
    else:
        shingles, n = map(b" ".join, zip(*(found[i:] for i in range(width)))), len(found) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, n)


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits of each hash, for wider fingerprints; lane 0 is the hash itself."""
    if lane == 0:
        return hashes
    x = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """One uint64 a lane: a bit is 1 if it is set in over half the hashes; none give zero."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), PIECE):
            part = _mixed(hashes[at : at + PIECE], lane).astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return out


def with_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every whole text as a long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t.as_py(), width))[0] for t in batch.column(1)]
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=[id, "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, fp long")


# --- shards -----------------------------------------------------------------------------------------


def _block(fp: Column, k: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, k * bits).bitwiseAND((1 << bits) - 1)


def pair_shards(fp: Column) -> Column:
    """Six shard keys: fingerprints within two bits agree in two of four blocks of 16 bits at least."""
    both = itertools.combinations(range(4), 2)
    return F.array(
        *(
            F.lit(n << 32).bitwiseOR(F.shiftleft(_block(fp, i, 16), 16)).bitwiseOR(_block(fp, j, 16))
            for n, (i, j) in enumerate(both)
        )
    )


def _finer(fp: Column, key: Column) -> Column:
    """Three keys in place of one of ``pair_shards``: the other 32 bits in parts of 11, 11 and 10, of which
    two bits leave one alone. At most 2^22 fingerprints share such a key, however large the corpus."""
    rest = F.lit(None).cast("long")
    for n, pair in enumerate(itertools.combinations(range(4), 2)):
        i, j = (k for k in range(4) if k not in pair)
        both = F.shiftleft(_block(fp, i, 16), 16).bitwiseOR(_block(fp, j, 16))
        rest = F.when(F.shiftrightunsigned(key, 32) == n, both).otherwise(rest)
    parts = [(0, 11), (11, 11), (22, 10)]
    return F.array(
        *(
            F.xxhash64(key, F.lit(n), F.shiftrightunsigned(rest, at).bitwiseAND((1 << bits) - 1))
            for n, (at, bits) in enumerate(parts)
        )
    )


def tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that span the groups within every shard, each searched in the BK-tree of its shard.

    ``shards`` has ``key``, a node ``id`` (long) and ``bits`` (binary, 8 bytes a word). A shard's tree is
    built in the task that holds its rows: nothing is broadcast, and only one shard is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in split_runs(batches, "key"):
            keys = table.column("key").to_numpy()
            ids = table.column("id").to_numpy()
            width = len(table.column("bits")[0].as_py()) // 8
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, width)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1) <= radius]
            a, b = [ids[near]], [ids[near + 1]]
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                links = forest(bits[start : start + size], radius)
                if links:
                    x, y = np.array(links).T
                    a.append(ids[start + x])
                    b.append(ids[start + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return shards.repartition("key").sortWithinPartitions("key").select("key", "id", "bits").mapInArrow(run, "a long, b long")


def fingerprint_links(prints: DataFrame, shard_rows: int = 4096) -> DataFrame:
    """(a, b) links that span all groups of distinct fingerprints ``fp`` within two differing bits.

    Complete for a radius of 2. Shards of over ``shard_rows`` fingerprints are divided further, exactly.
    """
    keyed = prints.select("fp", F.explode(pair_shards(F.col("fp"))).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(crowded, "key").select(
        F.col("fp").alias("id"),
        F.explode(F.when(F.col("n") > shard_rows, _finer(F.col("fp"), F.col("key"))).otherwise(F.array("key"))).alias("key"),
        _little(F.col("fp")).alias("bits"),
    )
    return tree_links(keyed, 2)


def _little(fp: Column) -> Column:
    """The eight bytes of a long; their order does not matter to Hamming distances."""
    return F.to_binary(F.lpad(F.hex(fp), 16, "0"), F.lit("hex"))


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row: fingerprints link at two or fewer differing bits,
    and ``component_id`` is the smallest id reachable over links, its own included.

    Rows with equal fingerprints are one node, so a group of copies costs one row after the first
    aggregation. Null and empty texts have fingerprint zero and link like any other; repeated rows stay
    repeated; an empty table gives no rows.
    """
    prints = materialize(with_fingerprints(docs, id, text, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(id).alias("least"))
    roots = connected_components(fingerprint_links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select(
        id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near duplicates of a stated similarity -----------------------------------------------------------

#: Words of a shingle, hundredths of the union that near duplicates share at least, bands and bins of a band in
#: a sketch, and lanes of 64 bits in a wide fingerprint.
WIDTH, PERCENT, BANDS, BINS, LANES = 5, 80, 32, 6, 32
#: Bits of 2,048 in which fingerprints may differ before sets are compared: 4 standard deviations above the mean
#: distance at a Jaccard similarity of 0.8, for sets of fewer than SMALL shingles and for others (simulated).
RADIUS_SMALL, RADIUS, SMALL = 450, 370, 20


def sketch(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: the least hash of each bin, BINS of them in a key. An empty bin
    borrows from the next full one. Sets of similarity s share a key with probability s ** BINS."""
    bins = BANDS * BINS
    if not len(hashes):
        return np.arange(BANDS, dtype=np.int64)
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(bin_of.astype(np.int64), return_index=True)  # hashes are sorted
    at = np.searchsorted(full, np.arange(bins))
    lent = at % len(full)
    value = hashes[first[lent]] + ((full[lent] - np.arange(bins)) % bins).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in value.reshape(BANDS, BINS).T:
        keys = _mixed(keys ^ column, 1)
    return keys.view(np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def with_sketches(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, key, node, bands): xxhash64 of the text, a name of its set of shingles, and the set's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(t.as_py()) for t in batch.column(2)]
                nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
                bands = pa.array(np.concatenate([np.empty(0, np.int64), *map(sketch, sets)]))
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.ListArray.from_arrays(ends, bands)],
                    names=["id", "key", "node", "bands"],
                )

    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("key"), text).mapInArrow(
        run, "id long, key long, node long, bands array<long>"
    )


def with_wide_fingerprints(sets: DataFrame) -> DataFrame:
    """(node, n, bits, sketch, odd): size, fingerprint of LANES words, sketch and parities of sets (``node``, ``shingles``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                own = [s.values.to_numpy().view(np.uint64) for s in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in own], pa.int64()),
                     pa.array([fingerprint(s, LANES).tobytes() for s in own], pa.binary()), pa.array([sketch(s).tobytes() for s in own], pa.binary()),
                     pa.array([pairs.parities(s) for s in own], pa.binary())],
                    names=["node", "n", "bits", "sketch", "odd"],
                )

    return sets.mapInArrow(run, "node long, n long, bits binary, sketch binary, odd binary")


def _alike(n: np.ndarray, m: np.ndarray, distance: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and distances leave open that two sets are near duplicates."""
    near = distance <= np.where(np.minimum(n, m) < SMALL, RADIUS_SMALL, RADIUS)
    return near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def near_pairs(found: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """(a, b): the given pairs whose fingerprints are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                one, two = (pairs.batches_of(batch.column(c), np.uint64, LANES) for c in ("bits_a", "bits_b"))
                distance = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(_alike(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), distance, percent))
                rows = batch.take(pa.array(near))
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"])

    both = pairs.beside(found, prints, ["n", "bits"])
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def tree_pairs(shards: DataFrame, once: bool, prints: DataFrame, percent: int) -> DataFrame:
    """(a, b): all near pairs of different labels in every shard that the parities of the sets allow, searched in the
    shard's BK-tree, each in the first band that the two sketches share only; with ``once``, those that join labels not
    joined in the shard before. In a shard of two sides only pairs across them count, as other shards have the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in split_runs(batches, "key"):
            keys, nodes, labels, sides, bands, sizes = (table.column(c).to_numpy() for c in ("key", "node", "label", "side", "band", "n"))
            bits = pairs.batches_of(table.column("bits"), np.uint64, LANES)
            sketches = pairs.batches_of(table.column("sketch"), np.int64, BANDS)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                own = slice(start, end)
                tree, across = BKTree(bits[own]), sides[own].min() < sides[own].max()
                node, side, n, keyed = (x[own] for x in (nodes, sides, sizes, sketches))
                label, odd = labels[own].copy(), table.column("odd").slice(start, end - start)
                for at in range(0, end - start, 256):
                    for q, m in tree.search(tree.prints[at : at + 256], RADIUS_SMALL):
                        q = q + at
                        take = (q < m) & (label[q] != label[m])
                        if across:
                            take &= side[q] != side[m]
                        q, m = q[take], m[take]
                        distance = np.bitwise_count(tree.prints[q] ^ tree.prints[m]).sum(axis=1, dtype=np.int64)
                        take = _alike(n[q], n[m], distance, percent) & ((keyed[q] == keyed[m]).argmax(axis=1) == bands[start])
                        if take.any():
                            q, m = pairs.still_open(odd, n, label, q[take], m[take], percent, once)
                            yield pairs.as_batch(node[q], node[m])

    dealt = shards.join(prints, "node").repartition(pairs.tasks(shards), "key").sortWithinPartitions("key")
    return dealt.select("key", "band", "node", "label", "side", "n", "bits", "sketch", "odd").mapInArrow(run, "a long, b long")


def deduplicated(
    docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, shard_rows: int = 2048,
) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles that share ``percent`` of a hundred or
    more of their union), the one with the smallest id.

    Texts meet under the BANDS keys of the sketches of their shingles. Pairs whose SimHash fingerprints are near
    are verified by the sets of shingles; pairs of crowded keys are found in BK-trees, and keys of over
    ``shard_rows`` texts are dealt to blocks that meet two by two.

    Texts without a word are one group. Rows without an id stay; repeated rows become one; rows of one id
    with different texts are different documents; an empty table gives no rows. Columns stay. Intermediate
    tables are deleted before the result is returned, but for the list of kept rows.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.store(with_sketches(docs, id, text).where("id is not null"), "sketches")
    members = scratch.store(pairs.members_of(prints.select("node", F.posexplode("bands").alias("band", "key"))), "members")
    sets = scratch.store(pairs.sets_of(docs, prints, members, shingle_set, id, text), "sets")
    wide = scratch.store(with_wide_fingerprints(sets), "fingerprints")
    roots = pairs.similar_groups(
        members, sets, partial(near_pairs, prints=wide, percent=percent), partial(tree_pairs, prints=wide, percent=percent),
        percent, scratch, shard_rows,
    )
    # Nodes are distinct sets. Two of them may have one least id, when an id has two texts.
    nodes = prints.groupBy("node").agg(F.min("id").alias("id"))
    named = scratch.store(nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    slim = prints.select("id", "key", "node")
    kept = slim.join(named.join(least, "root").select("node", "root", "least"), "node").where("id = least")
    # A group's least id may have several texts in the group; the first by key stays.
    kept = kept.groupBy("root", F.col("id").alias("__id")).agg(F.min("key").alias("__key")).select("__id", "__key")
    kept = materialize(kept, "kept")
    scratch.drop()
    keyed_docs = docs.withColumn("__id", F.col(id).cast("long")).withColumn("__key", F.xxhash64(text))
    one = keyed_docs.where("__id is not null").join(kept, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return one.unionByName(keyed_docs.where("__id is null")).select(*docs.columns)
