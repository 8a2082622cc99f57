"""MinHash near-duplicates with sequential Bayesian verification.

Sets that share a band of their signatures are candidates. A candidate's signatures are compared batch by
batch; it is dropped once the posterior probability that the sets are similar enough is below a chosen
miss probability. Survivors are verified by their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import pairs
from tidemark.llm.common import Scratch, materialize, split_runs
from tidemark.llm.simhash import SEED, _mixed, shingle_hashes

#: Words of a shingle, and the hundredths of the union that linked sets share at least.
WIDTH, PERCENT = 4, 80
#: Lanes of a signature and of a batch of it; bands of its first lanes and lanes of a band. Sets at 0.8 share no
#: band with probability (1 - 0.8^5)^32, three in a million.
LANES, BATCH, BANDS, ROWS = 512, 32, 32, 5
#: Posterior probability of similarity below which a candidate is dropped.
MISS = 1e-4
#: Hashes, or candidates, handled at a time.
PIECE = 4096

_random = np.random.default_rng(SEED)
#: Odd multipliers of the lanes, for the low and the high half of a hash.
MULTIPLIERS = _random.integers(0, 1 << 32, (2, LANES), dtype=np.uint32) | np.uint32(1)


def signature(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The first ``lanes`` minima over a set of hashes, folded to 16 bits."""
    least = np.full(lanes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), PIECE):
        part = hashes[at : at + PIECE]
        low, high = part.astype(np.uint32)[:, None], (part >> np.uint64(32)).astype(np.uint32)[:, None]
        np.minimum(least, (low * MULTIPLIERS[0, :lanes] + high * MULTIPLIERS[1, :lanes]).min(axis=0), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature."""
    bands = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        keys = _mixed(keys ^ (bands[:, :, k] << np.uint64(8)), 1)
    return keys.view(np.int64)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Matching lanes that a candidate needs after each batch.

    With a uniform prior and m of k lanes equal, the posterior of the similarity is Beta(m + 1, k - m + 1).
    Its weight at t and above is the probability of at most m successes in k + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for k in range(BATCH, LANES + 1, BATCH):
        below = 0.0
        for m in range(k + 1):
            below += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if below >= miss:
                out.append(m)
                break
    return out


def surviving(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, matches) of the candidates (rows ``a`` of ``one``, ``b`` of ``two``) that no batch drops."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, enough in enumerate(least):
        lanes = slice(n * BATCH, (n + 1) * BATCH)
        here = np.concatenate([np.empty(0, np.int64), *(
            (one[a[part], lanes] == two[b[part], lanes]).sum(axis=1) for part in (left[at : at + PIECE] for at in range(0, len(left), PIECE)))])
        matches[left] += here
        left = left[matches[left] >= enough]
    return left, matches[left]


def with_bands(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, key, node, n, bands): xxhash64 of the text, a name of its set of shingles, their number, and the
    keys of the bands of its signature. Texts without a word have n = 0 and no band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(2)]
                size = np.array([len(s) for s in sets], np.int64)
                nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
                flat = pa.array(band_keys(np.array([signature(s, BANDS * ROWS) for s in sets if len(s)], np.uint16).reshape(-1, BANDS * ROWS)).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, (size > 0) * BANDS]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.array(size), bands],
                    names=["id", "key", "node", "n", "bands"],
                )

    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, "id long, key long, node long, n long, bands array<long>"
    )


def with_signatures(sets: DataFrame) -> DataFrame:
    """(node, n, sig, odd): size, signature and parities of sets (``node``, ``shingles``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                own = [s.values.to_numpy().view(np.uint64) for s in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([signature(s).tobytes() for s in own], pa.binary()),
                     pa.array([pairs.parities(s) for s in own], pa.binary())],
                    names=["node", "n", "sig", "odd"],
                )

    return sets.mapInArrow(run, "node long, n long, sig binary, odd binary")


def _sizes_allow(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def star(found: DataFrame, sketches: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """(a, b): the given pairs that survive all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                sizes = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                able = np.flatnonzero(_sizes_allow(*sizes, percent))
                one, two = (pairs.batches_of(batch.column(c), np.uint16, LANES) for c in ("sig_a", "sig_b"))
                left, _ = surviving(one, two, able, able, least)
                rows = batch.take(pa.array(able[left]))
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"])

    both = pairs.beside(found, sketches, ["n", "sig"])
    return both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def search(shards: DataFrame, once: bool, sketches: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """(a, b): all pairs of different labels in a shard that survive all batches and that the parities of the sets
    allow, each in the first band it shares only; with ``once``, those that join labels not joined in the shard before.
    In a shard of two sides only pairs across them count; other shards have the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in split_runs(batches, "key"):
            keys, nodes, labels, sides, bands, sizes = (
                table.column(c).to_numpy() for c in ("key", "node", "label", "side", "band", "n"))
            sigs = pairs.batches_of(table.column("sig"), np.uint16, LANES)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                own = slice(start, end)
                node, side, size, sig = (x[own] for x in (nodes, sides, sizes, sigs))
                label, odd = labels[own].copy(), table.column("odd").slice(start, end - start)
                across = side.min() < side.max()
                for at in range(0, end - start, 64):
                    ask = slice(at, at + 64)
                    open_ = (label[ask, None] != label) & (np.arange(end - start)[ask, None] < np.arange(end - start))
                    open_ &= _sizes_allow(size[ask, None], size, percent)
                    if across:
                        open_ &= side[ask, None] != side
                    a, b = np.nonzero(open_)
                    left, _ = surviving(sig, sig, a + at, b, least)
                    a, b = a[left] + at, b[left]
                    if len(a):
                        shared = (sig[a, : BANDS * ROWS] == sig[b, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
                        mine = shared.any(axis=1) & (shared.argmax(axis=1) == bands[start])
                        a, b = pairs.still_open(odd, size, label, a[mine], b[mine], percent, once)
                        if len(a):
                            yield pairs.as_batch(node[a], node[b])

    dealt = shards.join(sketches, "node").repartition(pairs.tasks(shards), "key").sortWithinPartitions("key")
    return dealt.select("key", "band", "node", "label", "side", "n", "sig", "odd").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, miss: float = MISS,
    shard_rows: int = 2048,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row. Documents whose sets of ``width``-word shingles share
    ``percent`` of a hundred or more of their union are linked; ``component_id`` is the smallest id reachable,
    and ``kept`` says whether it is the row's own.

    Texts of fewer words are one shingle, the whole sequence. Texts without a word, empty or null, have no
    shingle and are linked with nothing: their component is their own id. Equal sets are one node however
    many rows have them, rows without an id included; such rows have the component of the others or null, and
    are not kept unless all ids of the component are null. Repeated rows stay repeated; an empty table gives no
    rows. Sets are named by 64-bit hashes. Other columns are not read.

    Candidates that no band brings together (three in a million at 0.8, fewer above) or that ``miss`` drops
    are the only links that can be lost; of groups only those without another way. Intermediate tables are
    deleted before the result, which is stored, is returned.
    """
    scratch, least = Scratch(docs.sparkSession), least_matches(percent, miss)
    prints = scratch.store(with_bands(docs, id, text, width), "bands")
    members = scratch.store(pairs.members_of(prints.select("node", F.posexplode("bands").alias("band", "key"))), "members")
    sets = pairs.sets_of(docs, prints, members, lambda t: np.unique(shingle_hashes(t, width)), id, text)
    sets = scratch.store(sets, "sets")
    sketches = scratch.store(with_signatures(sets), "signatures")
    roots = pairs.similar_groups(
        members, sets, partial(star, sketches=sketches, percent=percent, least=least),
        partial(search, sketches=sketches, percent=percent, least=least), percent, scratch, shard_rows,
    )
    nodes = prints.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.store(named.join(component, "root").select("node", "component_id"), "components")
    slim = prints.select("id", "node", F.col("n").alias("n_shingles"))
    full = slim.where("n_shingles > 0").join(named, "node").unionByName(slim.where("n_shingles = 0").withColumn("component_id", F.col("id")))
    kind = docs.schema[id].dataType
    out = full.select(
        F.col("id").cast(kind).alias(id), "n_shingles", F.col("component_id").cast(kind).alias("component_id"),
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
    out = materialize(out, "near-duplicates")
    scratch.drop()
    return out

