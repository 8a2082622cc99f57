"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own context tree over the bytes before it. A node holds
how often the decision was 0 and 1 after its context; its Krichevsky-Trofimov estimate is mixed with the
product of its children's mixtures, half and half, which weighs all prunings of the tree. Counts come
from the training texts; a text's score sums the log probabilities of its bytes and of its end.

Nothing about the corpus is broadcast or sent to the driver but the two upper levels of the tree, whose
size the byte alphabet bounds. Texts are dealt into chunks; every chunk asks for the words and byte
strings that it contains, and gets their values in one co-grouped join.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, materialize
from tidemark.session import scratch_path

#: Bytes before a byte that the tree looks at.
DEPTH = 4
#: What stands before and after a text; UTF-8 never has this byte.
EDGE = 0xFF
#: Key of the end token among words, and text that is scored at a time.
END, BLOCK = 0, 1 << 22
#: Text bytes of a chunk, of which a task holds one.
CHUNK = 32 << 20
WORDS, GRAMS = 0, 1


# --- one block of texts -------------------------------------------------------------------------------


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def blocks(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about BLOCK characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + DEPTH + 1
        if size >= BLOCK:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): for every byte and the end of each text, it and the ``depth`` bytes before packed
    into one number; starts of the texts in that list."""
    edge = bytes([EDGE])
    raw = np.frombuffer(b"".join(edge * depth + t + edge for t in texts), np.uint8)
    keys = np.zeros(len(raw) - depth, np.int64)
    for k in range(depth + 1):
        keys = (keys << 8) | raw[k : len(raw) - depth + k]
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    # Windows that begin in one text and end in the next are not asked for.
    return keys[np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * depth, sizes)], starts


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


# --- counts of the chunks -----------------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, key, n): all words and byte strings of a chunk, with their number in training texts."""
    words: dict[int, tuple[Counter, set]] = {}
    strings: dict[int, list] = {}
    for batch in batches:
        chunks = batch.column(0).to_numpy()
        held = np.asarray(batch.column(1).to_pylist(), bool)
        texts = batch.column(2).to_pylist()
        for chunk, out in itertools.product(np.unique(chunks).tolist(), (False, True)):
            some = [lowered(texts[k]) for k in np.flatnonzero((chunks == chunk) & (held == out))]
            if not some:
                continue
            trained, seen = words.setdefault(chunk, (Counter(), set()))
            for t in some:
                seen.update(t.split()) if out else trained.update(t.split())
            trained[b""] += 0 if out else len(some)
            for part in blocks(some):
                keys, n = np.unique(grams(some[part], depth)[0], return_counts=True)
                strings.setdefault(chunk, []).append((keys, n * (not out)))
            if len(strings[chunk]) > 16:
                strings[chunk] = [_merged(strings[chunk])]
    for chunk, (trained, seen) in words.items():
        ends = trained.pop(b"", 0)
        names = [*trained, *(seen - trained.keys())]
        keys = np.r_[np.int64(END), word_keys(names)]
        n = np.r_[ends, np.fromiter(trained.values(), np.int64, len(trained)), np.zeros(len(names) - len(trained), np.int64)]
        yield _rows(chunk, WORDS, keys, n)
        yield _rows(chunk, GRAMS, *_merged(strings[chunk]))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _rows(chunk: int, kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, chunk, np.int64)), pa.array(np.full(size, kind, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))],
        names=["chunk", "kind", "key", "n"],
    )


# --- the tree -----------------------------------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def mixed(log_pe: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log mixture, weight of the node's own estimate)."""
    log_pw = np.logaddexp(log_pe, log_children) - math.log(2)
    return log_pw, np.exp(log_pe - math.log(2) - log_pw)


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, bit) of the eight decisions of the last byte, each (n, 8)."""
    byte = (keys & 0xFF)[:, None]
    k = np.arange(8)
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, tuple]:
    """Mix the levels from ``depth`` up to ``top`` for all byte strings that share their ``top`` latest
    context bytes with no string elsewhere. Returns the probability of each decision, NaN where level
    ``top`` has no count, and the nodes of that level: (id, zeros, ones, log mixture)."""
    prefix, bit = decisions(keys)
    weights = np.repeat(n[:, None], 8, axis=1)
    p = np.full(prefix.shape, np.nan)
    below = None
    for level in range(depth, top - 1, -1):
        context = (keys >> 8) & ((1 << 8 * level) - 1)
        ids, at = np.unique((context[:, None] << 8) | prefix, return_inverse=True)
        at = at.reshape(prefix.shape)
        ones = np.bincount(at.ravel(), (weights * bit).ravel(), len(ids))
        both = np.bincount(at.ravel(), weights.ravel(), len(ids))
        log_pe = log_kt(both - ones, ones)
        if below is None:
            log_pw, own = log_pe, np.ones(len(ids))
        else:
            low, low_pw = below
            parent = (((low >> 8) & ((1 << 8 * level) - 1)) << 8) | (low & 0xFF)
            log_pw, own = mixed(log_pe, np.bincount(np.searchsorted(ids, parent), low_pw, len(ids)))
        p = _step(p, np.where(bit, ones[at], (both - ones)[at]), both[at], own[at])
        below = ids, log_pw
    return p, (ids, both - ones, ones, log_pw)


def _step(p: np.ndarray, count: np.ndarray, both: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One level up: a node without counts says nothing, one without counted children speaks alone."""
    kt = (count + 0.5) / (both + 1.0)
    return np.where(both > 0, np.where(np.isnan(p), kt, own * kt + (1 - own) * p), np.nan)


class Upper:
    """Levels 1 and 0: at most 255 decisions after 256 bytes, and 255 after nothing."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_children: np.ndarray):
        self.levels = []
        for size in (1 << 16, 1 << 8):
            a, b, c = (np.bincount(ids, x, size) for x in (zeros, ones, log_children))
            log_pw, own = mixed(log_kt(a, b), c)
            self.levels.append((a, b, own))
            ids, zeros, ones, log_children = np.arange(size) & 0xFF, a, b, log_pw

    def log10(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        prefix, bit = decisions(keys)
        for (a, b, own), at in zip(self.levels, (((keys >> 8) & 0xFF)[:, None] << 8 | prefix, prefix)):
            p = _step(p, np.where(bit, b[at], a[at]), a[at] + b[at], own[at])
        return np.log10(np.where(np.isnan(p), 0.5, p)).sum(axis=1)


def gram_model(counts: DataFrame, depth: int, buckets: int = 64) -> DataFrame:
    """(key, value): the log10 probability of the last byte of each byte string after the others.

    Strings are dealt by their two latest context bytes, which closes the lower levels of the tree; the
    sums of level 2 give the upper levels.
    """
    top = 2
    totals = counts.groupBy("key").agg(F.sum("n").alias("n"))
    bucket = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(buckets))

    def lower(table: pa.Table) -> pa.Table:
        keys, n = table.column("key").to_numpy(), table.column("n").to_numpy().astype(float)
        p, (ids, zeros, ones, log_pw) = subtree(keys, n, depth, top)
        none = np.zeros(len(keys))
        packed = pa.array([x.tobytes() for x in p], pa.binary())
        strings = pa.table([pa.array(keys), packed, pa.array(none), pa.array(none), pa.array(none)], schema=shape)
        nodes = pa.table([pa.array(ids), pa.nulls(len(ids), pa.binary()), pa.array(zeros), pa.array(ones), pa.array(log_pw)], schema=shape)
        return pa.concat_tables([strings, nodes])

    shape = pa.schema([("key", pa.int64()), ("p", pa.binary()), ("zeros", pa.float64()), ("ones", pa.float64()), ("log_pw", pa.float64())])
    stored = materialize(
        totals.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lower, "key long, p binary, zeros double, ones double, log_pw double"),
        "tree",
    )
    nodes = (
        stored.where("p is null").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("id"))
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_pw").alias("log_pw")).toArrow()
    )  # 65,280 rows at most
    upper = Upper(nodes.column("id").to_numpy(), *(nodes.column(c).to_numpy() for c in ("zeros", "ones", "log_pw")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), float).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upper.log10(keys, p))], names=["key", "value"])

    return stored.where("p is not null").select("key", "p").mapInArrow(finish, "key long, value double")


# --- scores -------------------------------------------------------------------------------------------


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    if len(wanted) and (not len(keys) or at.max() >= len(keys) or (keys[at] != wanted).any()):
        raise ValueError("A chunk lacks values that its texts ask for")
    return values[at]


def _scores(docs: pa.Table, values: pa.Table, id: str, depth: int) -> Iterator[pa.Table]:
    kinds, keys, found = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
    order = np.lexsort((keys, kinds))
    cut = np.searchsorted(kinds[order], GRAMS)
    of = [(keys[o], found[o]) for o in (order[:cut], order[cut:])]
    texts = docs.column("text").to_pylist()
    for part in blocks(texts):
        some = [lowered(t) for t in texts[part]]
        place: dict[bytes, int] = {}
        lists = [[place.setdefault(w, len(place) + 1) for w in t.split()] for t in some]  # 0 is the end token
        counts = _looked_up(*of[WORDS], np.r_[np.int64(END), word_keys(list(place))])
        sizes = np.array([len(x) + 1 for x in lists])
        tokens = np.fromiter(itertools.chain.from_iterable((0, *x) for x in lists), np.int64, sizes.sum())
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        asked, begins = grams(some, depth)
        logs = _looked_up(*of[GRAMS], asked)
        yield pa.table(
            {
                id: docs.column(id).slice(part.start, len(some)),
                "held_out": docs.column("held").slice(part.start, len(some)),
                "n_tokens": pa.array(sizes.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)),
                "known_log": pa.array(np.add.reduceat(np.log10(counts + 1)[tokens], starts)),
                "score": pa.array(np.add.reduceat(logs, begins)),
                "n_bytes": pa.array(np.array([len(t) for t in some], np.int64)),
            }
        )


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Base and model scores of every whole text, learned from those whose crc32 of the id mod 7 is not 2.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score and ``bits_per_byte``, the
    code length by the model. A null text counts as empty and has its end only; a null id is the text
    ``null`` to crc32; repeated rows are learned from and scored as often as they come; no training text
    leaves every estimate at a half; an empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = max(1, 2 * split // CHUNK)  # texts take up to twice their files' bytes
    chunk = F.spark_partition_id().cast("long") * parts + F.pmod(F.xxhash64(F.col(id)), F.lit(parts))
    path = scratch_path(spark, "texts")
    docs.select(chunk.alias("chunk"), (crc_mod(F.col(id), 7) == 2).alias("held"), F.col(text).alias("text"), F.col(id)).write.option(
        "compression", "zstd"
    ).parquet(path)
    stored = spark.read.parquet(path)

    rows = materialize(
        stored.select("chunk", "held", "text").mapInArrow(lambda b: _counts(b, depth), "chunk long, kind int, key long, n long"), "counts"
    )
    words, strings = (rows.where(F.col("kind") == k) for k in (WORDS, GRAMS))
    same = Window.partitionBy("key")
    words = materialize(
        words.select(
            "chunk", "key", F.sum("n").over(same).alias("value"), (F.row_number().over(same.orderBy("chunk")) == 1).alias("first")
        ),
        "words",
    )
    known = words.where("first and value > 0").agg(
        F.count("*").alias("types"), F.coalesce(F.sum("value"), F.lit(0)).alias("tokens")
    ).first()
    strings = strings.select("chunk", "key").distinct().join(gram_model(strings, depth), "key")
    values = words.select("chunk", F.lit(WORDS).alias("kind"), "key", F.col("value").cast("double").alias("value")).unionByName(
        strings.select("chunk", F.lit(GRAMS).alias("kind"), "key", "value")
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(_scores(left, right, id, depth))
        return pa.concat_tables(parts) if parts else shape.empty_table()

    shape = pa.schema([
        (id, pa.null()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("known_log", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()),
    ])
    out = (
        stored.select("chunk", "held", "text", id).groupBy("chunk").cogroup(values.groupBy("chunk"))
        .applyInArrow(run, f"`{id}` {kind}, held_out boolean, n_tokens long, n_known long, known_log double, score double, n_bytes long")
    )
    log_all = math.log10(known["tokens"] + known["types"] + 1)
    return out.select(
        id, "held_out", "n_tokens", "n_known", F.lit(known["tokens"]).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
