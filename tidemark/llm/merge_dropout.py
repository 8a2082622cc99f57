"""Encoding by merges with seeded dropout, and exact decoding.

A text is cut into segments that no piece of the vocabulary crosses. Merges of a segment are done from
an agenda: the candidate pair of the best rank first, the leftmost of equals. With dropout a candidate
is skipped if a hash of (seed, row, place of the segment, place, pair) falls below the rate, so a rerun skips
the same ones, and repeated rows are numbered, so each has merges of its own. Segments of equal length are
merged together, one agenda step of all of them at a time.
Characters outside the vocabulary, and the vocabulary's own space mark, become bytes, so decoding gives
back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A word with the spaces before it, a line end, or spaces alone.
SEGMENT = re.compile(r" *[^ \n]+|\n| +")
#: Segments whose pieces a task keeps, and the length up to which segments are merged together.
HELD, LONG = 400_000, 512
NONE = np.int64(-1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A keyed step of hashing: spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def skips(key, hashed, rate: float) -> np.ndarray:
    """Whether candidates, by the hashes of their place and pair, are skipped under a key."""
    return (mix64(key ^ hashed) >> np.uint64(11)).astype(float) * 2.0**-53 < rate


class Vocabulary:
    """Pieces, their merges by rank, and the byte pieces. Its size is fixed, so tasks get it whole."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int], plain: list[bool]):
        number = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.char = {p: i for p, i in number.items() if len(p) == 1 and p != MARK}
        self.mark, self.bytes_at, self.size = number[MARK], bytes_at, len(pieces)
        codes = sorted([(ord(c), i) for c, i in self.char.items()] + [(ord(" "), self.mark)])
        self.codes, self.of_code = (np.array([x[k] for x in codes], t) for k, t in ((0, np.uint32), (1, np.int64)))
        order = sorted((i for i in number.values()), key=lambda i: (-scores[i], i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = sorted(
            (number[p[:k]] * self.size + number[p[k:]], rank[i], i)
            for p, i in number.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        )
        self.pair, self.rank, self.merged = (np.array([x[c] for x in pairs] or [-1], np.int64) for c in range(3))
        raw = {b: bytes([k]) for k, b in enumerate(bytes_at)}
        self.raw = [raw.get(i, p.replace(MARK, " ").encode()) if plain[i] or i in raw else b"" for i, p in enumerate(pieces)]
        crossing = [p for p in number if len(SEGMENT.findall(p.replace(MARK, " "))) != 1]
        if crossing:
            raise ValueError(f"Pieces that cross segments: {crossing[:5]}")

    @staticmethod
    def load(path: str = PIECES) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        if m.piece_to_id("<0x00>") == m.unk_id():
            raise ValueError("The vocabulary has no byte pieces, so decoding could not be exact")
        return Vocabulary(
            [m.id_to_piece(i) for i in every], [m.get_score(i) for i in every], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
            [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)) for i in every],
        )

    def symbols(self, segment: str) -> list[int]:
        """Pieces of the characters, bytes for those without."""
        out = []
        for c in segment:
            piece = self.mark if c == " " else self.char.get(c)
            if piece is None:
                out += [self.bytes_at[b] for b in c.encode("utf-8", "surrogatepass")]
            else:
                out.append(piece)
        return out

    @staticmethod
    def _hash(start, pair) -> np.ndarray:
        return mix64((start.astype(np.uint64) << np.uint64(48)) ^ pair.astype(np.uint64))

    def _candidates(self, left, right, start, key, rate) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs; a rank past all others if there is no merge or it is skipped."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        rank = np.where(self.pair[at] == pair, self.rank[at], self.size)
        if rate > 0:
            rank = np.where(skips(key, self._hash(start, pair), rate), self.size, rank)
        return rank, self.merged[at]

    def _together(self, rows: np.ndarray, keys: np.ndarray, rate: float, popped: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, pieces) of segments with equally many symbols, (n, width). Each step pops the best
        candidate of every segment; segments whose agenda is empty are done. ``popped`` gets (row numbers, hash of
        place and pair) of each step."""
        number, start = np.arange(len(rows)), np.tile(np.arange(rows.shape[1]), (len(rows), 1))
        key = keys[:, None]
        rank, into = self._candidates(rows[:, :-1], rows[:, 1:], start[:, :-1], key, rate)
        while True:
            alive = (rank < self.size).any(axis=1) if rank.shape[1] else np.zeros(len(rows), bool)
            if not alive.all():
                yield number[~alive], rows[~alive]
                number, rows, start, rank, into, key = (x[alive] for x in (number, rows, start, rank, into, key))
            if not len(rows):
                return
            n, width = rows.shape
            each, best = np.arange(n), rank.argmin(axis=1)
            new = into[each, best]
            if popped is not None:
                popped.append((number, self._hash(start[each, best], rows[each, best] * self.size + rows[each, best + 1])))
            rows[each, best] = new
            keep = np.arange(width)[None, :] != (best + 1)[:, None]
            rows, start = rows[keep].reshape(n, width - 1), start[keep].reshape(n, width - 1)
            keep = np.arange(width - 1)[None, :] != best[:, None]
            rank, into = rank[keep].reshape(n, width - 2), into[keep].reshape(n, width - 2)
            for side in (best - 1, best):  # the pairs beside the merged piece are new candidates
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                at = side[ok]
                rank[ok, at], into[ok, at] = self._candidates(rows[ok, at], rows[ok, at + 1], start[ok, at], key[ok, 0], rate)

    def _alone(self, symbols: list[int], key: int, rate: float) -> list[int]:
        """The same agenda for one long segment, with a heap: memory and time in proportion to its length."""
        import heapq

        n = len(symbols)
        sym, before, after = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        keys = np.array([key], np.uint64)

        def push(left: int, right: int) -> None:
            if left < 0 or right < 0:
                return
            pair = np.array([sym[left]], np.int64), np.array([sym[right]], np.int64)
            rank, into = self._candidates(*pair, np.array([left]) % 65536, keys, rate)
            if rank[0] < self.size:
                heapq.heappush(agenda, (int(rank[0]), left, right, sym[left], sym[right], int(into[0])))

        first = np.array(symbols, np.int64)
        rank, into = self._candidates(first[:-1], first[1:], np.arange(n - 1) % 65536, keys, rate)
        agenda = [(int(rank[k]), int(k), int(k) + 1, sym[k], sym[k + 1], int(into[k])) for k in np.flatnonzero(rank < self.size)]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, a, b, new = heapq.heappop(agenda)
            if sym[left] != a or sym[right] != b or after[left] != right:
                continue
            sym[left], sym[right], after[left] = new, -1, after[right]
            if after[right] >= 0:
                before[after[right]] = left
            push(before[left], left)
            push(left, after[left])
        return [s for s in sym if s >= 0]

    def _flat_symbols(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all segments one after another, with starts and sizes."""
        sizes = np.array([len(s) for s in segments])
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.codes, chars), len(self.codes) - 1)
        flat = np.where(self.codes[at] == chars, self.of_code[at], NONE)
        starts = np.cumsum(sizes) - sizes
        odd = np.unique(np.repeat(np.arange(len(segments)), sizes)[flat < 0])  # with characters that become bytes
        more, end = [flat], len(flat)
        for k in odd.tolist():
            more.append(np.array(self.symbols(segments[k]), np.int64))
            starts[k], sizes[k] = end, len(more[-1])
            end += sizes[k]
        return np.concatenate(more), starts, sizes

    def encode_segments(self, segments: list[str], keys: np.ndarray, rate: float, popped: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of all segments, starts, sizes). ``popped`` gets (segment numbers, hashes) of the merges done of
        segments of up to LONG symbols."""
        symbols, at, long = self._flat_symbols(segments)
        starts, sizes, out, end = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64), [np.empty(0, np.int32)], 0

        def add(which: np.ndarray, pieces: np.ndarray) -> None:
            nonlocal end
            starts[which], sizes[which] = end + np.arange(len(which)) * pieces.shape[1], pieces.shape[1]
            out.append(pieces.astype(np.int32).ravel())
            end += pieces.size

        for size in np.unique(long).tolist():
            which = np.flatnonzero(long == size)
            if size > LONG:
                for k in which.tolist():
                    alone = self._alone(symbols[at[k] : at[k] + size].tolist(), int(keys[k]), rate)
                    add(np.array([k]), np.array([alone]))
                continue
            for some in np.array_split(which, -(-len(which) // 50_000)):
                steps = None if popped is None else []
                for number, pieces in self._together(symbols[at[some][:, None] + np.arange(size)], keys[some], rate, steps):
                    add(some[number], pieces)
                if steps:
                    popped += [(some[number], hashed) for number, hashed in steps]
        return np.concatenate(out), starts, sizes

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def segments_of(text: str) -> list[str]:
    """The text with one space before it, cut where no piece crosses."""
    return SEGMENT.findall(" " + text) if text else []


class Encoder:
    """Encodes texts, remembering the plain merges of up to about ``held`` segments.

    A segment under a key has its plain pieces if the key skips none of the plain merges; else it is merged anew.
    """

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int, held: int = HELD):
        self.v, self.rate, self.seed, self.held = vocabulary, rate, seed, held
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.merges, self.long = np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, bool)
        self.starts, self.sizes, self.merge_starts, self.merge_sizes = (np.empty(0, np.int64) for _ in range(4))

    def _learn(self, new: list[str]) -> None:
        popped: list = []
        long = np.array([len(s.encode("utf-8", "surrogatepass")) > LONG for s in new])
        flat, starts, sizes = self.v.encode_segments(new, np.zeros(len(new), np.uint64), 0, popped)
        who = np.concatenate([np.empty(0, np.int64), *(n for n, _ in popped)])
        hashed = np.concatenate([np.empty(0, np.uint64), *(h for _, h in popped)])[np.argsort(who, kind="stable")]
        counts = np.bincount(who, minlength=len(new))
        self.starts, self.sizes = np.r_[self.starts, len(self.flat) + starts], np.r_[self.sizes, sizes]
        self.merge_starts = np.r_[self.merge_starts, len(self.merges) + np.cumsum(counts) - counts]
        self.merge_sizes, self.long = np.r_[self.merge_sizes, counts], np.r_[self.long, long]
        self.flat, self.merges = np.concatenate([self.flat, flat]), np.concatenate([self.merges, hashed])

    def _dropped(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether each segment, under its key, must be merged anew."""
        out = self.long[at] if self.rate > 0 else np.zeros(len(at), bool)
        for low in range(0, len(at) if self.rate > 0 else 0, 1 << 18):
            some = slice(low, low + (1 << 18))
            sizes = self.merge_sizes[at[some]]
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(len(row)) - (ends - sizes)[row]
            hit = skips(keys[some][row], self.merges[self.merge_starts[at[some]][row] + inside], self.rate)
            out[some] |= np.bincount(row[hit], minlength=len(sizes)) > 0
        return out

    def encode(self, texts: list[str | None], names: list) -> list[np.ndarray]:
        """Pieces of each text. Which merges are skipped depends on the seed, the text's name and the segment's place in it."""
        if len(self.place) > self.held:
            self._forget()
        every, at, keys, new, ends = [], [], [np.empty(0, np.uint64)], [], [0]
        for text, name in zip(texts, names):
            found = segments_of(text or "")
            base = np.uint64(xxhash.xxh64_intdigest(repr(name), seed=self.seed))
            with np.errstate(over="ignore"):
                keys.append(mix64(base + np.arange(len(found), dtype=np.uint64)))
            for s in found:
                k = self.place.get(s)
                if k is None:
                    k = self.place[s] = len(self.place)
                    new.append(s)
                at.append(k)
            every += found
            ends.append(len(every))
        if new:
            self._learn(new)
        at, keys = np.array(at, np.int64), np.concatenate(keys)
        again = np.flatnonzero(self._dropped(at, keys))
        starts, sizes, flat = self.starts[at], self.sizes[at], self.flat
        if len(again):
            more, begin, sizes[again] = self.v.encode_segments([every[k] for k in again.tolist()], keys[again], self.rate)
            starts[again] = len(flat) + begin
            flat = np.concatenate([flat, more])
        out = []
        for low, high in zip(ends, ends[1:]):
            n = sizes[low:high]
            to = np.cumsum(n)
            inside = np.arange(to[-1] if len(to) else 0) - np.repeat(to - n, n)
            out.append(flat[np.repeat(starts[low:high], n) + inside])
        return out


def encoded(
    docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = PIECES, rate: float = 0.1, seed: int = 7,
    prefix: str = "",
) -> DataFrame:
    """All columns of ``docs`` with ``pieces`` (array of int), ``n_pieces``, ``decoded_sha256`` and ``lossless``.

    ``rate`` is the share of candidate merges that is skipped; 0 gives the vocabulary's plain encoding.
    The digest and the test are of the text decoded from the pieces. Null and empty texts have no pieces; a
    null text stays null and its digest too; repeats of an id and text are numbered (the repeats of one text are
    one task's work), and each has pieces of its own; an empty table gives no rows. ``prefix`` goes
    before the new columns' names where ``docs`` has such columns already.
    """
    vocabulary = Vocabulary.load(path)
    new = [prefix + c for c in ("pieces", "n_pieces", "decoded_sha256", "lossless")]
    clash = set(new) & set(docs.columns)
    if clash:
        raise ValueError(f"Columns exist: {sorted(clash)}; give a prefix")
    names = [*docs.columns, *new]
    t, width = docs.columns.index(text), len(docs.columns)
    same = [F.col(id), F.xxhash64(text)]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    named = docs.withColumn("__copy", copy).withColumn("__copy", F.xxhash64(*same, "__copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, rate, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(t).to_pylist()
                pieces = encoder.encode(texts, batch.column(width).to_pylist())
                back = [vocabulary.decode(p.tolist()) if x is not None else None for x, p in zip(texts, pieces)]
                ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *pieces])))
                digest = [None if x is None else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], ids, pa.array(np.diff(ends), pa.int32()), pa.array(digest, pa.string()), pa.array([x == y for x, y in zip(texts, back)])],
                    names=names,
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return named.mapInArrow(run, f"{kinds}, `{new[0]}` array<int>, `{new[1]}` int, `{new[2]}` string, `{new[3]}` boolean")
