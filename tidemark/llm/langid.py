"""Language identification by unigram pieces whose segmentation is summed out.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word
is the sum over all ways to cut it into pieces (the forward algorithm), that of a text the product over
its words. Probabilities are fitted by expectation-maximisation with the same forward sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, materialize

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
START = "▁"
#: Probability of a character that no piece covers, and what is added to every expected count.
FLOOR, SMOOTH = 1e-7, 0.01
#: Words longer than this are scored alone, with a scale at each place; shorter ones in arrays.
LONG = 48
#: Factor per character that keeps the forward sums of words up to LONG characters within doubles: a character
#: costs 1e-10 at worst, so sums lie between 1e-240 and 1e240.
SCALE = 1e5
#: Word scores that a task keeps, and words it scores at a time.
HELD, CHUNK = 200_000, 20_000

LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary: the number of each piece, and -2 for what only begins one."""

    def __init__(self, texts: list[str]):
        self.number = {t[:k]: -2 for t in texts for k in range(1, len(t))} | {t: i for i, t in enumerate(texts)}
        self.size = len(texts)
        self.reach = max(map(len, texts), default=1)
        # The same as a trie in arrays: an edge is (node, character), packed and sorted, node 0 the root.
        node = {"": 0} | {t: k for k, t in enumerate(sorted(self.number), 1)}
        edges = sorted((node[t[:-1]] << 21 | ord(t[-1]), k) for t, k in node.items() if t)
        self.edges = np.array([e for e, _ in edges] or [-1], np.int64)
        self.into = np.array([k for _, k in edges] or [0], np.int64)
        self.piece = np.array([self.number.get(t, -2) for t in node], np.int64)

    @staticmethod
    def load(path: str = PIECES) -> Pieces:
        """Read on the driver; tasks get the object, whose size the vocabulary bounds."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        return Pieces([model.id_to_piece(i) for i in plain])

    def matches(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece in a word; a place that no one-character piece covers gets piece -1."""
        out, n, number = [], len(word), self.number.get
        for i in range(n):
            j = i + 1
            piece = number(word[i:j])
            if piece is None or piece < 0:
                out.append((i, j, -1))
            while piece is not None:
                if piece >= 0:
                    out.append((i, j, piece))
                j += 1
                if j > n:
                    break
                piece = number(word[i:j])
        return out


def spans_of(words: list[str], pieces: Pieces) -> tuple[np.ndarray, ...]:
    """(word, start, end, piece) of all matches, sorted by end and start: all places of all words walk
    down the trie together, one character a step."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    last = np.repeat(np.cumsum(size), size)
    begin = last - np.repeat(size, size)
    at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
    for k in range(pieces.reach):
        inside = at + k < last[at]
        at, node = at[inside], node[inside]
        key = node << 21 | chars[at + k]
        edge = np.minimum(np.searchsorted(pieces.edges, key), len(pieces.edges) - 1)
        on = pieces.edges[edge] == key
        if k == 0:  # no piece of one character: uncovered
            bare = at[~on | (pieces.piece[pieces.into[edge]] < 0)]
            found.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1)))
        at, node = at[on], pieces.into[edge[on]]
        piece = pieces.piece[node]
        whole = piece >= 0
        found.append((at[whole], np.full(whole.sum(), k + 1), piece[whole]))
        if not len(at):
            break
    at, length, piece = (np.concatenate(x) for x in zip(*found))
    start = at - begin[at]
    order = np.argsort((start + length) << 32 | start, kind="stable")
    return tuple(x[order] for x in (word[at], start, start + length, piece))


def _edges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal (end, start): within a run no word comes twice."""
    change = np.flatnonzero((start[1:] != start[:-1]) | (end[1:] != end[:-1])) + 1
    return np.r_[0, change, len(start)] if len(start) else np.zeros(1, np.int64)


def forward(words: list[str], pieces: Pieces, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """alpha[word, place, language] of words up to LONG characters, times SCALE for each character, and the
    matches. The last row of ``table`` (pieces + 1, languages) is for what no piece covers, so piece -1 finds it."""
    w, i, j, p = spans_of(words, pieces)
    alpha = np.zeros((len(words), max(map(len, words), default=0) + 1, table.shape[1]))
    alpha[:, 0] = 1
    bounds = _edges(i, j)
    for a, b in zip(bounds[:-1], bounds[1:]):
        alpha[w[a:b], j[a]] += alpha[w[a:b], i[a]] * (table[p[a:b]] * SCALE ** float(j[a] - i[a]))
    ends = alpha[np.arange(len(words)), [len(x) for x in words]]
    return alpha, ends, (w, i, j, p, bounds)


def long_score(word: str, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length, rescaled at each place."""
    at = [[] for _ in range(len(word) + 1)]
    for i, j, p in pieces.matches(word):
        at[j].append((i, p))
    log, alpha = np.zeros(table.shape[1]), {0: np.ones(table.shape[1])}
    for j in range(1, len(word) + 1):
        here = sum(alpha[i] * table[p] for i, p in at[j])
        alpha[j] = here
        alpha.pop(j - pieces.reach - 1, None)
        scale = np.maximum(here, 1e-300)
        if j % 8 == 0:
            log += np.log(scale)
            alpha = {k: v / scale for k, v in alpha.items()}
    return log + np.log(np.maximum(alpha[len(word)], 1e-300))


def log_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """(words, languages) log probabilities."""
    out = np.empty((len(words), table.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    for size in range(0, len(short), 20_000):
        some = short[size : size + 20_000]
        _, ends, _ = forward([words[k] for k in some], pieces, table)
        out[some] = np.log(ends) - np.log(SCALE) * np.array([[len(words[k])] for k in some], float)
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = long_score(w, pieces, table)
    return out


def text_words(text: str | None) -> Iterator[str]:
    """Runs of letters in lower case, as the vocabulary writes words; runs of numerals alone are none."""
    found = (m[0] for m in LETTERS.finditer((text or "").lower()))
    return (START + w for w in found if w.isalpha() or any(map(str.isalpha, w)))


# --- fitting ----------------------------------------------------------------------------------------


def _expected(words: Counter, pieces: Pieces, table: np.ndarray, k: int) -> np.ndarray:
    """Expected uses of each piece in words with counts, under the probabilities of language ``k``."""
    out = np.zeros(len(table))
    names = sorted(w for w in words if len(w) <= LONG)  # one order of sums
    for at in range(0, len(names), 20_000):
        some = names[at : at + 20_000]
        alpha, ends, (w, i, j, p, bounds) = forward(some, pieces, table[:, k : k + 1])
        beta = np.zeros(alpha.shape[:2])
        beta[np.arange(len(some)), [len(x) for x in some]] = 1
        prob = table[:, k]
        for a, b in zip(bounds[-2::-1], bounds[:0:-1]):
            beta[w[a:b], i[a]] += beta[w[a:b], j[a]] * (prob[p[a:b]] * SCALE ** float(j[a] - i[a]))
        times = np.array([words[x] for x in some], float) / ends[:, 0]
        # beta of a place is complete once all matches that start there are added: they end later.
        np.add.at(out, p, alpha[w, i, 0] * (prob[p] * SCALE ** (j - i).astype(float)) * beta[w, j] * times[w])
    return out


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, prior: np.ndarray, pieces: Pieces):
        self.languages, self.table, self.prior, self.pieces = languages, table, prior, pieces


def _normal(counts: np.ndarray) -> np.ndarray:
    counts = counts + SMOOTH
    counts[-1] = 0
    table = counts / counts.sum(axis=0)
    table[-1] = FLOOR
    return table


def fit(
    labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    pieces: Pieces | None = None, fit_rows: int = 8000, rounds: int = 2, seed: int = 11,
) -> Model:
    """Fit piece probabilities by ``rounds`` of expectation-maximisation.

    About ``fit_rows`` documents are used, chosen by a hash of the id: a bounded sample, whatever the
    table's size. They are stored once. Priors are counted over all labelled rows. Each round is one job; tasks
    send sums per language and piece, which the vocabulary bounds, added as decimals, so reruns agree.
    """
    pieces = pieces or Pieces.load()
    labelled = labelled.where(F.col(lang).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages, total = sorted(counted), sum(counted.values())
    if not languages:
        return Model([], np.empty((pieces.size + 1, 0)), np.empty(0), pieces)
    prior = np.log(np.array([counted[x] for x in languages]) / total)
    share = min(1.0, fit_rows / total)
    part = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) * F.lit(2.0**-53)
    sample = materialize(labelled.where(part < share), "fit-sample").repartition(min(64, max(1, int(total * share) // 250)), "id").select("text", "lang")
    table = _normal(np.ones((pieces.size + 1, len(languages))))
    number = {x: k for k, x in enumerate(languages)}

    for _ in range(rounds):
        now = table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words: dict[int, Counter] = {}
            for batch in batches:
                for t, x in zip(batch.column(0), batch.column(1).to_pylist()):
                    words.setdefault(number[x], Counter()).update(text_words(t.as_py()))
            for k, counts in words.items():
                sums = _expected(counts, pieces, now, k)
                used = np.flatnonzero(sums[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(sums[used])],
                    names=["k", "piece", "n"],
                )

        sums = np.zeros_like(table)
        found = sample.mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(
            F.sum(F.col("n").cast("decimal(28,12)")).cast("double").alias("n")).toArrow()
        sums[found.column("piece").to_numpy(), found.column("k").to_numpy()] = found.column("n").to_numpy()
        table = _normal(sums)
    return Model(languages, table, prior, pieces)


class Scorer:
    """Sums of word scores per text. Scores of words up to LONG characters are kept, HELD of them at most."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.known = np.empty((HELD, len(model.languages)))

    def _of(self, words: list[str]) -> np.ndarray:
        """(words, languages) of up to CHUNK words."""
        out = np.empty((len(words), self.known.shape[1]))
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        for k in long:
            out[k] = long_score(words[k], self.model.pieces, self.model.table)
        short = [w for w in words if len(w) <= LONG] if long else words
        new = list(dict.fromkeys(w for w in short if w not in self.place))
        if len(self.place) + len(new) > HELD:
            self.place, new = {}, list(dict.fromkeys(short))
        if new:
            at = len(self.place)
            self.known[at : at + len(new)] = log_scores(new, self.model.pieces, self.model.table)
            self.place.update(zip(new, range(at, at + len(new))))
        rows = self.known[np.fromiter(map(self.place.__getitem__, short), np.int64, len(short))]
        out[np.setdiff1d(np.arange(len(words)), long)] = rows
        return out

    def sums(self, texts: Iterable[str | None]) -> list[np.ndarray | None]:
        """The sum over each text's words, or None for a text without a letter; CHUNK words at a time, also of
        one long text."""
        out: list[np.ndarray | None] = []
        words, owners = [], []

        def flush() -> None:
            for owner, row in zip(*_run_sums(np.array(owners), self._of(words))):
                out[owner] = row if out[owner] is None else out[owner] + row
            words.clear()
            owners.clear()

        for n, text in enumerate(texts):
            out.append(None)
            for w in text_words(text):
                words.append(w)
                owners.append(n)
                if len(words) == CHUNK:
                    flush()
        if words:
            flush()
        return out


def _run_sums(owners: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    return owners[starts], np.add.reduceat(rows, starts, axis=0)


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score): the most probable language of every whole text and its probability.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned; ties go to the
    first language by name. A task holds 200 texts, CHUNK words and HELD word scores at a time.
    """
    kind = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary and the languages bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                names, scores = [], []
                for total in scorer.sums(t.as_py() for t in batch.column(1)) if model.languages else [None] * batch.num_rows:
                    if total is None:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    log = model.prior + total
                    best = int(log.argmax())
                    names.append(model.languages[best])
                    scores.append(float(1 / np.exp(log - log[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id, "lang_pred", "score"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", path: str = PIECES) -> DataFrame:
    """Learn from labelled documents that are not held out (crc32 of the id mod 4 is 2), predict for all.

    Returns id, held_out, lang_pred and score for every row, repeated ones too; an empty table gives no
    rows. Language, source and id are no input of a prediction.
    """
    held = crc_mod(F.col(id), 4) == 2
    model = fit(docs.where(~held), id, text, lang, Pieces.load(path))
    return predict(docs, model, id, text).select(id, held.alias("held_out"), "lang_pred", "score")
