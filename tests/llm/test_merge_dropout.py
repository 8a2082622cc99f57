import hashlib
import heapq

import numpy as np
import pytest
import sentencepiece
from text_helpers import SMALL, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import merge_dropout as md
from tidemark.llm import queries

TEXTS = ["", "a", "  Hello  world \n\n x ", "naïve 日本語 😀 ▁mark ▁▁", "x" * 3000, "tabs\there\r\n", " ", "\n", "a" * 700 + " b", "the the the"]


@pytest.fixture(scope="module")
def vocabulary():
    return md.Vocabulary.load()


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=md.PIECES)


def by_heap(v, symbols, key, rate):
    """The agenda one candidate at a time, over plain lists."""
    sym, start = list(symbols), list(range(len(symbols)))
    skipped = set()
    while True:
        agenda = []
        for k in range(len(sym) - 1):
            if (start[k], sym[k], sym[k + 1]) in skipped:
                continue
            one = [np.array([x], np.int64) for x in (sym[k], sym[k + 1], start[k])]
            rank, into = v._candidates(*one, np.array([key], np.uint64), 0)
            if rank[0] < v.size:
                heapq.heappush(agenda, (rank[0], k, into[0]))
        if not agenda:
            return sym
        _, k, into = heapq.heappop(agenda)
        pair = sym[k] * v.size + sym[k + 1]
        with np.errstate(over="ignore"):
            h = md.mix64(np.uint64(key) ^ md.mix64((np.uint64(start[k]) << np.uint64(48)) ^ np.uint64(pair)))
        if rate and float(h >> np.uint64(11)) * 2.0**-53 < rate:
            skipped.add((start[k], sym[k], sym[k + 1]))
            continue
        sym[k : k + 2], start[k : k + 2] = [int(into)], [start[k]]


def test_without_dropout_it_is_the_plain_encoding(vocabulary, model, texts):
    every = [t for t in TEXTS if "▁" not in t] + [r["text"] for r in list(texts.values())[:60]]
    got = md.Encoder(vocabulary, 0, 7, 4).encode(every, list(range(len(every))))
    for t, p in zip(every, got):
        assert p.tolist() == model.encode(t)


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_dropout_is_the_agenda_and_decodes(vocabulary, texts, rate):
    segments = sorted({s for r in list(texts.values())[:3] for s in md.segments_of(r["text"])})[:60]
    keys = np.arange(len(segments)).astype(np.uint64) * np.uint64(977)
    flat, starts, sizes = vocabulary.encode_segments(segments, keys, rate)
    got = [flat[a : a + n] for a, n in zip(starts, sizes)]
    for s, k, p in zip(segments, keys, got):
        assert p.tolist() == by_heap(vocabulary, vocabulary.symbols(s), int(k), rate) == vocabulary._alone(vocabulary.symbols(s), int(k), rate)
    one, two = (md.Encoder(vocabulary, rate, 7, 4).encode(TEXTS, list(range(len(TEXTS)))) for _ in range(2))
    assert [x.tolist() for x in one] == [x.tolist() for x in two]
    assert [vocabulary.decode(p.tolist()) for p in one] == TEXTS


def test_segmentations_vary(vocabulary):
    texts = ["thoroughly representative unbelievable"] * 40
    got = {tuple(p.tolist()) for p in md.Encoder(vocabulary, 0.3, 7, 4).encode(texts, list(range(40)))}
    assert len(got) > 8


def test_query(spark, texts):
    got = queries.catalog.queries["op3_merge_dropout"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["lossless"] and len(r["pieces"]) == r["n_pieces"]
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]["text"].encode()).hexdigest()


def test_odd_rows(odd, none):
    got = md.encoded(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and all(r["lossless"] for r in got.collect())
    assert {r["doc_id"] for r in got.where("n_pieces = 0").collect()} == {1, 2} and md.encoded(none).collect() == []
    with pytest.raises(ValueError):
        md.encoded(got)
    assert md.encoded(got, prefix="again_").count() == odd.count()


def test_segmentations_grow_with_the_corpus(spark, vocabulary):
    word = "representative"
    got = {tuple(p.tolist()) for p in md.Encoder(vocabulary, 0.3, 7).encode([word] * 2000, list(range(2000)))}
    assert len(got) > 30
    same = spark.createDataFrame([(1, "thoroughly representative unbelievable")] * 20, "doc_id long, text string")
    rows = md.encoded(same, rate=0.3).collect()
    assert len({tuple(r["pieces"]) for r in rows}) > 8 and all(r["lossless"] for r in rows)
    again = md.encoded(same.repartition(7), rate=0.3).collect()
    assert sorted(r["pieces"] for r in rows) == sorted(r["pieces"] for r in again)


def test_kept_plain_merges_change_nothing(vocabulary, texts):
    text = list(texts.values())[0]["text"]
    segments, key = md.segments_of(text), md.xxhash.xxh64_intdigest(repr(5), seed=7)
    with np.errstate(over="ignore"):
        keys = md.mix64(np.uint64(key) + np.arange(len(segments), dtype=np.uint64))
    flat, starts, sizes = vocabulary.encode_segments(segments, keys, 0.1)
    expected = [p for a, n in zip(starts, sizes) for p in flat[a : a + n].tolist()]
    encoder = md.Encoder(vocabulary, 0.1, 7)
    assert encoder.encode([text], [5])[0].tolist() == encoder.encode([text], [5])[0].tolist() == expected
