import itertools
import math
import re

import numpy as np
import pytest
from text_helpers import SMALL, crc, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import langid, queries

PIECES = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "aba"])


def brute(word, table):
    """Sum over all segmentations, one by one."""
    total = 0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        p = 1.0
        for x in parts:
            k = PIECES.number.get(x)
            p *= table[k] if k is not None else langid.FLOOR if len(x) == 1 else 0
        total += p
    return total


def table(seed=0):
    t = np.random.default_rng(seed).random((PIECES.size + 1, 2))
    t[:-1] /= t[:-1].sum(axis=0)
    t[-1] = langid.FLOOR
    return t


@pytest.mark.parametrize("word", ["▁", "▁a", "▁ababa", "▁aXba", "XY", "▁bbbabab"])
def test_forward_sums_all_segmentations(word):
    t = table()
    expected = np.log([brute(word, t[:, 0]), brute(word, t[:, 1])])
    assert langid.log_scores([word, "▁b"], PIECES, t)[0] == pytest.approx(expected)
    assert langid.long_score(word, PIECES, t) == pytest.approx(expected)


def test_expected_counts_are_derivatives():
    """d log p(word) / d log p(piece) is the expected use of the piece."""
    t = table()[:, :1]
    got = langid._expected({"▁ababa": 2, "▁ab": 1}, PIECES, t, 0)
    for k in range(PIECES.size):
        up, down = t.copy(), t.copy()
        up[k] *= 1 + 1e-6
        down[k] *= 1 - 1e-6
        log = lambda x: 2 * np.log(brute("▁ababa", x[:, 0])) + np.log(brute("▁ab", x[:, 0]))
        assert got[k] == pytest.approx((log(up) - log(down)) / 2e-6, abs=1e-4)


def test_held_out_accuracy(spark, texts):
    got = queries.catalog.queries["op9_language"](spark, SMALL).collect()
    assert len(got) == len(texts)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in held) / len(held) > 0.95


def test_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[4]["lang_pred"] == "und" and got[5]["lang_pred"] != "und"
    assert langid.identify(none).collect() == []
    bare = langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert len(bare) == odd.count() and {r["lang_pred"] for r in bare} == {"und"}


def log_forward(word, pieces, row):
    """Log of the sum over all segmentations, in logarithms all the way."""
    best = [0.0]
    for j in range(1, len(word) + 1):
        ways = []
        for i in range(max(0, j - pieces.reach), j):
            k = pieces.number.get(word[i:j], -2)
            if k >= 0 or j - i == 1:
                ways.append(best[i] + math.log(row[k] if k >= 0 else langid.FLOOR))
        top = max(ways)
        best.append(top + math.log(math.fsum(math.exp(x - top) for x in ways)))
    return best[-1]


def test_query_against_plain_scores(spark, docs, texts):
    """Every document's language and score, from the fitted probabilities, by another form of the sums."""
    held = langid.crc_mod(langid.F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    rows = model.table.T.tolist()
    known = {}
    for r in queries.catalog.queries["op9_language"](spark, SMALL).collect():
        words = [w for w in re.findall(r"[^\W\d_]+", (texts[r["doc_id"]]["text"] or "").lower()) if any(c.isalpha() for c in w)]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        for w in words:
            if w not in known:
                known[w] = [log_forward("▁" + w, model.pieces, row) for row in rows]
        total = [p + math.fsum(known[w][k] for w in words) for k, p in enumerate(model.prior)]
        top = max(total)
        assert r["lang_pred"] == model.languages[total.index(top)]
        assert r["score"] == pytest.approx(1 / math.fsum(math.exp(x - top) for x in total), abs=1e-9)


@pytest.mark.parametrize("n", [10, 40, 45, 46, 47, 48, 60, 300])
def test_uncovered_characters_count_alike_at_every_length(n):
    """The difference between languages comes from the covered part alone."""
    t = table()
    covered, bare = langid.log_scores(["▁ab", "▁ab" + "#" * n], PIECES, t)
    assert bare - covered == pytest.approx([n * math.log(langid.FLOOR)] * 2)


def test_scorer_holds_a_bound(monkeypatch):
    """Texts longer than a chunk, more words than are held, and words too long to hold."""
    monkeypatch.setattr(langid, "HELD", 30)
    monkeypatch.setattr(langid, "CHUNK", 25)
    t = table()
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(400)] + ["ab" * 40]
    model = langid.Model(["x", "y"], t, np.zeros(2), PIECES)
    texts = [" ".join(rng.choice(words, n)) for n in (3, 700, 0, 40, 1)] + [None, "½ 12", " ".join(words)]
    scorer = langid.Scorer(model)
    for text, got in zip(texts, scorer.sums(texts), strict=True):
        own = [langid.START + w for w in (text or "").split() if w.isalpha()]
        assert len(scorer.place) <= 30
        if own:
            assert got == pytest.approx(sum(langid.long_score(w, PIECES, t) for w in own))
        else:
            assert got is None


def test_reruns_agree(spark, docs):
    a, b = (langid.fit(docs.repartition(n), rounds=1).table for n in (2, 5))
    assert (a == b).all()
