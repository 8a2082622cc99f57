import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from text_helpers import SMALL, crc, found, lower, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import ctw, queries


def kt(a, b):
    p, x, y = 1.0, 0, 0
    for bit in [0] * a + [1] * b:
        p *= ((y if bit else x) + 0.5) / (x + y + 1)
        x, y = x + (bit == 0), y + bit
    return p


class Brute:
    """A context tree as dictionaries, mixed by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for context, byte in self.steps(t):
                for prefix, bit in self.bits(byte):
                    for d in range(depth + 1):
                        node = (context[depth - d :], prefix)
                        self.n[node][bit] += 1
                        if d < depth:
                            self.kids[node].add((context[depth - d - 1 :], prefix))
        self.memo = {}

    def steps(self, t):
        raw = bytes([255]) * self.depth + t + bytes([255])
        return [(raw[i : i + self.depth], raw[i + self.depth]) for i in range(len(t) + 1)]

    @staticmethod
    def bits(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    def pw(self, node):
        if node not in self.memo:
            own = kt(*self.n[node])
            self.memo[node] = own if len(node[0]) == self.depth else 0.5 * own + 0.5 * math.prod(self.pw(k) for k in self.kids[node])
        return self.memo[node]

    def p(self, context, prefix, bit, d=0):
        node = (context[self.depth - d :], prefix)
        if node not in self.n:
            return None
        a = self.n[node]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        deeper = self.p(context, prefix, bit, d + 1) if d < self.depth else None
        if deeper is None:
            return own
        w = 0.5 * kt(*a) / self.pw(node)
        return w * own + (1 - w) * deeper

    def score(self, t):
        return sum(math.log10(self.p(c, pre, bit) or 0.5) for c, byte in self.steps(t) for pre, bit in self.bits(byte))


def small(spark):
    texts = ["abracadabra", "abra cad", "Ba", "", None, "é ab", "zz top", "cadabra ab", "abba", "racad", "aab", "ab ab"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_scores_against_a_tree_by_recursion(spark):
    df = small(spark)
    rows = {r["doc_id"]: lower(r["text"]).encode() for r in df.collect()}
    for depth in (2, 4):
        tree = Brute([t for i, t in rows.items() if crc(i, 7) != 2], depth)
        got = {r["doc_id"]: r["score"] for r in ctw.score(df, depth=depth).collect()}
        assert got == pytest.approx({i: tree.score(t) for i, t in rows.items()}, rel=1e-8)


def test_probabilities_sum_to_one(spark):
    rows = [lower(r["text"]).encode() for r in small(spark).collect()]
    keys, n = np.unique(ctw.grams(rows, 2)[0], return_counts=True)
    ask = np.arange(256) | (ord("a") << 16) | (ord("b") << 8)
    both = np.r_[keys, np.setdiff1d(ask, keys)]
    p, (ids, zeros, ones, log_pw) = ctw.subtree(both, np.r_[n, np.zeros(len(both) - len(keys))], 2, 2)
    upper = ctw.Upper(ids & 0xFFFF, zeros, ones, log_pw)
    assert (10 ** upper.log10(both, p))[np.isin(both, ask)].sum() == pytest.approx(1)


def test_base_scores(spark, texts):
    got = {r["doc_id"]: r for r in queries.catalog.queries["op7_context_tree_scores"](spark, SMALL).collect()}
    tokens = {i: found(lower(r["text"])) + [None] for i, r in texts.items()}
    counts = Counter(w for i, x in tokens.items() if crc(i, 7) != 2 for w in x)
    n, v = sum(counts.values()), len(counts)
    assert got.keys() == tokens.keys()
    for i, x in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(x), sum(counts[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x))
    held = [r for r in got.values() if r["held_out"]]
    assert 1 < sum(r["bits_per_byte"] for r in held) / len(held) < 4


def test_odd_rows(odd, none):
    got = ctw.score(odd).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3, 4, 5, 6, 7]
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 and all(r["score"] < 0 for r in got)
    assert ctw.score(none).collect() == []
