import hashlib
import itertools

import pytest
from text_helpers import SMALL, docs, none, odd, texts  # noqa: F401 (fixtures)
from pyspark.sql import functions as F

from tidemark.llm import queries, spotsigs


def sets(r, name):
    t = r[name]
    return {t[k : k + 8] for k in range(0, len(t), 8)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_query(spark, texts):
    got = {r["doc_id"]: r for r in queries.catalog.queries["op4_spot_signatures"](spark, SMALL).collect()}
    order = sorted(texts, reverse=True)
    assert got.keys() == texts.keys()
    by_text = {}
    for i, j in zip(order, order[1:] + order[:1]):
        r, t, u = got[i], texts[i]["text"], texts[j]["text"]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(sets(r, "fingerprint"), sets(r, "edited_fingerprint")))
        assert r["near_next"] == pytest.approx(jaccard(sets(r, "fingerprint"), sets(got[j], "fingerprint")))
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.25 > 0.05 > mean("near_next")


def test_small_buckets_give_the_same_neighbours(spark, docs):
    a, b = (sorted(map(tuple, spotsigs.compared(docs, rows=n).collect())) for n in (7, 10**6))
    assert a == b


def test_chains(spark):
    df = spark.createDataFrame([("The big of and red the house cat. IS",), ("Menu | About | Home",)], "text string")
    spots = df.select(spotsigs.signatures(F.col("text")).alias("s")).collect()
    expected = spark.sql("select array_distinct(array(hash('the', array('big','red','house')), hash('of', array('red','house','cat')), hash('and', array('red','house','cat')), hash('the', array('house','cat')), hash('is', slice(array('x'),2,1)))) s").first()["s"]
    assert spots[0]["s"] == sorted(expected) and len(spots[1]["s"]) == 1


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = docs.limit(120).collect()
    words = [(r["doc_id"] * 10 + k, " ".join(w for n, w in enumerate(r["text"].split()) if not k or n % 29 != k)) for r in rows[:40] for k in range(4)]
    prints = spark.createDataFrame(words, "doc_id long, text string").select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs"))
    classes, links = spotsigs.near_duplicates(prints, 0.6)
    held = {r["class"]: set(r["sigs"]) for r in classes.collect()}
    expected = {frozenset(p) for p in itertools.combinations(held, 2) if jaccard(held[p[0]], held[p[1]]) >= 0.6}
    assert {frozenset((r["a"], r["b"])) for r in links.collect()} == expected and expected


def test_odd_rows(spark, odd, none):
    got = spotsigs.compared(odd).collect()
    assert len(got) == odd.count() and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert spotsigs.compared(none).collect() == []
    one = spotsigs.compared(odd.where("doc_id = 7")).first()
    assert one["near_next"] == 1
    holes = spark.createDataFrame([(None, "the a b"), (5, None), (5, "of c d e"), (5, "of c d e")], "doc_id long, text string")
    assert spotsigs.compared(holes).count() == 4
