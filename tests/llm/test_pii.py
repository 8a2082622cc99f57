import hashlib
import re

import pytest
from text_helpers import SMALL, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import pii, queries

#: The patterns as the contract words them.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return kind == "email" or (13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15)


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def check(rows, texts):
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b.startswith(k) for b in base) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def test_query(spark):
    folder = SMALL.replace("0.001", "0.01")
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.catalog.queries["op6_personal_data"](spark, folder).collect()
    assert len(got) == len(texts)
    check(got, {i: r["text"] for i, r in texts.items()})
    for r in got:
        text = texts[r["doc_id"]]["text"]
        for s in filter(None, r["spans"].split(",")):
            kind, a, b = s.split(":")
            if kind == "secret":
                assert re.fullmatch(r"[\w/+-]{16,}", text[int(a) : int(b)])
    tokens = [(i, m) for i, r in texts.items() for m in re.finditer(r'token = "(\w+)"', r["text"])]
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert tokens
    assert all(f"secret:{m.start(1)}:{m.end(1)}" in spans[i] for i, m in tokens)


HARD = [
    "a@b.c_d@e.f", "x@y", "é😀 a@b..c@d.e +1 (2) 3-4567890.", "1.2.3.4.5.6.7.8 001.2.3.256 1.2.3.255", "4111 1111 1111 1111-4111111111111111",
    "4111-1111-1111-1111", "+12 +1234567890123456 ++491711234567", "a@b.c@d.e@f.g", "%+-@-.-", "5  6 7", "0" * 16, "a" * 30000 + "@x.y", "9" * 30000,
    "a.b@" + "c." * 9000 + "d", "", None, "(+1 555 0101010), 10.0.0.1:80",
]


def test_hard_texts(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)], "doc_id long, text string, key string")
    check(pii.report(df).collect(), dict(enumerate(HARD)))
    out = {r["doc_id"]: r for r in pii.masked(df).collect()}
    assert out[5]["text"] == "[CARD]" and out[0]["text"] == "[EMAIL][EMAIL]" and out[15]["text"] is None and out[5]["key"] == "clash"
    assert out[16]["text"] == "([PHONE]), [IP]:80"


def test_reliabilities_tell_good_labelers_from_bad():
    counts = {"11102": 400, "00002": 380, "11002": 90, "00102": 80, "22212": 30, "22202": 30}
    post = pii.reliabilities(counts)
    assert post["11102"] > 0.9 > 0.5 > post["00002"] and post["11002"] > 0.5 > post["00102"]


def test_odd_rows(odd, none):
    assert len(pii.report(odd).collect()) == odd.count() == pii.masked(odd).count()
    assert pii.report(none).collect() == [] == pii.masked(none).collect() and pii.masked(odd).columns == odd.columns


@pytest.mark.parametrize("d", ["4111111111111111", "4111111111111112", "79927398713"])
def test_luhn(spark, d):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(d,)], "d string").select(pii.luhn(F.col("d"))).first()[0] == luhn(d)
