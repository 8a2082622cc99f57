import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"

#: Null, empty and odd texts, ties, repeated rows, and a column whose name operators use inside.
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "one two three", None, "a"), (3, "one two three", None, "a"),
    (4, "\n\n \t", "de", "a"), (5, "x" * 5000, "en", "b"), (6, "é 日本 😀 ▁ ok\r\n" * 3, "fr", "b"), (7, "Ab aB AB", "en", None),
]


def found(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(value, n):
    return zlib.crc32(str(value).encode()) % n


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 0, "clash") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}
