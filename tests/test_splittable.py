"""Large documents that many tasks read."""

import csv
import json
import pathlib
import random

import pytest
from conftest import rows
from pyspark.sql import DataFrameWriter

from tidemark.sources import readers, splittable

NASTY = ['say "hi"', "{", "}", '}, {"id": 1}', "[{]}", "back\\slash", "ends with \\", 'quote at end "', "line\nbreak", "é😀", "", 'a\\"}', "\\\\"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, n) for k in before]
    for k, v in before.items():
        spark.conf.set(k, v)


def items(n, seed):
    rng = random.Random(seed)
    return [{"id": i, "text": " ".join(rng.choices(NASTY, k=rng.randint(0, 4))), "inner": {"a": rng.choice(NASTY), "list": [{"x": 1}] * rng.randint(0, 2)}} for i in range(n)]


SCHEMA = "id bigint, text string, inner struct<a: string, list: array<struct<x: bigint>>>"


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [64, 777, 10**6])
def test_array_of_many_splits(spark, tmp_path, small_splits, split, indent):
    made = items(120, split)
    (tmp_path / "one.json").write_text(json.dumps(made, indent=indent, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps({"id": -1, "text": "flat }", "inner": {"a": "{", "list": []}}))
    small_splits(split)
    path = str(tmp_path / "*.json")
    got = splittable.json_array(spark, path, SCHEMA)
    want = [(d["id"], d["text"], (d["inner"]["a"], [(1,)] * len(d["inner"]["list"]))) for d in made] + [(-1, "flat }", ("{", []))]
    plain = sorted((r["id"], r["text"], (r["inner"]["a"], [tuple(x) for x in r["inner"]["list"]])) for r in got.collect())
    assert plain == sorted(want)
    if split < 1000:
        assert splittable._fragments(spark, path, "}").rdd.getNumPartitions() > 10


def test_records_of_a_split_are_not_sorted(spark, tmp_path, small_splits):
    """The memory of a task would grow with its split."""
    made = [{"id": i, "text": "x" * 50, "inner": None} for i in range(20000)]
    (tmp_path / "one.json").write_text(json.dumps(made))
    small_splits(600_000)
    folders, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        write(self, path, *args, **options)
        folders.extend(p.name for p in pathlib.Path(path.removeprefix("file:")).iterdir() if p.is_dir())

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", noted)
        got = splittable.json_array(spark, str(tmp_path / "one.json"), SCHEMA)
    assert got.count() == 20000 and got.select("id").distinct().count() == 20000
    assert folders == []  # a folder per value is what the writer sorts for


def test_inferred_schema(spark, tmp_path, small_splits):
    made = [{"a": i, "b": "x}" if i % 2 else None} for i in range(200)]
    (tmp_path / "one.json").write_text("[" + ",\r\n".join(map(json.dumps, made)) + "]\n")
    small_splits(300)
    got = readers.json_rows(spark, str(tmp_path / "one.json"), splittable=True)
    assert got.columns == ["a", "b"] and rows(got) == sorted(((d["a"], d["b"]) for d in made), key=repr)


def test_array_without_objects(spark, tmp_path):
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "numbers.json").write_text('[1, "}", 3]')
    assert splittable.json_array(spark, str(tmp_path / "*.json"), SCHEMA).collect() == []


@pytest.mark.parametrize("split", [40, 500, 10**6])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks_in_many_splits(spark, tmp_path, small_splits, split, end):
    rng = random.Random(split)
    want = [(i, " ".join(rng.choices([*NASTY, "a,b", "two\n\nbreaks", '"'], k=rng.randint(0, 3))) or None, i / 4) for i in range(150)]
    with open(tmp_path / "one.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL)
        out.writerows([("id", "text", "n"), *want])
    small_splits(split)
    got = readers.csv(spark, str(tmp_path / "one.csv"), schema="id bigint, text string, n double", multiline=True)
    strip = lambda r: (r[0], r[1].strip(" ") if r[1] else None, r[2])
    assert sorted(map(strip, (tuple(r) for r in got.collect()))) == sorted(map(strip, want))


def test_measures():
    assert splittable.json_measure('{"a": "b') == (1, 1, -1)
    assert splittable.json_measure('"a\\"') == (1, 0, -1)
    assert splittable.csv_measure('a,"b ""c""') == (1, 0, 0)
