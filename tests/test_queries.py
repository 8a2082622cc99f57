"""Every registered query next to its SQL on the smallest tables."""

import duckdb
import pytest
from check import TABLES, rows_of
from conftest import SMALL

import __spark_entry__ as entry
from tidemark import catalog

QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if not name.startswith(("udf", "src10")):
        assert "EvalPython" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    names, _, got = rows_of(df.toArrow())
    expected_names, _, expected = rows_of(db.execute(SQL[name]).to_arrow_table())
    assert names == expected_names
    assert got == expected


def test_late_events_are_all_accounted_for(spark):
    row = QUERIES["str8_late_events"](spark, SMALL).first()
    total = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert row["kept"] + row["dropped"] == total and row["dropped"] > 0
