"""Registered queries, one per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The given tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a function of ``Tables`` under a name, with its SQL where SQL can say it."""

        def add(fn: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"Query {name!r} exists")
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tidemark.catalog import (
        calculations, charts, cleaning, columns, filters, joins, jsons, kpis, matching,
        profiles, sources, streams, validation, windows,
    )

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (
        sources, columns, cleaning, filters, joins, calculations, windows, validation,
        profiles, matching, charts, kpis, jsons, streams,
    ):
        both = queries.keys() & module.catalog.queries.keys()
        if both:
            raise ValueError(f"Queries registered twice: {sorted(both)}")
        queries.update(module.catalog.queries)
        sql.update(module.catalog.sql)
    return queries, sql
