"""Registering queries with their DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and oracles of a plan module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            name = f.__name__
            if name in self.queries:
                raise ValueError(f"registered twice: {name}")
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
