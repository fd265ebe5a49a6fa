"""A registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Tables(Protocol):
    def __call__(self, name: str) -> DataFrame: ...


class Sql(str):
    """SQL with one blank, {0}; other braces stay as they are."""

    def format(self, value: str) -> "Sql":  # type: ignore[override]
        return Sql(self.replace("{0}", value))


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        """Register a function of a table lookup under its own name."""

        def put(f: Callable[[Tables], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put
