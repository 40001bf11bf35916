"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries of one family."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under its own name."""

        def register(function: Query) -> Query:
            self.add(function.__name__, function, sql)
            return function

        return register
