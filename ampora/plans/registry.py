"""A module's queries by name, each with its SQL form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a query under its function's name."""

        def register(f):
            self._queries[f.__name__] = f
            if sql is not None:
                self._sql[f.__name__] = sql
            return f

        return register

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
