"""A small register that keeps a query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.oracle[key] = sql
            return f

        return put
