"""How the modules of this folder register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Pack:
    """A decorator that collects queries and the SQL for them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            self.queries[run.__name__] = run
            if sql:
                self.oracles[run.__name__] = sql
            return run

        return keep
