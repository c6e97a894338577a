"""Name -> (query, oracle SQL) registry behind the driver's entry points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the SQL that must give the same rows (None where SQL cannot)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def register(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = query
            if oracle is not None:
                self.oracles[name] = oracle
            return query

        return keep
