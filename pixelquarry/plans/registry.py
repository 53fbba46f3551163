"""Collects the registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelquarry.plans.views import duck_with

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
        """Register a query; ``views`` names the derived views its SQL reads."""

        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = duck_with(views.split(), sql)
            return fn

        return keep
