"""Registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """Collects the queries of one family."""

    def add(self, name: str) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self[name] = query
            return query

        return register
