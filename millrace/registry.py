"""The list of queries: each is a function of Tables, with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.catalog import Tables

Query = Callable[[Tables], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is there already")
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql.strip()
            return f

        return add

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {n: (lambda spark, folder, f=f: f(Tables(spark, folder))) for n, f in self.queries.items()}


def merged(*registries: Registry) -> Registry:
    out = Registry()
    for r in registries:
        if twice := out.queries.keys() & r.queries.keys():
            raise ValueError(f"queries registered twice: {sorted(twice)}")
        out.queries |= r.queries
        out.oracles |= r.oracles
    return out
