"""Where the query modules put their entries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.suite import shapes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, shapes_used: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the named shapes as tables ``px_<name>``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            prefix, body = shapes.with_clause(shapes_used), sql.strip()
            if prefix and body.startswith("WITH RECURSIVE "):
                prefix, body = prefix.replace("WITH ", "WITH RECURSIVE ", 1), "WITH " + body[len("WITH RECURSIVE "):]
            if prefix and body.startswith("WITH "):  # the shapes already open the WITH clause
                prefix, body = prefix.rstrip() + ",\n", body[5:]
            ORACLES[name] = prefix + body
        return fn

    return add
