"""Query registry.

``@query(name, oracle=sql)`` files a callable ``(spark, sf_dir) -> DataFrame``.  The SQL runs
on the same parquet tables; ``{name}`` placeholders for domain tables become CTEs.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termsheet.plans import domain
from termsheet.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _used(sql: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(sql) if name]


def with_tables(sql: str) -> str:
    """Fill the domain-table placeholders of ``sql`` and put their definitions in front."""
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in ordered or name in domain.BASE_TABLES:
            return
        body = domain.check_sql(name)
        for inner in _used(body):
            visit(inner)
        ordered[name] = body

    for name in _used(sql):
        visit(name)
    names = {n: n for n in [*ordered, *domain.BASE_TABLES]}
    ctes = [f"{n} AS ({body.format(**names)})" for n, body in ordered.items()]
    main = sql.format(**names)
    if not ctes:
        return main
    if main.lstrip().upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + main.lstrip()[len("WITH RECURSIVE "):]
    if main.lstrip().upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + main.lstrip()[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + main


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = with_tables(oracle)
        return fn
    return register
