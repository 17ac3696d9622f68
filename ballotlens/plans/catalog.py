"""Registry of named queries: a Spark builder and (when SQL can say it) a DuckDB oracle.

Each entry's builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the whole input tables.  The oracle is plain SQL over the driver's
tables; the fixture views it needs are prefixed as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ballotlens.plans.fixtures import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    build: Builder
    sql: str | None
    views: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql, tuple(views))
        return fn
    return deco


def _load_all() -> None:
    # importing the query modules fills REGISTRY
    from ballotlens.plans import queries, queries_inputs, queries_tables  # noqa: F401


def queries() -> dict[str, Builder]:
    _load_all()
    return {k: e.build for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: with_views(e.sql, list(e.views)) for k, e in REGISTRY.items() if e.sql is not None}
