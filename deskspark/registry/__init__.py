"""Named queries over the given tables, each next to the SQL it must agree with."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deskspark.session import ship

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
FAMILIES = (
    "mail", "classify", "reply", "quality", "accounts", "reports", "caching", "corpus", "retrieval", "flow",
    "streams",
)


def register(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _shipped(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _shipped(fn: QueryFn) -> QueryFn:
    """Query whose Python workers can import this package wherever the caller was started."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


def load_all() -> None:
    import importlib

    for family in FAMILIES:
        importlib.import_module(f"deskspark.registry.{family}")
