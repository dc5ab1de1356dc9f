"""The named queries and their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailsift.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is the same result for an engine reading the same tables."""
    def register(fn: QueryFn) -> QueryFn:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def load_all() -> None:
    from mailsift.plans import (evaluation, features, forensics, models, neighbours, sqlsurface, streams, tables,  # noqa: F401
                                textjobs)
