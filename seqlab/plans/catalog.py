"""Registered queries over the driver tables and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Every computed column is
aliased to the same name in the Spark plan and in the SQL.  Doubles that come
from floating sums or interpolation are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlab.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # executors import seqlab for UDFs
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from seqlab.plans import (  # noqa: F401
        q_order,
        q_spacing,
        q_prep,
        q_sampling,
        q_metrics,
        q_profile,
        q_models,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
