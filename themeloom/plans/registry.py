"""Registered queries: one per inventory operator, each with its oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator on the
driver's tables (or on corpora Spark derives from them); ``ORACLE[name]`` is
the same question in portable SQL for DuckDB. Computed columns carry the same
alias on both sides; floating results are rounded to 6 digits on both sides;
arrays are returned as joined text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themeloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from themeloom.plans import q_relational, q_sources, q_text, q_retrieval, q_topics, q_jobs  # noqa: F401
