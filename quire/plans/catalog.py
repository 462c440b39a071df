"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``; the oracle (when the
operation is SQL-expressible) is the same result written as DuckDB SQL over
the pre-registered table views.  Float outputs are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.session import checkpoint_dir, ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__, run.__module__ = fn.__name__, fn.__doc__, fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def _load_modules() -> None:
    # importing registers the queries
    from quire.plans import (  # noqa: F401
        q_sources, q_clean, q_scalars, q_relational, q_aggregate, q_charts,
        q_features, q_evaluate, q_scorecard, q_timeseries, q_models, q_studies,
    )


def queries() -> dict[str, QueryFn]:
    _load_modules()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_modules()
    return dict(ORACLE_SQL)
