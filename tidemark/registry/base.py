"""Registered queries: each operator over the whole tables of a folder, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name, with the SQL that computes the same."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return run

    return register


def with_ctes(*parts: str) -> str:
    """``WITH a AS (…), b AS (…) SELECT …`` from CTE texts and a final select."""
    *ctes, final = parts
    recursive = "RECURSIVE " if any("UNION ALL" in c and "RECURSE" in c for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join(ctes) + "\n" + final
