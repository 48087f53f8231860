"""Named queries: one per operator of the inventory, with its SQL oracle.

A query is a callable ``(spark, sf_dir) -> DataFrame``.  The oracle is an
equivalent SQL text that DuckDB runs over the same parquet tables; when
an operator has no SQL form (iterative fits, streaming state) it has no
oracle and is checked against a brute-force re-computation in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratewise.sources.domain import Domain

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}



def domain(spark: SparkSession, sf_dir: str) -> Domain:
    """A fresh :class:`Domain` per query call: sub-plans are shared within
    one query, nothing (in particular no materialized table) across calls."""
    return Domain(spark, sf_dir)


def query(name: str, oracle: str | None = None):
    """Register ``fn(d: Domain) -> DataFrame`` as query ``name``."""

    def deco(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(domain(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco
