"""Every registered query: its Spark form and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is DuckDB SQL over the shared tables of `plans.oracle`."""
    from clausewright.plans.oracle import compose

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = compose(oracle)
        return fn

    return add


def load() -> None:
    from clausewright.plans import (  # noqa: F401
        answer_queries,
        claim_queries,
        document_queries,
        eval_queries,
    )
