"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where SQL can say the same thing, the DuckDB oracle text over the driver tables.

Doubles in registered outputs are rounded to 6 places on both sides; every
computed column is aliased to the same name in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every module that registers queries."""
    from citegraph.plans import (  # noqa: F401
        q_corpus, q_encode, q_graph, q_metrics, q_models, q_sampling, q_sources, q_vectors,
    )
