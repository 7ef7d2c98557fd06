"""Portable deterministic randomness.

``rand(seed)`` depends on how rows fall into partitions, so a re-run on another
cluster (or a retried task) could draw differently. Every sampling operator in
citegraph instead keys its draw on ``md5`` of the row's own ids and a seed: the
same row gets the same draw under any partitioning, and DuckDB computes the
identical number (first 15 hex digits of the md5 → a 60-bit integer).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_RANGE = 1 << HASH_BITS


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def hash64(*parts) -> Column:
    """60-bit non-negative BIGINT from md5 of the '|'-joined parts."""
    joined = F.concat_ws("|", *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def sql_hash64(*exprs) -> str:
    """The same number as :func:`hash64`, as DuckDB SQL text."""
    inner = ", ".join(str(e) for e in exprs)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT"


def hash_threshold(p: float) -> int:
    """Integer cut so that ``hash64 < cut`` holds with probability ``p``."""
    if not 0.0 <= p <= 1.0:
        raise ValueError(f"probability out of range: {p}")
    return int(round(p * HASH_RANGE))


def bernoulli(p: float, *parts) -> Column:
    """Deterministic Bernoulli(p) draw keyed on ``parts``."""
    return hash64(*parts) < F.lit(hash_threshold(p))
