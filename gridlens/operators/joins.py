"""Joins of long readings with a smaller table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> int:
    """A rough width of one row, strings counted as 32 bytes and arrays as 64 doubles."""
    widths = {"string": 32, "boolean": 1, "int": 4, "float": 4}
    return sum(512 if t.startswith("array") else widths.get(t, 8) for _, t in df.dtypes)


def attach(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``fact`` with a table that is usually small.

    The small side is counted first. Within the bound it is broadcast, so the readings do not
    move. Beyond it the join is left to a shuffle, where AQE splits the partition of a key
    that holds a large share of the rows.
    """
    bound = min(max_rows, BROADCAST_BYTES // max(1, row_bytes(dim)))
    kept = dim.persist(StorageLevel.MEMORY_AND_DISK)
    if kept.count() <= bound:
        return fact.join(F.broadcast(kept), on, how)
    kept.unpersist()
    return fact.join(dim, on, how)
