"""Named queries over the test tables, most with an SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows and our own tests check it."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def using(*parts: str) -> str:
    """``WITH`` the given table texts, then the last part, which may begin with tables too."""
    texts = [t.strip() for t in parts]
    joint = "\n" if texts[-1].upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(texts[:-1]) + joint + texts[-1]


def r6(col: Column | str) -> Column:
    """Six places; adding 0.0 turns −0.0 into 0.0."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def q6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"
