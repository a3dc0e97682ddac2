"""Run a registered query and its SQL text on the same tables and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(value) -> str:
    return {"int": "number", "float": "number", "Decimal": "decimal"}.get(
        type(value).__name__, type(value).__name__
    )


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return value


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    cols = sorted(spark_cols)
    si, di = [spark_cols.index(c) for c in cols], [duck_cols.index(c) for c in cols]
    a = Counter(tuple(plain(r[i]) for i in si) for r in spark_rows)
    b = Counter(tuple(plain(r[i]) for i in di) for r in duck_rows)
    if a == b:
        return None
    only_a, only_b = list((a - b).items()), list((b - a).items())
    return (
        f"rows {sum(a.values())} / {sum(b.values())}; only spark {len(only_a)}, only sql {len(only_b)}\n"
        f"  cols  {cols}\n  spark {sorted(map(str, only_a))[:3]}\n  sql   {sorted(map(str, only_b))[:3]}"
    )


def check(spark, con, name, queries, oracles, sf_dir) -> str | None:
    df = queries[name](spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return None if spark_rows else "no rows"
    if not spark_rows:
        return "no rows"
    cursor = con.execute(oracles[name])
    cols = [c[0] for c in cursor.description]
    return compare(spark_rows, df.columns, cursor.fetchall(), cols)
