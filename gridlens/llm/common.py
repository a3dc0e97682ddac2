"""Column helpers and small plan helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Words are runs of anything but these characters: space, tab, line ends.
WHITE = r"[\x20\x09-\x0D]"


def text_of(column: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def pieces(text: Column) -> Column:
    """The text cut at every single white-space character, empty pieces included."""
    return F.split(text, WHITE, -1)


def words(text: Column) -> Column:
    return F.array_remove(pieces(text), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also when a lambda in ``use`` needs it for each element.

    A plain column named in a lambda may be replaced by its definition, which then runs once
    for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on these columns, null equal to null; the columns of ``right`` beside them are added."""
    marked = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(marked[f"_r_{n}"])
    return left.join(marked, condition, how).drop(*[f"_r_{n}" for n in names])


def clear_of(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns named like an operator's outputs (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def small_or_shuffled(small: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``small`` marked for broadcast if it has no more rows than that; else Spark shuffles.

    For tables of a few numbers a row. Only ``max_rows + 1`` rows are looked at.
    """
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def groups_for(rows: int, rows_per_group: int = 2_000, most: int = 4_096) -> int:
    """Into how many hash groups to deal rows, so that no window holds them all."""
    return max(1, min(most, -(-rows // rows_per_group)))
