"""Work on long ordered series without one task per series.

A window over a whole client would put every row of a very large client into one task. Rows
are cut twice instead:

* a *chunk* is a fixed stretch of time. One small row per (key, chunk) holds how many rows lie
  before it, the last known values before it, and the neighbouring stamps, so row numbers,
  forward fills and gap checks only ever sort one chunk at a time.
* a *block* is a fixed run of row positions. Each block also gets copies of the rows just
  before it (the halo), enough for the longest lag or rolling frame, and the copies are dropped
  afterwards.

Both cuts follow from the data alone, so a task that is run again gives the same rows. Stamps
must be unique within a key; ``dedupe_timestamps`` sees to that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 16_384
MIN_BLOCK_ROWS = 8_192

HELPERS = (
    "_chunk", "_count", "_before", "_after", "_prev_time", "_next_time", "_first_time",
    "_pos", "_block", "_core",
)


@dataclass(frozen=True)
class Series:
    """How a table holds its series: key columns, time column, nominal step in seconds."""

    keys: tuple[str, ...] = ("ClientID",)
    time: str = "Date"
    step: int = 900

    @property
    def key_list(self) -> list[str]:
        return list(self.keys)


def epoch(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_seconds(col.cast("timestamp"))


def from_epoch(col: Column) -> Column:
    return F.timestamp_seconds(col).cast("timestamp_ntz")


def seconds(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' SECOND")


def chunk_of(s: Series, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(epoch(s.time) / F.lit(s.step * chunk_rows))


def chunk_window(s: Series):
    return Window.partitionBy(*s.keys, "_chunk").orderBy(s.time)


def chunk_context(
    df: DataFrame, s: Series, carry: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per (key, chunk) with what a chunk must know about the rest of its series."""
    last_known = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(s.time))).alias(f"_last_{c}") for c in carry
    ]
    per_chunk = (
        df.withColumn("_chunk", chunk_of(s, chunk_rows))
        .groupBy(*s.keys, "_chunk")
        .agg(
            F.count(F.lit(1)).alias("_count"),
            F.min(s.time).alias("_min"),
            F.max(s.time).alias("_max"),
            *last_known,
        )
    )
    order = Window.partitionBy(*s.keys).orderBy("_chunk")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    future = order.rowsBetween(1, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per_chunk.select(
        *s.keys,
        "_chunk",
        "_count",
        F.coalesce(F.sum("_count").over(past), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_count").over(future), F.lit(0)).alias("_after"),
        F.lag("_max").over(order).alias("_prev_time"),
        F.lead("_min").over(order).alias("_next_time"),
        F.min("_min").over(whole).alias("_first_time"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(past).alias(f"_carry_{c}") for c in carry],
    )


def with_context(
    df: DataFrame, s: Series, carry: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    context = chunk_context(df, s, carry, chunk_rows)
    return df.withColumn("_chunk", chunk_of(s, chunk_rows)).join(context, [*s.keys, "_chunk"])


def without_helpers(df: DataFrame, *more: str) -> DataFrame:
    extra = [c for c in df.columns if c.startswith(("_carry_", "_last_"))]
    return df.drop(*HELPERS, *extra, *more)


def numbered(df: DataFrame, s: Series, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_pos``: the row's place in its series, from 0."""
    place = F.row_number().over(chunk_window(s)) - 1
    return with_context(df, s, (), chunk_rows).withColumn("_pos", place + F.col("_before"))


def previous_time(s: Series) -> Column:
    """The stamp before this one, for rows that carry their chunk context."""
    return F.coalesce(F.lag(s.time).over(chunk_window(s)), F.col("_prev_time"))


def next_time(s: Series) -> Column:
    return F.coalesce(F.lead(s.time).over(chunk_window(s)), F.col("_next_time"))


def blocks(
    df: DataFrame,
    s: Series,
    behind: int,
    ahead: int = 0,
    regular: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Spread each series over blocks that hold ``behind``/``ahead`` rows of their neighbours.

    ``regular=True`` says every step is present, so the place of a row follows from its stamp
    and no numbering shuffle is needed. Use it only after a grid fill.
    """
    size = block_rows or max(MIN_BLOCK_ROWS, 4 * max(behind, ahead))
    if size < max(behind, ahead):
        raise ValueError("a block must be at least as long as its halo")
    if regular:
        placed = df.withColumn("_pos", F.floor(epoch(s.time) / F.lit(s.step)))
    else:
        placed = without_place_helpers(numbered(df, s))
    home = F.floor(F.col("_pos") / F.lit(size))
    after = F.when(F.col("_pos") >= (home + 1) * size - behind, 1).otherwise(0)
    before = F.when((F.col("_pos") < home * size + ahead) & (home > 0), 1).otherwise(0)
    # The blocks of a row lie side by side. A sequence is compiled; filters of arrays are not.
    spread = placed.withColumn("_block", F.explode(F.sequence(home - before, home + after)))
    return spread.withColumn(
        "_core", F.col("_block") == F.floor(F.col("_pos") / F.lit(size))
    )


def without_place_helpers(df: DataFrame) -> DataFrame:
    return df.drop("_chunk", "_count", "_before", "_after", "_prev_time", "_next_time", "_first_time")


def block_window(s: Series):
    return Window.partitionBy(*s.keys, "_block").orderBy("_pos")


def core(df: DataFrame, keep_pos: bool = False) -> DataFrame:
    """Drop the halo copies."""
    kept = df.filter("_core")
    return kept.drop("_core", "_block") if keep_pos else without_helpers(kept)


def fill_forward(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Replace NULL by the last known value of the same series."""
    w = chunk_window(s).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = with_context(df, s, cols).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_carry_{c}")) for c in cols}
    )
    return without_helpers(filled).select(df.columns)


def last_n(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The newest ``n`` rows of each series.

    Chunks that have ``n`` or more rows after them are left out before any row is sorted, so a
    key's sort holds at most ``n`` rows and one chunk.
    """
    newest = Window.partitionBy(*s.keys).orderBy(F.col(s.time).desc())
    chunk_rows = max(n, 1024)
    tail = chunk_context(df, s, (), chunk_rows).filter(F.col("_after") < n).select(*s.keys, "_chunk")
    return (
        df.withColumn("_chunk", chunk_of(s, chunk_rows))
        .join(tail, [*s.keys, "_chunk"], "left_semi")
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= n)
        .drop("_chunk", "_rank")
        .select(df.columns)
    )
