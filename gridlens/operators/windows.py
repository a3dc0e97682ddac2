"""Windows of consecutive rows as model input, and rows picked from the end of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import series as S
from gridlens.operators.series import Series

SEQ_LEN, LABEL_LEN, PRED_LEN = 168, 24, 24
EPSILON = 1e-5


def last_n_per_group(df: DataFrame, s: Series, n: int = 1344) -> DataFrame:
    return S.last_n(df, s, n)


def last_hours_per_client(hourly: DataFrame, s: Series, n: int = SEQ_LEN) -> DataFrame:
    return S.last_n(hourly, s, n)


def sliding_windows(df: DataFrame, s: Series, value: str, seq: int = SEQ_LEN,
                    label: int = LABEL_LEN, pred: int = PRED_LEN, regular: bool = True) -> DataFrame:
    """Every full window, stride 1, as arrays: ``input`` (seq values) and ``target`` (the last
    ``label`` inputs and the ``pred`` values after them). ``start`` is the first stamp.

    A window is read off one sort per block; its two arrays have a fixed length.
    """
    spread = S.blocks(df, s, behind=0, ahead=seq + pred, regular=regular)
    w = S.block_window(s)
    full = spread.withColumns(
        {
            "input": F.collect_list(F.struct(value)).over(w.rowsBetween(0, seq - 1)),
            "target": F.collect_list(F.struct(value)).over(
                w.rowsBetween(seq - label, seq + pred - 1)
            ),
        }
    ).filter(F.col("_core") & (F.size("target") == label + pred) & (F.size("input") == seq))
    return full.select(
        *s.keys,
        F.col(s.time).alias("start"),
        F.col(f"input.{value}").alias("input"),
        F.col(f"target.{value}").alias("target"),
    )


def stationarise_window(df: DataFrame, s: Series, value: str, seq: int = SEQ_LEN,
                        eps: float = EPSILON, regular: bool = True) -> DataFrame:
    """Per full window ending at a row: its mean, its deviation and the row's scaled value."""
    spread = S.blocks(df, s, behind=seq, regular=regular)
    frame = S.block_window(s).rowsBetween(-(seq - 1), 0)
    stats = spread.withColumns(
        {
            "window_mean": F.avg(value).over(frame),
            "window_std": F.sqrt(F.var_pop(value).over(frame) + F.lit(eps)),
            "_n": F.count(value).over(frame),
        }
    ).filter(F.col("_n") == seq)
    return S.core(stats).drop("_n").withColumn(
        "scaled", (F.col(value) - F.col("window_mean")) / F.col("window_std")
    )


def peak_row(df: DataFrame, keys: Sequence[str], value: str, time: str) -> DataFrame:
    """Highest value per key and the first stamp it occurs at; an aggregate, not a sort."""
    order = F.struct(F.col(value), (-S.epoch(time)).alias("_early"))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(value).alias("peak"), F.max_by(time, order).alias("peak_time")
    )


def window_origins(df: DataFrame, s: Series, value: str, start, seq: int = SEQ_LEN,
                   pred: int = PRED_LEN, others: Sequence[str] = ()) -> DataFrame:
    """Inputs of a forecast made every ``pred`` steps from ``start`` on (a regular grid); with
    ``others``, the same hours of these columns follow in the same array.

    ``start`` is a column of the input: the first step to forecast. Each row sends itself to the
    few windows it is part of, and a window gathers exactly ``seq`` rows. Windows whose ``seq``
    inputs or ``pred`` outputs are not all present are left out.
    """
    offset = ((S.epoch(s.time) - S.epoch(start)) / F.lit(s.step)).cast("long")
    first = F.floor(F.col("_off") / pred) + 1
    # As input: windows with origin o·pred, offset − seq ≤ … < offset; as output: its own.
    last = F.floor((F.col("_off") + seq) / pred)
    own = F.floor(F.col("_off") / pred)
    placed = df.select(*s.keys, s.time, value, *others, start).withColumn("_off", offset)
    feeds = F.when(last >= F.greatest(first, F.lit(0)), F.sequence(F.greatest(first, F.lit(0)), last))
    inputs = (
        placed.withColumn("_o", F.explode(feeds))
        .groupBy(*s.keys, "_o", start)
        .agg(F.sort_array(F.collect_list(F.struct("_off", value, *others))).alias("_w"))
        .filter(F.size("_w") == seq)
    )
    outputs = (
        placed.filter(F.col("_off") >= 0)
        .groupBy(*s.keys, own.alias("_o"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == pred)
        .drop("_n")
    )
    return inputs.join(outputs, [*s.keys, "_o"], "left_semi").select(
        *s.keys,
        (F.col(start) + S.seconds(s.step * pred) * F.col("_o")).alias("origin"),
        (F.concat(*[F.col(f"_w.{c}") for c in (value, *others)]) if others else F.col(f"_w.{value}")).alias("input"),
    )


def rolling_origin(windows: DataFrame, s: Series, predicted, pred: int = PRED_LEN,
                   out: str = "Predicted") -> DataFrame:
    """One row per forecast step. ``predicted`` maps the ``input`` column to an array of
    ``pred`` values."""
    steps = F.posexplode(F.slice(predicted, 1, pred)).alias("step", out)
    return windows.select(*s.keys, "origin", steps).withColumn(
        s.time, F.col("origin") + S.seconds(s.step) * F.col("step")
    )


def tail_validation(df: DataFrame, s: Series, share: float = 0.1,
                    least: int = SEQ_LEN + PRED_LEN + 1) -> DataFrame:
    """Add ``is_validation``: the last max(share of rows, ``least``) rows of each series."""
    placed = S.numbered(df, s)
    total = F.col("_before") + F.col("_count") + F.col("_after")
    held = F.greatest(F.floor(total * F.lit(share)), F.lit(least))
    return S.without_helpers(placed.withColumn("is_validation", F.col("_pos") >= total - held))
