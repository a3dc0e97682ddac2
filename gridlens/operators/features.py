"""Lag, rolling and anomaly features over each client's own rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators import series as S
from gridlens.operators.series import Series

# Steps of the four consumption lags on 15-minute data.
LAG_NAMES = {1: "Lag_15min", 4: "Lag_1h", 96: "Lag_24h", 672: "Lag_1week"}


def gap_report(df: DataFrame, s: Series, step: int | None = None) -> DataFrame:
    """Rows whose distance to the row before is not one step."""
    gap = S.epoch(s.time) - S.epoch("Previous")
    return (
        S.with_context(df.select(*s.keys, s.time), s)
        .withColumn("Previous", S.previous_time(s))
        .filter(F.col("Previous").isNotNull())
        .withColumn("gap_seconds", gap)
        .filter(F.col("gap_seconds") != (step or s.step))
        .select(*s.keys, s.time, "Previous", "gap_seconds")
    )


def lag_columns(w, value: str, names: dict[int, str]) -> dict[str, Column]:
    return {name: F.lag(value, n).over(w) for n, name in names.items()}


def past_mean(w, value: str, n: int) -> Column:
    """Mean of the ``n`` rows before this one; NULL unless all are known."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def long_mean(df: DataFrame, s: Series, values: Sequence[str], n: int, least: int) -> DataFrame:
    """Add ``_mean_<v>`` over ``n`` rows, this one included; NULL under ``least`` known rows.

    Running sums inside the block and one lag, because Spark adds up a sliding frame anew for
    every row.
    """
    w = S.block_window(s)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {}
    for v in values:
        sums[f"_sum_{v}"] = F.coalesce(F.sum(v).over(run), F.lit(0.0))
        sums[f"_known_{v}"] = F.count(v).over(run)
    summed = df.withColumns(sums)
    means = {}
    for v in values:
        known = F.col(f"_known_{v}") - F.lag(f"_known_{v}", n, 0).over(w)
        total = F.col(f"_sum_{v}") - F.lag(f"_sum_{v}", n, 0.0).over(w)
        means[f"_mean_{v}"] = F.when(known >= least, total / known)
    return summed.withColumns(means).drop(*sums)


def add_lags(df: DataFrame, s: Series, names: dict[int, str] = LAG_NAMES,
             value: str = "Consumption", regular: bool = False) -> DataFrame:
    """``value`` so many rows back. Rows are counted, not time; fill the grid first for gaps."""
    spread = S.blocks(df, s, behind=max(names), regular=regular)
    return S.core(spread.withColumns(lag_columns(S.block_window(s), value, names)))


def weather_lags(df: DataFrame, s: Series, n: int = 96, values: Sequence[str] = ("HDH", "CDH"),
                 suffix: str = "_lag24h", regular: bool = False) -> DataFrame:
    spread = S.blocks(df, s, behind=n, regular=regular)
    w = S.block_window(s)
    return S.core(spread.withColumns({f"{v}{suffix}": F.lag(v, n).over(w) for v in values}))


def rolling_mean_past(df: DataFrame, s: Series, n: int = 16, value: str = "Consumption",
                      name: str = "Rolling_Mean_4h", regular: bool = False) -> DataFrame:
    spread = S.blocks(df, s, behind=n, regular=regular)
    return S.core(spread.withColumn(name, past_mean(S.block_window(s), value, n)))


def weather_anomaly(df: DataFrame, s: Series, n: int = 2880, least: int = 96,
                    values: Sequence[str] = ("HDH", "CDH"), regular: bool = False) -> DataFrame:
    """Value minus its mean over ``n`` rows."""
    spread = long_mean(S.blocks(df, s, behind=n, regular=regular), s, values, n, least)
    return S.core(
        spread.withColumns({f"{v}_anomaly": F.col(v) - F.col(f"_mean_{v}") for v in values}).drop(
            *[f"_mean_{v}" for v in values]
        )
    )


def add_lags_and_rolling(
    df: DataFrame,
    s: Series,
    names: dict[int, str] = LAG_NAMES,
    day: int = 96,
    rolling: int = 16,
    baseline: int = 2880,
    baseline_least: int = 96,
    value: str = "Consumption",
    weather: Sequence[str] = ("HDH", "CDH"),
    regular: bool = False,
) -> DataFrame:
    """All feature columns from one block spread and one sort.

    Rows without the longest lag or the full rolling mean are dropped, as in each operator's
    own rule; gaps in the other columns stay NULL.
    """
    behind = max(*names, day, rolling, baseline)
    w = S.block_window(s)
    spread = S.blocks(df, s, behind=behind, regular=regular)
    wide = long_mean(spread, s, weather, baseline, baseline_least)
    wide = wide.withColumns(
        {
            **lag_columns(w, value, names),
            "Rolling_Mean_4h": past_mean(w, value, rolling),
            **{f"{v}_lag24h": F.lag(v, day).over(w) for v in weather},
            **{f"{v}_anomaly": F.col(v) - F.col(f"_mean_{v}") for v in weather},
        }
    )
    kept = S.core(wide).drop(*[f"_mean_{v}" for v in weather])
    return kept.na.drop(subset=[names[max(names)], "Rolling_Mean_4h"])


def order_series(df: DataFrame, s: Series) -> DataFrame:
    """Rows of a client in time order inside their partition, split by range so that one client
    may span several; no global sort."""
    order = [*s.keys, s.time]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)
