"""Standard scaling per client and over all rows, and the way back to kW."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.values import clamp_nonneg
from gridlens.operators.joins import attach


def _mean_std(value: str) -> tuple[Column, Column]:
    flat = F.max(value) == F.min(value)
    return F.avg(value), F.when(flat, F.lit(1.0)).otherwise(F.stddev_pop(value))


def fit_client_scaler(train: DataFrame, client: str = "ClientID",
                      value: str = "Consumption") -> DataFrame:
    """Mean and population deviation per client; a constant client gets deviation 1."""
    mean, std = _mean_std(value)
    return (
        train.filter(F.col(value).isNotNull())
        .groupBy(client)
        .agg(mean.alias("mean"), std.alias("std"))
    )


def fit_global_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``mean_<c>`` and ``std_<c>``."""
    stats = []
    for c in cols:
        mean, std = _mean_std(c)
        stats += [mean.alias(f"mean_{c}"), std.alias(f"std_{c}")]
    return train.agg(*stats)


def apply_global_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale in place. The one row of statistics is read once and becomes plain numbers."""
    row = scaler.first().asDict()
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(row[f"mean_{c}"]).cast("double"))
            / F.lit(row[f"std_{c}"]).cast("double")
            for c in cols
        }
    )


def apply_scaler_join(df: DataFrame, scaler: DataFrame, cols: Sequence[str],
                      client: str = "ClientID", keep_stats: bool = False) -> DataFrame:
    """Add ``<c>_Scaled`` with the client's consumption scaler; unknown clients stay NULL."""
    joined = attach(df, scaler.select(client, "mean", "std"), [client], "left")
    scaled = joined.withColumns(
        {f"{c}_Scaled": (F.col(c) - F.col("mean")) / F.col("std") for c in cols}
    )
    return scaled if keep_stats else scaled.drop("mean", "std")


def inverse_scale(df: DataFrame, scaler: DataFrame, scaled: str = "Predicted_Consumption_Scaled",
                  out: str = "Predicted_kW", client: str = "ClientID") -> DataFrame:
    """Scaled value back to kW, floored at 0; NULL without a scaler or a value."""
    if "std" in df.columns:
        return df.withColumn(out, clamp_nonneg(F.col(scaled) * F.col("std") + F.col("mean")))
    joined = attach(df, scaler.select(client, "mean", "std"), [client], "left")
    return joined.withColumn(
        out, clamp_nonneg(F.col(scaled) * F.col("std") + F.col("mean"))
    ).drop("mean", "std")
