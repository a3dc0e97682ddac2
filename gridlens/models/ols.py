"""One linear model per cluster on calendar, weather and lag features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.models.linalg import gram, predict, solve
from gridlens.operators.reshape import LEVELS, dummy_names

WEATHER = ["HDH", "CDH", "HDH_lag24h", "CDH_lag24h", "HDH_anomaly", "CDH_anomaly"]
FLAGS = ["Is_Weekend", "Is_Holiday"]
SCALED_LAGS = ["Lag_24h_Scaled", "Lag_1week_Scaled"]
TARGET = "Consumption_Scaled"

# Columns that are not features of the linear model (the target, raw lags, and
# the short lags that are not known a day ahead).
NOT_FEATURES = [
    "Date", "ClientID", "Consumption", "Consumption_Scaled", "Lag_15min", "Lag_1h", "Lag_24h",
    "Lag_1week", "Rolling_Mean_4h", "Lag_15min_Scaled", "Lag_1h_Scaled",
    "Rolling_Mean_4h_Scaled", "Temp_National_Avg",
]
NEEDED = [
    "Consumption_Scaled", "Lag_15min_Scaled", "Lag_1h_Scaled", "Lag_24h_Scaled",
    "Lag_1week_Scaled", "Rolling_Mean_4h_Scaled",
]


def regressors(mode: str, columns: Sequence[str], flags: bool = True) -> list[str]:
    """Outside inputs of a cluster model: weather, flags, and for ``day_ahead`` the scaled lags;
    only those the table has (a scaled lag counts as present when its raw lag is)."""
    if mode not in ("long_term", "day_ahead"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = WEATHER + (FLAGS if flags else [])
    if mode == "day_ahead":
        wanted = wanted + SCALED_LAGS
    return [c for c in wanted if c in columns or c.removesuffix("_Scaled") in columns]


def select_model_columns(df: DataFrame) -> DataFrame:
    return df.drop(*NOT_FEATURES)


def feature_names(columns: Sequence[str]) -> list[str]:
    """Feature order of the full linear model over the columns a table has."""
    levels = {c: v for c, v in LEVELS.items() if c in columns}
    plain = [c for c in [*FLAGS, *WEATHER] if c in columns]
    lags = [c for c in SCALED_LAGS if c in columns or c.removesuffix("_Scaled") in columns]
    return plain + lags + dummy_names(levels)


def fit(train: DataFrame, features: Sequence[str], cluster: str = "Cluster",
        target: str = TARGET) -> DataFrame:
    """Coefficients of all clusters from one pass over the training rows."""
    sums = gram(train, [cluster], features, [target])
    return solve(sums, [cluster], len(features), [target]).drop("target")


def predict_scaled(test: DataFrame, coefs: DataFrame, features: Sequence[str],
                   cluster: str = "Cluster",
                   out: str = "Predicted_Consumption_Scaled") -> DataFrame:
    """Scaled prediction, not below the scaled value of 0 kW (rows carry ``mean``/``std``)."""
    scored = predict(test, coefs, [cluster], features, out)
    floor = -F.col("mean") / F.col("std")
    capped = F.when(F.col(out).isNotNull() & floor.isNotNull(), F.greatest(F.col(out), floor))
    return scored.withColumn(out, F.coalesce(capped, F.col(out)))
