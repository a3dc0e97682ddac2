"""From clients to cluster series and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators.joins import attach


def attach_segments(df: DataFrame, segments: DataFrame, client: str = "ClientID") -> DataFrame:
    """Cluster and tier onto every row; clients not seen in training stay NULL."""
    return attach(df, segments, [client], "left")


def client_cluster_map(df: DataFrame, client: str = "ClientID", cluster: str = "Cluster") -> DataFrame:
    return df.groupBy(client).agg(F.max(cluster).alias(cluster))


def cluster_series(df: DataFrame, means: Sequence[str], firsts: Sequence[str] = (),
                   flags: Sequence[str] = (), cluster: str = "Cluster",
                   time: str = "Date") -> DataFrame:
    """One row per cluster and stamp: mean of client values, weather and flags as they are.

    Weather depends on the stamp only, so ``max`` picks the value without hanging on row order.
    """
    return df.groupBy(cluster, time).agg(
        *[F.avg(c).alias(c) for c in means],
        *[F.max(c).alias(c) for c in firsts],
        *[F.max(F.col(c).cast("int")).alias(c) for c in flags],
    )


def safe_merge(df: DataFrame, forecast: DataFrame, column: str = "Predicted_Consumption_Scaled",
               cluster: str = "Cluster", time: str = "Date") -> DataFrame:
    """Cluster forecast onto client rows; an older column of that name is replaced."""
    return attach(
        df.drop(column), forecast.select(cluster, time, column), [cluster, time], "left"
    )
