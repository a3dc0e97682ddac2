"""Filters that decide which rows and clients stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.operators.joins import attach


def split_by_date(df: DataFrame, cut: Column, time: str = "Date") -> tuple[DataFrame, DataFrame]:
    """Rows before ``cut`` and rows from it on. Plain range tests, which reach the file scan."""
    return df.filter(F.col(time) < cut), df.filter(F.col(time) >= cut)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def trim_inactive_start(df: DataFrame, client: str = "ClientID", time: str = "Date",
                        value: str = "Consumption") -> DataFrame:
    """Drop each client's rows before its first use; clients with no use go entirely."""
    starts = (
        df.filter(F.col(value) > 0).groupBy(client).agg(F.min(time).alias("_start"))
    )
    return (
        attach(df, starts, [client], "inner")
        .filter(F.col(time) >= F.col("_start"))
        .drop("_start")
        .select(df.columns)
    )


def recent_consumption(df: DataFrame, days: int = 30, client: str = "ClientID",
                       time: str = "Date", value: str = "Consumption") -> DataFrame:
    """Each client's sum from (newest stamp of all − ``days``) on, that stamp included."""
    newest = df.agg(F.max(time)).scalar()
    return (
        df.filter(F.col(time) >= newest - F.expr(f"INTERVAL '{days}' DAY"))
        .groupBy(client)
        .agg(F.sum(value).alias("recent"))
    )


def keep_active_clients(df: DataFrame, days: int = 30, floor: float = 1.0,
                        client: str = "ClientID", time: str = "Date",
                        value: str = "Consumption") -> DataFrame:
    """Clients whose recent sum is above ``floor``."""
    active = recent_consumption(df, days, client, time, value).filter(F.col("recent") > floor)
    return attach(df, active.select(client), [client], "left_semi")


def clean_clients(df: DataFrame, days: int = 30, floor: float = 1.0, client: str = "ClientID",
                  time: str = "Date", value: str = "Consumption") -> DataFrame:
    """Trim first, then judge activity on what is left."""
    trimmed = trim_inactive_start(df, client, time, value)
    return keep_active_clients(trimmed, days, floor, client, time, value)


def data_quality(before: DataFrame, after: DataFrame, value: str = "Consumption",
                 client: str = "ClientID") -> DataFrame:
    """Row, client and missing-cell counts of two stages, one row each."""
    def stage(df: DataFrame, name: str) -> DataFrame:
        # Two steps instead of count(distinct): each client is reduced before the last sum.
        per_client = df.groupBy(client).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("m")
        )
        return per_client.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(client).alias("clients"),
            F.coalesce(F.sum("m"), F.lit(0)).alias("missing"),
        ).select(F.lit(name).alias("stage"), "rows", "clients", "missing")

    return stage(before, "before").unionByName(stage(after, "after"))
