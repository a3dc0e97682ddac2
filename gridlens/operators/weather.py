"""National weather from stations, and its join with readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.dates import floor_hour
from gridlens.functions.values import BASE_TEMPERATURE, degree_hours
from gridlens.operators.joins import attach

# Population (thousands) of the weather stations' cities.
STATION_WEIGHTS = {"Lisbon": 547, "Porto": 237, "Faro": 64, "Evora": 56}


def national_temperature(stations: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean temperature per hour over the stations that report one.

    Readings of one station in one hour (a repeated local hour, say) are averaged first, so an
    hour is one row and the later join cannot fan out.
    """
    table = weights or STATION_WEIGHTS
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hourly = (
        stations.withColumn("Date", floor_hour("Date"))
        .groupBy("Date", "station")
        .agg(F.avg("temp").alias("temp"))
        .withColumn("_w", F.try_element_at(lookup, F.col("station")).cast("double"))
        .filter(F.col("_w").isNotNull() & F.col("temp").isNotNull())
    )
    return hourly.groupBy("Date").agg(
        (F.sum(F.col("temp") * F.col("_w")) / F.sum("_w")).alias("temp")
    )


def national_weather(stations: DataFrame, weights: dict[str, float] | None = None,
                     base: float = BASE_TEMPERATURE) -> DataFrame:
    return national_temperature(stations, weights).select(
        "Date", *degree_hours(F.col("temp"), base)
    )


def join_weather(df: DataFrame, weather: DataFrame, time: str = "Date") -> DataFrame:
    """Left join on the floored hour; every reading stays."""
    hourly = weather.withColumnRenamed("Date", "_hour")
    return attach(df.withColumn("_hour", floor_hour(time)), hourly, ["_hour"], "left").drop("_hour")
