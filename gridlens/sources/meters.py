"""Readers and writers for meter readings, weather files and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stamp formats accepted in a raw file, tried in this order.
STAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
]
UNNAMED_FIRST = "_c0"


def require_time_column(df: DataFrame) -> str:
    """The name of the time column; raises before any job runs when there is none."""
    for name in ("Date", UNNAMED_FIRST):
        if name in df.columns:
            return name
    raise KeyError(f"no time column among {df.columns[:5]}")


def parse_stamp(col: Column) -> Column:
    tries = [F.try_to_timestamp(F.trim(col), F.lit(f)) for f in STAMP_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_comma_number(col: Column) -> Column:
    return F.regexp_replace(F.trim(col), ",", ".").try_cast("double")


def _raw_cells(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The text cells of a wide ``;`` file and, by column name, what they are read as."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    time = require_time_column(raw)
    cells = raw.withColumnRenamed(time, "Date") if time != "Date" else raw
    readings = [c for c in cells.columns if c != "Date"]
    return cells, {"Date": parse_stamp(F.col("Date"))} | {c: parse_comma_number(F.col(f"`{c}`")) for c in readings}


def _unread(cell: Column, parsed: Column) -> Column:
    return parsed.isNull() & (F.trim(cell) != "")


def read_meter_csv(spark: SparkSession, path: str | list[str], bad: str = "raise") -> DataFrame:
    """A wide ``;`` file with decimal commas: ``Date`` and one double per client.

    A cell that holds something unreadable ends the job with its text. With ``bad="null"`` it
    becomes NULL; ``unread_cells`` then says how many there are. Empty cells are NULL.
    """
    if bad not in ("raise", "null"):
        raise ValueError(f"bad is 'raise' or 'null', not {bad!r}")
    cells, parsed = _raw_cells(spark, path)

    def checked(name: str, value: Column) -> Column:
        cell = F.col(f"`{name}`")
        told = F.raise_error(F.concat(F.lit(f"column {name} holds an unreadable cell: "), cell))
        return F.when(_unread(cell, value), told).otherwise(value)

    return cells.select(*[
        (checked(name, value) if bad == "raise" else value).alias(name) for name, value in parsed.items()
    ])


def unread_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(column, cells) for columns of a wide ``;`` file: how many cells hold something unreadable."""
    cells, parsed = _raw_cells(spark, path)
    counts = cells.agg(*[F.count_if(_unread(F.col(f"`{c}`"), v)).alias(c) for c, v in parsed.items()])
    return counts.unpivot([], [F.col(f"`{c}`") for c in parsed], "column", "cells")


def _nulls_last(names: Sequence[str]) -> Column:
    return F.struct(*[part for c in names for part in (F.col(c).isNull(), F.col(c))])


def dedupe_timestamps(df: DataFrame, tie: Sequence[str], time: str = "Date") -> DataFrame:
    """One row per stamp: the one with the smallest ``tie`` columns, NULL after all values.

    An aggregate rather than a row number, so copies of one stamp are reduced before the
    shuffle and never meet in one sort. Rows without a stamp are no copies: all of them stay.
    """
    return dedupe_series(df, [], tie, time)


def dedupe_series(df: DataFrame, keys: Sequence[str], tie: Sequence[str], time: str = "Date") -> DataFrame:
    """The same for long tables: one row per key and stamp."""
    group = [*keys, time]
    others = [c for c in df.columns if c not in group]
    dated = df.where(F.col(time).isNotNull())
    picked = dated.groupBy(*group).agg(F.min_by(F.struct(*others), _nulls_last(tie)).alias("_row"))
    return picked.select(*group, "_row.*").select(df.columns).union(df.where(F.col(time).isNull()))


def write_features(
    df: DataFrame,
    path: str,
    client: str = "ClientID",
    time: str = "Date",
    files: int | None = None,
) -> None:
    """Parquet by year, each file sorted by client and time.

    The range split is on (year, client, time), so one very large client still spreads over
    many files.
    """
    by_year = df.withColumn("year", F.year(time))
    order = ["year", client, time]
    ranged = (
        by_year.repartitionByRange(files, *order) if files else by_year.repartitionByRange(*order)
    )
    ranged.sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("year").parquet(path)


def read_features(
    spark: SparkSession,
    path: str,
    years: Sequence[int] | None = None,
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Only the named years' folders and columns are read."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.filter(F.col("year").isin(list(years)))
    return df.select(*cols) if cols is not None else df


WEATHER_SCHEMA = (
    "station string, hourly struct<time: array<string>, temperature_2m: array<double>>"
)


def read_station_weather(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON replies, one per line, each with parallel arrays of hours and temperatures."""
    replies = spark.read.schema(WEATHER_SCHEMA).json(path)
    pairs = F.explode(F.arrays_zip("hourly.time", "hourly.temperature_2m")).alias("p")
    return replies.select("station", pairs).select(
        "station",
        F.coalesce(
            F.try_to_timestamp(F.col("p.time"), F.lit("yyyy-MM-dd'T'HH:mm")),
            parse_stamp(F.col("p.time")),
        ).cast("timestamp_ntz").alias("Date"),
        F.col("p.temperature_2m").alias("temp"),
    )
