"""From raw wide readings to the processed feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.dates import calendar_features, flag_holidays
from gridlens.operators import clean, merge, reshape, segment
from gridlens.operators.features import LAG_NAMES, add_lags_and_rolling
from gridlens.operators.series import Series
from gridlens.operators.weather import join_weather, national_weather
from gridlens.session import cut_lineage, scope
from gridlens.sources import meters


def long_readings(wide: DataFrame) -> DataFrame:
    """Calendar columns on the few wide rows, then one row per client and stamp."""
    return reshape.melt_clients(flag_holidays(calendar_features(wide)))


def segments(train: DataFrame, k: int = 5, seed: int = 42, starts: int = 10) -> DataFrame:
    """One row per client: Cluster by day shape, tier by size, learnt from training rows only."""
    scaled = segment.row_minmax(reshape.hourly_profile_matrix(train))
    clusters = segment.profile_clusters(scaled, k, seed, starts)
    # Written once: a break is one of these very values, and sums may differ in the last bit.
    means = cut_lineage(segment.log_mean(client_mean(train)))
    tiers = segment.volume_segments(means, segment.jenks_breaks(means, "log_mean"))
    # Written once: one short row a client, behind all of the profiles.
    return cut_lineage(clusters.join(tiers.select("ClientID", "Consumer_Category"), "ClientID"))


def client_mean(train: DataFrame, client: str = "ClientID", value: str = "Consumption") -> DataFrame:
    return train.groupBy(client).agg(F.avg(value).alias("mean"))


def process_data(
    readings: DataFrame,
    weather: DataFrame,
    cut: Column,
    s: Series = Series(),
    names: dict[int, str] = LAG_NAMES,
    day: int = 96,
    rolling: int = 16,
    baseline: int = 2880,
    baseline_least: int = 96,
    active_days: int = 30,
    k: int = 5,
    starts: int = 10,
) -> DataFrame:
    """Clean, add weather and lags, segment on the rows before ``cut``, and label all rows."""
    kept = clean.clean_clients(readings, active_days)
    # Written once: the segments below read it several times, and so does the last join.
    featured = cut_lineage(
        add_lags_and_rolling(
            join_weather(kept, weather), s, names, day, rolling, baseline, baseline_least
        )
    )
    train, _ = clean.split_by_date(featured, cut)
    return merge.attach_segments(featured, segments(train, k, starts=starts))


def run_process_data(spark: SparkSession, readings_path: str, weather_path: str, cut: Column,
                     out_path: str, **how) -> DataFrame:
    """From the raw wide file and the weather replies to the written feature table, read back.

    ``how`` goes to ``process_data``. Intermediate tables are cleared.
    """
    with scope(spark):
        wide = meters.read_meter_csv(spark, readings_path)
        wide = meters.dedupe_timestamps(wide, [c for c in wide.columns if c != "Date"])
        hours = national_weather(meters.read_station_weather(spark, weather_path), base=how.pop("base", 18.0))
        meters.write_features(process_data(long_readings(wide), hours, cut, **how), out_path)
    return meters.read_features(spark, out_path)
