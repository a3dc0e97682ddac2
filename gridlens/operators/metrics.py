"""Forecast errors: overall, per cluster, per period, side by side."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.operators.joins import attach
from gridlens.operators.ranks import exact_quantiles

THRESHOLD = 0.1
EPOCH = datetime(1970, 1, 1)


def abs_error(actual: str = "Actual_kW", predicted: str = "Predicted_kW") -> Column:
    return F.abs(F.col(actual) - F.col(predicted))


def mape(actual: str = "Actual_kW", predicted: str = "Predicted_kW",
         threshold: float = THRESHOLD) -> Column:
    """Mean absolute percentage error over rows with an actual above ``threshold``."""
    share = abs_error(actual, predicted) / F.col(actual)
    return F.avg(F.when(F.col(actual) > threshold, share)) * 100


def wmape(actual: str = "Actual_kW", predicted: str = "Predicted_kW") -> Column:
    """Sum of errors over sum of actuals, NULL when the latter is 0."""
    total = F.sum(F.abs(F.col(actual)))
    return F.try_divide(F.sum(abs_error(actual, predicted)), total) * 100


def portfolio_sum(df: DataFrame, cluster: str = "Cluster", time: str = "Date") -> DataFrame:
    """Actual and predicted load per cluster and stamp, over rows that have both."""
    return (
        df.na.drop(subset=["Actual_kW", "Predicted_kW"])
        .groupBy(cluster, time)
        .agg(F.sum("Actual_kW").alias("Actual_kW"), F.sum("Predicted_kW").alias("Predicted_kW"))
    )


def cluster_metrics(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Both errors per cluster and once over all rows (``Global``), in one pass."""
    name = F.when(F.grouping(cluster) == 1, F.lit("Global")).otherwise(
        F.col(cluster).cast("string")
    )
    return (
        df.rollup(cluster)
        .agg(
            name.alias("_name"),
            F.round(mape(), 2).alias("Portfolio_MAPE"),
            F.round(wmape(), 2).alias("Portfolio_WMAPE"),
        )
        .select(F.col("_name").alias("Cluster"), "Portfolio_MAPE", "Portfolio_WMAPE")
    )


def with_period(df: DataFrame, n: int = 4, time: str = "Date") -> DataFrame:
    """Add ``period`` 1…n: equal spans of time, closed on the right, and its label.

    The first and last stamp are read first, so that the edges are plain numbers in the plan.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    if lo is None:
        return df.withColumns(
            {"period": F.lit(None).cast("int"), "Time_Period": F.lit(None).cast("string")}
        )
    width = (hi - lo) / n
    # The first edge lies 0.1 % of the whole span before the first stamp.
    edges = [lo - (hi - lo) * 0.001, *[lo + width * k for k in range(1, n + 1)]]
    days = [(EPOCH + timedelta(microseconds=int(e // 1))).strftime("%b %d") for e in edges]
    number = F.lit(1) if hi == lo else F.least(
        F.greatest(F.ceil((t - lo) / F.lit(width)), F.lit(1)), F.lit(n)
    )
    names = F.array(*[F.lit(f"{a} to {b}") for a, b in zip(days, days[1:])])
    return df.withColumn("period", number.cast("int")).withColumn(
        "Time_Period", F.element_at(names, F.col("period"))
    )


def period_metrics(df: DataFrame, n: int = 4, time: str = "Date") -> DataFrame:
    complete = df.na.drop(subset=["Actual_kW", "Predicted_kW"])
    return (
        with_period(complete, n, time)
        .groupBy("period", "Time_Period")
        .agg(F.round(mape(), 2).alias("MAPE"), F.round(wmape(), 2).alias("WMAPE"))
    )


def error_box_stats(df: DataFrame, n: int = 4, time: str = "Date") -> DataFrame:
    """Quartiles and whiskers of both error kinds per period, for a box plot without outliers."""
    complete = with_period(df.na.drop(subset=["Actual_kW", "Predicted_kW"]), n, time)
    error = abs_error()
    kinds = F.array(
        F.struct(F.lit("Abs_Error").alias("kind"), error.alias("error")),
        F.struct(
            F.lit("APE").alias("kind"),
            F.when(F.col("Actual_kW") > THRESHOLD, error / F.col("Actual_kW") * 100).alias("error"),
        ),
    )
    errors = complete.select("period", F.explode(kinds).alias("k")).select("period", "k.*")
    errors = errors.filter(F.col("error").isNotNull())
    keys = ["period", "kind"]
    quartiles = exact_quantiles(errors, keys, "error", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    # Two error kinds per period: the quartile table is a handful of rows.
    fenced = attach(errors, quartiles, keys, "inner")
    inside_low = F.min(F.when(F.col("error") >= low, F.col("error")))
    inside_high = F.max(F.when(F.col("error") <= high, F.col("error")))
    return fenced.groupBy(*keys, "q1", "median", "q3").agg(
        F.least(inside_low, F.first("q1")).alias("whisker_low"),
        F.greatest(inside_high, F.first("q3")).alias("whisker_high"),
    )


def model_comparison(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row per cluster with each model's errors next to the others'."""
    names = list(metrics)
    stacked = None
    for name, table in metrics.items():
        part = table.withColumn("model", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy("Cluster").pivot("model", names).agg(
        F.max("Portfolio_MAPE").alias("MAPE"), F.max("Portfolio_WMAPE").alias("WMAPE")
    )
    return wide.select("Cluster", *[f"{m}_{k}" for m in names for k in ("MAPE", "WMAPE")])
