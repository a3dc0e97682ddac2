"""Running totals and exact quantiles over a number, without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 200_000
MAX_SPLITS = 10_000


def value_buckets(df: DataFrame, value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``_bucket``: value ranges of about equal row count.

    The split points come from Spark's quantile sketch. They only decide which task sorts a
    value, so an inexact split never changes a result.
    """
    n = df.count()
    wanted = min(MAX_SPLITS, n // bucket_rows)
    points: list[float] = []
    if wanted > 1:
        probs = [i / wanted for i in range(1, wanted)]
        sketch = df.agg(F.percentile_approx(value, probs, MAX_SPLITS).alias("p")).first()["p"]
        points = sorted(set(sketch or []))
    splits = [float("-inf"), *points, float("inf")]
    if len(splits) < 3:
        return df.withColumn("_bucket", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(df)


def running_totals(
    df: DataFrame,
    value: str,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``_cum_<m>``: the sum of each measure over rows with a value up to this one.

    Values must be unique within ``keys`` (group equal values and add their weights first).
    """
    bucketed = value_buckets(df, value, bucket_rows)
    cell = [*keys, "_bucket"]
    totals = bucketed.groupBy(*cell).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    past = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *cell, *[F.coalesce(F.sum(f"_t_{m}").over(past), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    here = Window.partitionBy(*cell).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = bucketed.join(offsets, cell).withColumns(
        {f"_cum_{m}": F.sum(m).over(here) + F.col(f"_o_{m}") for m in measures}
    )
    return summed.drop("_bucket", *[f"_o_{m}" for m in measures])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per group; one row per group, one column per name.

    Equal values are counted once with a weight, so copies of one value cost one row.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counted, value, ["_n"], keys, bucket_rows)
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    placed = ranked.join(sizes, list(keys)).withColumn("_lo", F.col("_cum__n") - F.col("_n"))

    def at(rank):
        holds = (F.col("_lo") <= rank) & (rank < F.col("_cum__n"))
        return F.max(F.when(holds, F.col(value)))

    picks, out = [], []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("_size") - 1)
        picks += [
            at(F.floor(place)).alias(f"_f_{name}"),
            at(F.ceil(place)).alias(f"_c_{name}"),
            F.max(place - F.floor(place)).alias(f"_w_{name}"),
        ]
        low, high, weight = (F.col(f"_{x}_{name}") for x in "fcw")
        out.append((low + (high - low) * weight).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *out)
