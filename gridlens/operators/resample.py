"""Regular time grids: averaging down, filling up, and mirroring the past into the future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.dates import calendar_features, flag_holidays
from gridlens.operators import series as S
from gridlens.operators.series import Series

HOUR = 3600


def floor_step(time: str, step: int) -> Column:
    return S.from_epoch(F.floor(S.epoch(time) / F.lit(step)) * step)


def densify(df: DataFrame, s: Series, step: int, last_span: int | None = None) -> DataFrame:
    """Repeat each row at every ``step`` up to the next row of its series.

    A row knows the stamp after it, so the missing steps are generated in place; there is no
    grid table and no join with one. The newest row is repeated over ``last_span`` seconds, or
    stays single.
    """
    last_end = (
        F.col(s.time) if last_span is None else F.col(s.time) + S.seconds(last_span - step)
    )
    until = F.when(F.col("_until").isNull(), last_end).otherwise(
        F.greatest(F.col(s.time), F.col("_until") - S.seconds(step))
    )
    steps = F.sequence(F.col(s.time), until, S.seconds(step))
    return S.without_helpers(
        S.with_context(df, s)
        .withColumn("_until", S.next_time(s))
        .withColumn("_step_time", F.explode(steps))
        .withColumn(s.time, F.col("_step_time")),
        "_until",
        "_step_time",
    ).select(df.columns)


def resample_mean_ffill(df: DataFrame, s: Series, values: Sequence[str], step: int = HOUR) -> DataFrame:
    """Mean per step, with empty steps filled from the step before."""
    means = df.groupBy(*s.keys, floor_step(s.time, step).alias(s.time)).agg(
        *[F.avg(v).alias(v) for v in values]
    )
    coarse = Series(s.keys, s.time, step)
    return densify(S.fill_forward(means, coarse, values), coarse, step)


def upsample_ffill(df: DataFrame, s: Series, step: int = 900, fill_last_hour: bool = False) -> DataFrame:
    """Finer grid by repetition. The newest row stays single unless ``fill_last_hour``."""
    return densify(df, s, step, s.step if fill_last_hour else None)


def asfreq_ffill(df: DataFrame, s: Series, values: Sequence[str], step: int | None = None) -> DataFrame:
    """Dense grid from each series' first stamp, without averaging; off-grid rows are left out."""
    step = step or s.step
    on_grid = (S.epoch(s.time) - S.epoch("_first_time")) % step == 0
    aligned = S.without_helpers(S.with_context(df, s).filter(on_grid)).select(df.columns)
    return densify(S.fill_forward(aligned, s, values), s, step)


def hourly_block_mean(df: DataFrame, keys: Sequence[str], place: str, values: Sequence[str],
                      size: int = 4) -> DataFrame:
    """Mean of each ``size`` consecutive steps; ``place`` numbers the steps from 0."""
    return df.groupBy(*keys, F.floor(F.col(place) / size).alias("block")).agg(
        *[F.avg(v).alias(v) for v in values]
    )


def mirror_future(history: DataFrame, requests: DataFrame, origin: Column, s: Series,
                  request: str = "request_id", client: str = "ClientID",
                  horizon: str = "horizon_steps") -> DataFrame:
    """Future rows of each request: the client's rows one year before, in order.

    ``requests`` has one row per request with its client and number of steps. When the year-old
    window holds fewer rows than asked for it is repeated. Calendar columns are computed for
    the new stamps; every other column is the mirrored one. Requests without any old row, and those
    for no step at all (0, negative or NULL), give no rows here (see ``request_errors``).
    """
    requests = requests.filter(F.col(horizon) > 0)
    start = origin - F.expr("INTERVAL '1' YEAR")
    step = F.expr(f"INTERVAL '{s.step}' SECOND")
    longest = requests.agg(F.max(horizon)).scalar()
    window = history.filter(
        (F.col(s.time) >= start) & (F.col(s.time) <= start + step * longest)
    )
    # At most one horizon of rows per client is left, so this sort is short.
    order = Window.partitionBy(client).orderBy(s.time)
    placed = window.withColumn("_idx", F.row_number().over(order) - 1)
    sizes = requests.select(request, client, horizon).join(
        placed.select(client, s.time), client
    ).filter(F.col(s.time) <= start + step * F.col(horizon)).groupBy(request, client, horizon).agg(
        F.least(F.count(F.lit(1)), F.first(horizon)).alias("_m")
    )
    steps = sizes.withColumn("step", F.explode(F.sequence(F.lit(0), F.col(horizon) - 1)))
    steps = steps.withColumn("_idx", (F.col("step") % F.col("_m")).cast("int"))
    mirrored = steps.join(placed.drop(s.time), [client, "_idx"]).withColumn(
        s.time, origin + step * F.col("step")
    )
    dated = flag_holidays(calendar_features(mirrored, s.time), s.time)
    return dated.drop("_idx", "_m", horizon)
