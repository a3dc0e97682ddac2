"""Decomposition and autocorrelation of many series at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators import series as S
from gridlens.operators.joins import attach
from gridlens.operators.runs import sorted_runs
from gridlens.operators.series import Series


def seasonal_decompose(df: DataFrame, s: Series, value: str, period: int = 96) -> DataFrame:
    """Additive trend, season and rest. The trend is a centred mean over one period whose two
    end rows count half when the period is even; rows without a full frame have none."""
    half = period // 2
    spread = S.blocks(df, s, behind=half, ahead=half)
    w = S.block_window(s)
    frame = w.rowsBetween(-half, half)
    ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
    weighted = F.sum(value).over(frame) - (ends / 2 if period % 2 == 0 else F.lit(0.0))
    full = F.count(value).over(frame) == 2 * half + 1
    trended = (
        spread.withColumn("trend", F.when(full, weighted / period))
        .transform(lambda d: S.core(d, keep_pos=True))
        .withColumn("_phase", F.col("_pos") % period)
    )
    keys = s.key_list
    phase_mean = trended.groupBy(*keys, "_phase").agg(
        F.avg(F.col(value) - F.col("trend")).alias("_raw")
    )
    # ``period`` rows per key.
    level = phase_mean.groupBy(*keys).agg(F.avg("_raw").alias("_level"))
    season = phase_mean.join(level, keys).select(
        *keys, "_phase", (F.col("_raw") - F.col("_level")).alias("seasonal")
    )
    return (
        attach(trended, season, [*keys, "_phase"], "left")
        .withColumn("resid", F.col(value) - F.col("seasonal") - F.col("trend"))
        .drop("_phase", "_pos")
    )


#: Lags from which products are made by Fourier transform.
MANY_LAGS = 512


def lagged_products(x: np.ndarray, first: int, lags: int) -> np.ndarray:
    """For lag 0 … ``lags``: the sum of x[t]·x[t − lag] over t from ``first`` on, the sums of the two
    factors, and the number of pairs. Pairs with a missing value (NaN) are left out."""
    there = ~np.isnan(x)
    x = np.where(there, x, 0.0)
    here = np.where(np.arange(len(x)) >= first, x, 0.0)
    mask = there.astype(float)
    own = np.where(np.arange(len(x)) >= first, mask, 0.0)
    pairs = ((here, x), (here, mask), (own, x), (own, mask))
    if lags >= MANY_LAGS:
        size = 1 << int(2 * len(x) - 1).bit_length()
        turned = {id(v): np.fft.rfft(v, size) for v in (here, x, own, mask)}
        out = [np.fft.irfft(turned[id(a)] * np.conj(turned[id(b)]), size)[: lags + 1] for a, b in pairs]
        out[3] = np.round(out[3])
        return np.array([np.pad(v[: len(x)], (0, max(0, lags + 1 - len(x)))) for v in out])
    return np.array([
        [float(np.dot(a[k:], b[: len(x) - k])) if k < len(x) else 0.0 for k in range(lags + 1)] for a, b in pairs
    ])


def acf(df: DataFrame, s: Series, value: str, lags: int = 192) -> DataFrame:
    """Autocorrelation per series and lag 0 … ``lags``, from one scan.

    Blocks come sorted in Arrow batches; each gives, per lag, the sum of products and what the mean
    takes from it later: the sums of both factors and the number of pairs.
    """
    keys = s.key_list
    spread = S.blocks(df.select(*keys, s.time, value), s, behind=lags).select(
        *keys, F.xxhash64(*keys).alias("_key"), "_block", "_pos", "_core", F.col(value).cast("double").alias("_x")
    )
    types = dict(df.dtypes)
    names = ["_p", "_a", "_b", "_n"]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["lag int", *[f"{n} double" for n in names]])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["_key", "_block"]):
            x = rows["_x"].to_numpy().astype(float)
            own = rows["_core"].to_numpy()
            sums = lagged_products(x, len(own) - int(own.sum()), lags)
            yield pa.RecordBatch.from_pydict(
                {k: pa.repeat(rows[k][0], lags + 1) for k in keys}
                | {"lag": pa.array(np.arange(lags + 1), pa.int32())}
                | {n: pa.array(v) for n, v in zip(names, sums)}
            )

    ordered = spread.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_pos")
    totals = ordered.mapInArrow(products, schema).groupBy(*keys, "lag").agg(*[F.sum(n).alias(n) for n in names])
    # At lag 0 both factors are the row itself.
    whole = F.max(F.when(F.col("lag") == 0, F.struct(*names))).over(Window.partitionBy(*keys))
    mean = F.try_divide(F.col("_all._a"), F.col("_all._n"))
    variance = F.col("_all._p") - mean * F.col("_all._a")
    product = F.col("_p") - mean * (F.col("_a") + F.col("_b")) + F.col("_n") * mean * mean
    return totals.withColumn("_all", whole).select(
        *keys, "lag", F.try_divide(product, variance).alias("acf")
    )


def pacf(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """Partial autocorrelation from the rows of ``acf`` by the Durbin–Levinson recursion."""
    types = dict(correlations.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["lag int", "pacf double"])

    def recursion(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy()
        out = np.ones(len(r))
        phi, error = np.zeros(0), 1.0
        for k in range(1, len(r)):
            top = r[k] - np.dot(phi, r[k - 1:0:-1][: k - 1])
            last = top / error if error > 0 else np.nan
            phi = np.append(phi - last * phi[::-1], last)
            error *= 1.0 - last * last
            out[k] = last
        table = pd.DataFrame({"lag": np.arange(len(r), dtype="int32"), "pacf": out})
        for i, k in enumerate(keys):
            table.insert(i, k, pdf[k].iloc[0])
        return table

    return correlations.groupBy(*keys).applyInPandas(recursion, schema)
