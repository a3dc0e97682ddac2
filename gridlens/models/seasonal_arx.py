"""Seasonal autoregression with outside inputs, (1,1,1)x(1,0,1,24), per cluster.

Fitted in three regressions (Hannan and Rissanen, 1982), each over all clusters at once: inputs
on the differenced series, a long autoregression for the shocks, then the final lags of series
and shocks. Behind the last known hour a forecast is linear in the state and in the inputs: a path
that depends on the state alone, made once a cluster, and the change of the inputs since that hour.
So any number of requests is a join with the cluster's path and a weighted sum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.models.linalg import gram, predict, solve
from gridlens.operators import series as S
from gridlens.operators.joins import attach
from gridlens.operators.series import Series
from gridlens.session import cut_lineage

SEASON = 24


def _lag_names(prefix: str, lags: Sequence[int]) -> dict[str, int]:
    return {f"{prefix}_{n}": n for n in lags}


def fit(train: DataFrame, s: Series, target: str, inputs: Sequence[str], season: int = SEASON):
    """``train`` is a dense hourly grid. Returns (coefficients, state): one row of weights per
    cluster, and its last ``season + 1`` rows with series, difference rest and shock.

    ``arma`` holds the weights that forecasts use. ``damped`` says that the fitted ones would have
    made them grow without end, and that they were pulled back inside the unit circle.
    """
    keys, inputs = s.key_list, list(inputs)
    rows = train.select(*keys, s.time, F.col(target).alias("y"), *inputs)
    w = S.block_window(s)
    steps = S.core(
        S.blocks(rows, s, behind=1, regular=True).withColumns(
            {"dy": F.col("y") - F.lag("y").over(w),
             **{f"d_{c}": F.col(c) - F.lag(c).over(w) for c in inputs}}
        )
    )
    moved = [f"d_{c}" for c in inputs]
    if inputs:
        beta = solve(gram(steps, keys, moved, ["dy"]), keys, len(moved), ["dy"])
        level = beta.withColumn("intercept", F.lit(0.0))
        steps = predict(steps, level, keys, moved, "_fit").withColumn(
            "u", F.col("dy") - F.coalesce("_fit", F.lit(0.0))
        ).drop("_fit", *moved)
    else:
        steps = steps.withColumn("u", F.col("dy"))

    long_lags = _lag_names("u", range(1, 2 * season + 3))
    spread = S.blocks(steps, s, behind=max(long_lags.values()), regular=True)
    lagged = S.core(spread.withColumns({n: F.lag("u", k).over(w) for n, k in long_lags.items()}))
    names = list(long_lags)
    long_fit = solve(gram(lagged, keys, names, ["u"]), keys, len(names), ["u"])
    shocks = predict(lagged, long_fit, keys, names, "_fit").withColumn(
        "e", F.col("u") - F.col("_fit")
    ).select(*keys, s.time, "y", *inputs, "u", "e")

    final = {**_lag_names("u", (1, season, season + 1)), **_lag_names("e", (1, season, season + 1))}
    spread = S.blocks(shocks, s, behind=season + 1, regular=True)
    ready = S.core(spread.withColumns({n: F.lag(n[0], k).over(w) for n, k in final.items()}))
    names = list(final)
    arma = solve(gram(ready, keys, names, ["u"]), keys, len(names), ["u"]).select(
        *keys, F.col("coef").alias("arma")
    )
    arma = _marked(arma, keys, season)
    if inputs:
        coefs = arma.join(beta.select(*keys, F.col("coef").alias("beta")), keys)
    else:
        coefs = arma.withColumn("beta", F.array().cast("array<double>"))
    return coefs, S.last_n(shocks, s, season + 1)


def damp(ar: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """Pull an explosive recursion back inside the unit circle; stable ones stay as they are."""
    order = max(lags)
    poly = np.zeros(order + 1)
    poly[0] = 1.0
    for a, k in zip(ar, lags):
        poly[k] -= a
    radius = np.abs(np.roots(poly)).max(initial=0.0)
    return ar if radius < 0.999 else ar * np.array([(0.999 / radius) ** k for k in lags])


def _marked(arma: DataFrame, keys: Sequence[str], season: int) -> DataFrame:
    """``arma`` as it is used, and whether it had to be damped."""
    types = dict(arma.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["arma array<double>, damped boolean"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fitted = [np.asarray(w, dtype=float) for w in pdf["arma"]]
        used = [damp(w[:3], (1, season, season + 1)) for w in fitted]
        out = pdf[list(keys)].copy()
        out["arma"] = [[*u, *w[3:]] for u, w in zip(used, fitted)]
        out["damped"] = [bool((u != w[:3]).any()) for u, w in zip(used, fitted)]
        return out

    return arma.groupBy(*keys).applyInPandas(one, schema)


def response(arma: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    """Weights (hour ahead, known place) of the level's change: the first season + 1 places are the last
    differences, newest first, the others the last shocks. No later shock is known, so each counts 0."""
    order = season + 1
    lags = (1, season, order)
    step = np.zeros((horizon + order, 2 * order))  # rows behind ``order``: weights of u at that hour
    step[np.arange(order), order - 1 - np.arange(order)] = 1.0
    for h in range(horizon):
        at = order + h
        step[at] = sum(a * step[at - k] for a, k in zip(arma[:3], lags))
        for m, k in zip(arma[3:], lags):
            if k > h:
                step[at, order + k - h - 1] += m
    return np.cumsum(step[order:], axis=0)


def paths(coefs: DataFrame, state: DataFrame, horizons: DataFrame, s: Series,
          season: int = SEASON) -> DataFrame:
    """Rows (keys, h, path): the level ``h`` hours after the state's last, if no input changes.
    ``horizons`` holds keys and the number of hours wanted."""
    keys, order = s.key_list, season + 1
    types = dict(state.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["h bigint, path double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(s.time, ascending=False)
        known = np.zeros(2 * order)
        for place, name in ((0, "u"), (order, "e")):
            seen = np.nan_to_num(pdf[name].to_numpy(dtype=float))[:order]
            known[place:place + len(seen)] = seen
        horizon = int(pdf["horizon"].iloc[0])
        level = float(pdf["y"].iloc[0]) + response(np.asarray(pdf["arma"].iloc[0], dtype=float), horizon, season) @ known
        out = pd.DataFrame({"h": np.arange(1, horizon + 1), "path": level})
        for n, k in enumerate(keys):
            out.insert(n, k, pdf[k].iloc[0])
        return out

    ready = state.join(coefs.select(*keys, "arma"), keys).join(horizons.filter("horizon > 0"), keys)
    return ready.select(*keys, s.time, "y", "u", "e", "arma", "horizon").groupBy(*keys).applyInPandas(one, schema)


def forecast(coefs: DataFrame, state: DataFrame, future: DataFrame, s: Series,
             inputs: Sequence[str], season: int = SEASON,
             out: str = "Predicted_Consumption_Scaled", keep: Sequence[str] = ()) -> DataFrame:
    """``future`` holds keys, stamp and inputs, for hours after the state's last row; any number of
    rows may ask for the same hour. Hours at or before the origin get no row.

    An input that is not known, then or at the origin, counts as unchanged since the origin.
    """
    keys, inputs = s.key_list, list(inputs)
    last = state.groupBy(*keys).agg(
        F.max(s.time).alias("_origin"),
        *[F.max_by(c, s.time).alias(f"_x{n}") for n, c in enumerate(inputs)],
    ).join(coefs.select(*keys, "beta"), keys)
    # Fresh column identities: both sides may come from the same request table.
    future = future.select(*[F.col(c).alias(c) for c in dict.fromkeys([*keys, s.time, *inputs, *keep])])
    hour = F.floor((S.epoch(s.time) - S.epoch("_origin")) / F.lit(s.step))
    asked = attach(future, last, keys, "inner").withColumn("h", hour).filter("h > 0")
    horizons = asked.groupBy(*keys).agg(F.max("h").alias("horizon"))
    level = F.col("path")
    for n, c in enumerate(inputs):
        change = F.col(c).cast("double") - F.col(f"_x{n}").cast("double")
        level = level + F.coalesce(change * F.col("beta")[n], F.lit(0.0))
    known = cut_lineage(paths(coefs, state, horizons, s, season))
    ahead = attach(asked, known, [*keys, "h"], "inner")
    return ahead.select(*keys, s.time, *keep, level.alias(out))
