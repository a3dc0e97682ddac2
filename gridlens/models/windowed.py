"""One week in, one day out: a linear map from windows of one or more channels, per cluster.

The first channel is the series, the others are outside inputs of the same hours (weather, flags).
Every channel is taken from its own mean over the window, and the forecast is put back on the mean
of the series, so a change of level between training and use does not matter. Windows are never
stored or multiplied out: their products follow from lagged sums (``models/lagged.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.models import lagged, ridge as ridge_path
from gridlens.operators.series import Series
from gridlens.operators.windows import PRED_LEN, SEQ_LEN, rolling_origin, tail_validation


def fit(train: DataFrame, s: Series, value: str, seq: int = SEQ_LEN, pred: int = PRED_LEN,
        ridge: float | None = None, regular: bool = True, inputs: Sequence[str] = (),
        share: float = 0.1) -> DataFrame:
    """Coefficients (keys, step, intercept, coef, ridge): one weight row per forecast step.

    ``coef`` holds ``seq`` weights for each channel, the series first, to be applied to the plain
    window: means are folded in. Without ``ridge``, each key's weight is the one of ``WEIGHTS`` that
    does best on windows within the last ``share`` of its rows after a fit to those before; the model
    is then fitted to all windows. Keys without a window get no row.
    """
    keys, channels, length = s.key_list, [value, *inputs], seq + pred
    weights = ridge_path.WEIGHTS if ridge is None else (ridge,)
    rows = train.select(*keys, s.time, *channels)
    if ridge is None:
        rows = tail_validation(rows, s, share, length + 1)
    held = "is_validation" if ridge is None else None
    sums = lagged.window_sums(rows, s, channels, length, held, regular)
    types = dict(train.dtypes)
    schema = ", ".join(
        [f"`{k}` {types[k]}" for k in keys]
        + ["step int, intercept double, coef array<double>, ridge double"]
    )

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {
            name: lagged.centred_moments(*products, seq)
            for name, products in lagged.window_products(pdf, len(channels), length).items()
            if products[0] > 0
        }
        if not parts:
            return pd.DataFrame({c: [] for c in [*keys, "step", "intercept", "coef", "ridge"]})
        first, *others = parts.values()
        weight, intercept, coef = ridge_path.choose_and_fit(
            parts.get("train"), parts.get("held"), sum(others, first), weights
        )
        # Fold the means in: w·(x − mean x) is (w − mean w)·x, and the level is a mean of the series.
        coef = coef.T.reshape(pred, len(channels), seq)
        coef = coef - coef.mean(axis=2, keepdims=True)
        coef[:, 0] += 1.0 / seq
        out = pd.DataFrame({
            "step": np.arange(pred, dtype="int32"), "intercept": intercept,
            "coef": list(coef.reshape(pred, -1).tolist()), "ridge": weight,
        })
        for n, k in enumerate(keys):
            out.insert(n, k, pdf[k].iloc[0])
        return out

    return lagged.add_up(sums, keys).groupBy(*keys).applyInPandas(one_series, schema)


def predict_windows(windows: DataFrame, coefs: DataFrame, keys: Sequence[str],
                    keep: Sequence[str]) -> DataFrame:
    """Add ``forecast``, an array of one value per step, to rows with an ``input`` array (all
    channels one after the other). A window with a NULL in it gets no row."""
    keys = list(keys)
    model = coefs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("step", "intercept", "coef"))).alias("_model")
    )
    whole = windows.filter(~F.exists("input", lambda x: x.isNull()))

    def one_step(m):
        products = F.zip_with("input", m["coef"], lambda x, c: x.cast("double") * c)
        return F.aggregate(products, m["intercept"], lambda a, p: a + p)

    return whole.join(model, keys).withColumn("forecast", F.transform("_model", one_step)).select(
        *keys, *keep, "forecast"
    )


def roll(windows: DataFrame, coefs: DataFrame, s: Series, pred: int = PRED_LEN,
         out: str = "Predicted_Consumption_Scaled") -> DataFrame:
    """Forecast rows for the windows of ``window_origins``."""
    ready = predict_windows(windows, coefs, s.keys, ["origin"])
    return rolling_origin(ready, s, F.col("forecast"), pred, out)
