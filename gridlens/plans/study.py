"""Fit a model per cluster, forecast the rows after the cut, and score the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.values import flags_to_int
from gridlens.models import additive, ols, seasonal_arx, windowed
from gridlens.models.store import save_model
from gridlens.operators import clean, merge, metrics, resample, reshape, scale, windows
from gridlens.operators.series import Series
from gridlens.session import cut_lineage, scope

MODELS = ("lr", "prophet", "sarimax", "nst")


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    client_scaler: DataFrame
    weather_scaler: DataFrame | None
    weather: list[str]
    lags: list[str]


def prepare(features: DataFrame, cut: Column) -> Prepared:
    """Scale with statistics of the rows before ``cut`` only."""
    flags = [c for c in ols.FLAGS if c in features.columns]
    df = flags_to_int(features, flags)
    before, _ = clean.split_by_date(df, cut)
    weather = [c for c in ols.WEATHER if c in df.columns]
    weather_scaler = None
    if weather:
        weather_scaler = scale.fit_global_scaler(before, weather)
        df = scale.apply_global_scaler(df, weather_scaler, weather)
    client_scaler = scale.fit_client_scaler(before)
    raw_lags = [c.removesuffix("_Scaled") for c in ols.NEEDED]
    lags = [c for c in raw_lags if c in features.columns and c != "Consumption"]
    df = scale.apply_scaler_join(df, client_scaler, ["Consumption", *lags], keep_stats=True)
    train, test = clean.split_by_date(df, cut)
    return Prepared(train, test, client_scaler, weather_scaler, weather, lags)


@dataclass
class Outcome:
    """``tables`` are what serving needs, ready for ``save_model``."""

    scored: DataFrame
    portfolio: DataFrame
    summary: DataFrame
    tables: dict[str, DataFrame]

    def coverage(self) -> DataFrame:
        return forecast_coverage(self.scored)


def forecast_coverage(scored: DataFrame) -> DataFrame:
    """Rows (Cluster, n_rows, n_forecasts): how many of the rows to forecast have a forecast. Scores
    are made of the others' hours alone, so a gap shows here and nowhere else."""
    return scored.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("Predicted_kW").alias("n_forecasts")
    )


def _score(p: Prepared, merged: DataFrame, tables: dict[str, DataFrame]) -> Outcome:
    scored = scale.inverse_scale(merged, p.client_scaler).withColumn(
        "Actual_kW", F.col("Consumption")
    )
    portfolio = metrics.portfolio_sum(scored)
    return Outcome(scored, portfolio, metrics.cluster_metrics(portfolio), tables)


def _shared_tables(p: Prepared, features: DataFrame) -> dict[str, DataFrame]:
    tables = {"scalers": p.client_scaler, "clusters": merge.client_cluster_map(features)}
    if p.weather_scaler is not None:
        tables["weather"] = p.weather_scaler
    return tables


def fit_and_score(features: DataFrame, model: str, mode: str, cut: Column,
                  s: Series = Series(), hour: int = 3600) -> Outcome:
    """``features`` is the processed table; ``hour`` is the coarse step, in seconds, at which
    the autoregressive and windowed models work."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    p = prepare(features, cut)
    if model == "lr":
        return _linear(p, features)
    # The windowed model sees weather and flags in either mode; the lags are in its window.
    known = "long_term" if model == "nst" else mode
    inputs = ols.regressors(known, features.columns, flags=model != "prophet")
    return _cluster_level(p, features, model, mode, inputs, s, hour)


def _linear(p: Prepared, features: DataFrame) -> Outcome:
    levels = {c: v for c, v in reshape.LEVELS.items() if c in features.columns}
    names = ols.feature_names(features.columns)
    needed = [c for c in ols.NEEDED if c in p.train.columns]
    train = reshape.one_hot(clean.drop_incomplete(p.train, needed), levels)
    test = reshape.one_hot(p.test, levels, keep=True)
    # Written once: the fit is read by both the scoring and the saved tables.
    coefs = cut_lineage(ols.fit(train, names))
    order = coefs.sparkSession.createDataFrame([(names,)], "names array<string>")
    merged = ols.predict_scaled(test, coefs, names)
    tables = {"coefs": coefs, "features": order, **_shared_tables(p, features)}
    return _score(p, merged, tables)


def hourly_clusters(df: DataFrame, inputs: Sequence[str], s: Series, hour: int) -> DataFrame:
    """Cluster means on a dense coarse grid."""
    lags = [c for c in inputs if c.endswith("_Scaled")]
    flags = [c for c in inputs if c in ols.FLAGS]
    firsts = [c for c in inputs if c not in lags and c not in flags]
    by_cluster = merge.cluster_series(df, [ols.TARGET, *lags], firsts, flags)
    fine = Series(("Cluster",), s.time, s.step)
    return resample.resample_mean_ffill(by_cluster, fine, [ols.TARGET, *inputs], hour)


def _cluster_level(p: Prepared, features: DataFrame, model: str, mode: str,
                   inputs: list[str], s: Series, hour: int) -> Outcome:
    train = p.train
    if mode == "day_ahead":
        train = clean.drop_incomplete(train, [c for c in ols.SCALED_LAGS if c in inputs])
    lags = [c for c in inputs if c.endswith("_Scaled")]
    flags = [c for c in inputs if c in ols.FLAGS]
    firsts = [c for c in inputs if c not in lags and c not in flags]
    coarse = Series(("Cluster",), s.time, hour)
    tables = _shared_tables(p, features)

    if model == "prophet":
        series = cut_lineage(merge.cluster_series(train, [ols.TARGET, *lags], firsts, flags))
        future = merge.cluster_series(p.test, lags, firsts, flags)
        design = additive.design_for(series, inputs, s.time)
        coefs = cut_lineage(additive.fit(series, design))
        forecast = additive.forecast(coefs, design, future)
        spark = coefs.sparkSession
        tables["coefs"] = coefs
        tables["design"] = spark.createDataFrame(
            [(design.start, design.end, list(design.inputs))],
            "start timestamp_ntz, end timestamp_ntz, inputs array<string>",
        )
        return _score(p, merge.safe_merge(p.test, forecast), tables)

    # One row per cluster and hour, read several times below: written once.
    past = cut_lineage(hourly_clusters(train, inputs, s, hour))
    ahead = cut_lineage(hourly_clusters(p.test, inputs, s, hour))
    if model == "sarimax":
        coefs, state = seasonal_arx.fit(past, coarse, ols.TARGET, inputs)
        coefs, state = cut_lineage(coefs), cut_lineage(state)
        forecast = seasonal_arx.forecast(coefs, state, ahead.drop(ols.TARGET), coarse, inputs)
        order = coefs.sparkSession.createDataFrame([(inputs,)], "names array<string>")
        tables.update(coefs=coefs, state=state, features=order)
    else:
        coefs = cut_lineage(windowed.fit(past, coarse, ols.TARGET, inputs=inputs))
        starts = ahead.groupBy("Cluster").agg(F.min(s.time).alias("_start"))
        whole = past.unionByName(ahead).join(starts, "Cluster")
        origins = windows.window_origins(whole, coarse, ols.TARGET, "_start", others=inputs)
        forecast = windowed.roll(origins, coefs, coarse).select(
            "Cluster", s.time, "Predicted_Consumption_Scaled"
        )
        order = coefs.sparkSession.createDataFrame([(inputs,)], "names array<string>")
        tables.update(coefs=coefs, features=order)
    if hour > s.step:
        forecast = resample.upsample_ffill(forecast, coarse, s.step)
    return _score(p, merge.safe_merge(p.test, forecast), tables)


def run_pipeline(spark: SparkSession, features_path: str, model: str, mode: str, cut: Column,
                 model_path: str, out_path: str, s: Series = Series(), hour: int = 3600) -> dict[str, DataFrame]:
    """Load a feature table, fit, forecast, score, and save: the whole way of one model.

    The model goes to ``model_path``; ``out_path`` gets the tables ``scored``, ``portfolio``,
    ``summary`` and ``coverage``, which are returned as read back. Intermediate tables are cleared. No
    forecast at all is an error; hours without one are counted in ``coverage``.
    """
    with scope(spark):
        features = spark.read.parquet(features_path).drop("year")
        out = fit_and_score(features, model, mode, cut, s, hour)
        save_model(out.tables, model_path, model, mode)
        out.scored.write.parquet(f"{out_path}/scored")
    scored = spark.read.parquet(f"{out_path}/scored")
    if scored.filter(F.col("Predicted_kW").isNotNull()).isEmpty():
        raise ValueError(f"{model!r} ({mode}) has no forecast for any row behind the cut")
    metrics.portfolio_sum(scored).write.parquet(f"{out_path}/portfolio")
    portfolio = spark.read.parquet(f"{out_path}/portfolio")
    metrics.cluster_metrics(portfolio).write.parquet(f"{out_path}/summary")
    forecast_coverage(scored).write.parquet(f"{out_path}/coverage")
    return {n: spark.read.parquet(f"{out_path}/{n}") for n in ("scored", "portfolio", "summary", "coverage")}
