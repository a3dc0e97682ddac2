"""Forecasts and profiles for whole tables of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.values import clamp_nonneg, normalise_client_id
from gridlens.models import additive, linalg, ols, seasonal_arx, windowed
from gridlens.models.store import load_model
from gridlens.operators import resample, reshape, scale, series as S, windows
from gridlens.operators.joins import attach
from gridlens.operators.segment import CLUSTER_NAMES
from gridlens.operators.series import Series
from gridlens.plans.study import MODELS
from gridlens.session import cut_lineage

SCALED = "Predicted_Consumption_Scaled"


def client_profiles(df: DataFrame, names: dict[int, str] = CLUSTER_NAMES,
                    step_hours: float = 0.25) -> DataFrame:
    """Mean, peak, energy, cluster and tier of every client in one pass."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    cluster = F.max("Cluster")
    return (
        df.groupBy("ClientID")
        .agg(
            cluster.alias("Cluster"),
            F.max("Consumer_Category").alias("Consumer_Category"),
            F.round(F.avg("Consumption"), 2).alias("mean_kw"),
            F.round(F.max("Consumption"), 2).alias("max_kw"),
            F.round(F.sum("Consumption") * step_hours, 2).alias("total_kwh"),
        )
        .withColumn(
            "behaviour",
            F.coalesce(
                F.try_element_at(lookup, F.col("Cluster")),
                F.concat(F.lit("Cluster "), F.col("Cluster").cast("string")),
            ),
        )
    )


def request_errors(requests: DataFrame, clusters: DataFrame, scalers: DataFrame,
                   models: Sequence[str] = MODELS) -> DataFrame:
    """Clean the requests and add ``Cluster`` and ``error`` (NULL when it can be served)."""
    clean = requests.withColumns(
        {
            "ClientID": normalise_client_id(F.col("client_id")),
            "model": F.lower("model"),
            "mode": F.lower("mode"),
        }
    )
    known = attach(clean, clusters.select("ClientID", "Cluster"), ["ClientID"], "left")
    scaled = attach(
        known, scalers.select("ClientID", F.lit(True).alias("_scaler")), ["ClientID"], "left"
    )
    error = (
        F.when(F.col("Cluster").isNull(),
               F.concat(F.lit("ClientID '"), F.coalesce("ClientID", F.lit("none")), F.lit("' not found.")))
        .when(F.col("model").isNull() | ~F.col("model").isin(list(models)),
              F.concat(F.lit("Unknown model: "), F.coalesce("model", F.lit("none"))))
        .when(F.col("_scaler").isNull(),
              F.concat(F.lit("Client '"), F.col("ClientID"), F.lit("' has no scaler.")))
    )
    return scaled.withColumn("error", error).drop("_scaler")


def _scaled_future(future: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    weather = [c for c in ols.WEATHER if c in future.columns]
    if weather and "weather" in tables:
        future = scale.apply_global_scaler(future, tables["weather"], weather)
    lags = [c for c in ("Lag_24h", "Lag_1week") if c in future.columns]
    return scale.apply_scaler_join(future, tables["scalers"], lags, keep_stats=True)


def _linear(future: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    names = tables["features"].first()["names"]
    keep = ["request_id", "Cluster", "step"]
    ready = reshape.align_features(future, names, keep)
    return linalg.predict(ready, tables["coefs"], ["Cluster"], names, SCALED)


def _additive(future: DataFrame, tables: dict[str, DataFrame], s: Series) -> DataFrame:
    row = tables["design"].first()
    design = additive.Design(row["start"], row["end"], tuple(row["inputs"]))
    flags = [c for c in design.inputs if c in ols.FLAGS]
    ready = future.withColumns({c: F.col(c).cast("int") for c in flags})
    return additive.forecast(
        tables["coefs"], design, ready, time=s.time, keep=["request_id", "step"]
    )


def _autoregressive(future: DataFrame, tables: dict[str, DataFrame], s: Series,
                    hour: int) -> DataFrame:
    """The cluster's path from its last known day, moved by the change of the client's inputs."""
    per = hour // s.step
    inputs = tables["features"].first()["names"]
    flags = [c for c in inputs if c in ols.FLAGS]
    ready = future.withColumns({c: F.col(c).cast("double") for c in flags})
    hourly = resample.hourly_block_mean(ready, ["request_id", "Cluster"], "step", inputs, per)
    # Requests count their hours from the cluster's last one.
    last = tables["state"].groupBy("Cluster").agg(F.max(s.time).alias("_last"))
    hourly = attach(hourly, last, ["Cluster"], "inner").withColumn(
        s.time, F.timestamp_seconds(S.epoch("_last") + (F.col("block") + 1) * hour).cast("timestamp_ntz")
    )
    steps = seasonal_arx.forecast(
        tables["coefs"], tables["state"], hourly, Series(("Cluster",), s.time, hour), inputs,
        keep=["request_id", "block"],
    )
    repeat = F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("_r")
    return steps.select("request_id", "block", SCALED, repeat).select(
        "request_id", (F.col("block") * per + F.col("_r")).cast("int").alias("step"), SCALED
    )


def _windowed(asked: DataFrame, history: DataFrame, tables: dict[str, DataFrame],
              s: Series, hour: int) -> DataFrame:
    """The client's last week, with the weather and flags of its hours; its 24 forecasts repeated
    and tiled to the horizon."""
    per = hour // s.step
    names = tables["features"].first()["names"]
    clients = asked.select("ClientID", "Cluster").distinct()
    seen = history.select(
        "ClientID", s.time, "Consumption",
        *[F.col(c).cast("double").alias(c) if c in ols.FLAGS else F.col(c) for c in names],
    )
    mine = attach(seen, clients, ["ClientID"], "inner")
    coarse = Series(("ClientID",), s.time, hour)
    hourly = resample.resample_mean_ffill(
        mine, Series(("ClientID",), s.time, s.step), ["Consumption", *names], hour
    )
    newest = windows.last_hours_per_client(hourly, coarse)
    scaled = scale.apply_scaler_join(newest, tables["scalers"], ["Consumption"])
    weather = [c for c in names if c in ols.WEATHER]
    if weather:
        scaled = scale.apply_global_scaler(scaled, tables["weather"], weather)
    channels = ["Consumption_Scaled", *names]
    inputs = (
        scaled.groupBy("ClientID")
        .agg(F.sort_array(F.collect_list(F.struct(s.time, *channels))).alias("_w"))
        .filter(F.size("_w") == windows.SEQ_LEN)
        .select("ClientID", F.concat(*[F.col(f"_w.{c}") for c in channels]).alias("input"))
        .join(clients, "ClientID")
    )
    day = windowed.predict_windows(inputs, tables["coefs"], ["Cluster"], ["ClientID"])
    pattern = day.select("ClientID", F.posexplode("forecast").alias("step", SCALED))
    wanted = asked.select("request_id", "ClientID", "horizon_steps")
    longest = wanted.agg(F.max("horizon_steps")).first()[0] or 0
    tiled = reshape.repeat_and_tile(pattern, longest, per, windows.PRED_LEN)
    return (
        tiled.join(wanted, "ClientID")
        .filter(F.col("step") < F.col("horizon_steps"))
        .select("request_id", "step", SCALED)
    )


TABLES = {
    "lr": ["coefs", "features", "scalers"],
    "prophet": ["coefs", "design", "scalers"],
    "sarimax": ["coefs", "state", "features", "scalers"],
    "nst": ["coefs", "features", "scalers"],
}


def forecast_batch(requests: DataFrame, features: DataFrame, path: str, origin: Column,
                   modes: Sequence[str] = ("day_ahead", "long_term"), s: Series = Series(),
                   hour: int = 3600) -> DataFrame:
    """Rows (request_id, ClientID, model, mode, ts, kw, error) for a table of requests with
    request_id, client_id, model, mode and horizon_hours. A request that cannot be served gives
    one row with its error."""
    spark = requests.sparkSession
    has_weather = any(c in features.columns for c in ols.WEATHER)
    steps = (F.col("horizon_hours") * (hour // s.step)).cast("int")
    parts = []
    base = {m: [*TABLES[m], "clusters"] + (["weather"] if has_weather else []) for m in MODELS}
    loaded = {}
    for model in MODELS:
        for mode in modes:
            try:
                loaded[model, mode] = load_model(spark, path, model, mode, base[model])
            except FileNotFoundError:
                continue
    if not loaded:
        raise FileNotFoundError(f"no model in {path}")
    # Each model and mode knows the clients of its own version.
    labelled = {
        name: reshape.union_splits(*[
            t[name].withColumns({"model": F.lit(m), "mode": F.lit(d)}) for (m, d), t in loaded.items()
        ]) for name in ("clusters", "scalers")
    }
    anywhere = labelled["clusters"].groupBy("ClientID").agg(F.max("Cluster").alias("Cluster"))
    checked = request_errors(
        requests.withColumn("horizon_steps", steps), anywhere, labelled["scalers"].select("ClientID").distinct(),
        sorted({m for m, _ in loaded}),
    )
    pairs = F.concat_ws("/", "model", "mode").isin([f"{m}/{d}" for m, d in loaded])
    mine = labelled["clusters"].select("ClientID", "model", "mode", "Cluster")
    checked = attach(checked.drop("Cluster"), mine, ["ClientID", "model", "mode"], "left")
    checked = checked.withColumn(
        "error", F.coalesce(
            "error", F.when(~pairs, F.lit("No model saved for this mode.")),
            F.when(F.col("Cluster").isNull(), F.concat(
                F.lit("ClientID '"), F.col("ClientID"), F.lit("' is not known to this model."))),
            F.when(F.coalesce("horizon_steps", F.lit(0)) <= 0, F.lit("The horizon must be positive.")),
        )
    )
    # Written once: every model reads the checked requests and their future rows.
    checked = cut_lineage(checked)
    good = checked.filter(F.col("error").isNull())
    history = features.drop("Cluster")
    mirrored = resample.mirror_future(
        history, good.select("request_id", "ClientID", "horizon_steps"), origin, s
    )
    future_all = cut_lineage(
        mirrored.join(good.select("request_id", "Cluster", "model", "mode"), "request_id")
    )
    for (model, mode), tables in loaded.items():
        mine = (F.col("model") == model) & (F.col("mode") == mode)
        future = future_all.filter(mine)
        if model == "nst":
            part = _windowed(good.filter(mine), history, tables, s, hour)
        else:
            ready = _scaled_future(future, tables)
            if model == "lr":
                part = _linear(ready, tables)
            elif model == "prophet":
                part = _additive(ready, tables, s)
            else:
                part = _autoregressive(ready, tables, s, hour)
        who = good.filter(mine).select("request_id", "ClientID", "model", "mode")
        scaled = part.select("request_id", "step", SCALED).join(who, "request_id")
        # Each model and mode was trained with scalers of its own.
        parts.append(attach(scaled, tables["scalers"], ["ClientID"], "left"))
    kw = F.round(clamp_nonneg(F.col(SCALED) * F.col("std") + F.col("mean")), 3)
    rows = cut_lineage(reshape.union_splits(*parts).withColumn("kw", kw))
    ts = origin + F.expr(f"INTERVAL '{s.step}' SECOND") * F.col("step")
    # A forecast with a gap is no forecast: its request gets one row that says so.
    state = rows.groupBy("request_id").agg(F.bool_or(F.col("kw").isNull()).alias("_gap"))
    fitted = reshape.union_splits(*[
        t["coefs"].select("Cluster").distinct().withColumns({"model": F.lit(m), "mode": F.lit(d), "_fitted": F.lit(True)})
        for (m, d), t in loaded.items()
    ])
    judged = attach(good.join(state, "request_id", "left"), fitted, ["Cluster", "model", "mode"], "left")
    judged = judged.withColumn(
        "error",
        F.when(F.col("_gap"), F.lit("The model has no forecast for some of the asked hours."))
        .when(F.col("_gap").isNotNull(), F.lit(None))
        .when(F.col("_fitted").isNull(), F.concat(
            F.lit("The model was not fitted for cluster "), F.col("Cluster").cast("string"), F.lit(".")))
        .when(F.col("model") == "nst", F.lit("No full week of complete readings before the origin."))
        .otherwise(F.lit("No readings one year before the origin.")),
    )
    failed = checked.filter(F.col("error").isNotNull()).unionByName(
        judged.filter(F.col("error").isNotNull()).drop("_gap", "_fitted")
    )
    served = rows.join(failed.select("request_id"), "request_id", "left_anti").select(
        "request_id", "ClientID", "model", "mode", ts.alias("ts"), "kw",
        F.lit(None).cast("string").alias("error"),
    )
    return served.unionByName(
        failed.select(
            "request_id", "ClientID", "model", "mode",
            F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("kw"),
            "error",
        )
    )


def forecast_summary(rows: DataFrame, keys: Sequence[str], value: str = "kw", time: str = "ts",
                     step_hours: float = 0.25) -> DataFrame:
    """Energy, mean, peak with its first stamp, and period of each forecast."""
    early = F.struct(F.col(value), (-F.unix_micros(F.col(time).cast("timestamp"))).alias("_e"))
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.round(F.sum(F.col(value) * step_hours), 3).alias("total_kwh"),
        F.round(F.avg(value), 3).alias("mean_kw"),
        F.round(F.max(value), 3).alias("peak_kw"),
        F.max_by(time, early).alias("peak_time"),
        F.min(time).alias("period_start"),
        F.max(time).alias("period_end"),
    )
