from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.models import additive, linalg, ols, seasonal_arx, store, windowed
from gridlens.operators import diagnostics, metrics, segment, windows
from gridlens.operators.series import Series
from gridlens.plans import build, serving, study

T0 = datetime(2014, 1, 1)
HOURLY = Series(("Cluster",), "Date", 3600)


def hours(n):
    return [T0 + timedelta(hours=i) for i in range(n)]


def hourly_frame(spark, values, cluster=0):
    return spark.createDataFrame(
        [(cluster, t, float(v)) for t, v in zip(hours(len(values)), values)],
        "Cluster int, Date timestamp_ntz, y double")


def test_ols_with_repeated_feature(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(4):
        x = rng.normal(size=(500, 3))
        y = 1.0 + c + x @ np.array([2.0, -1.0, 0.5 * c]) + rng.normal(0, 0.1, 500)
        rows += [(c, *map(float, r), float(r[0] + r[1]), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "Cluster int, a double, b double, c double, ab double, y double").repartition(5)
    names = ["a", "b", "c", "ab"]
    coefs = ols.fit(df, names, target="y")
    out = linalg.predict(df, coefs, ["Cluster"], names, "p").toPandas()
    for c, part in out.groupby("Cluster"):
        x = np.hstack([np.ones((len(part), 1)), part[names].to_numpy()])
        best = x @ np.linalg.lstsq(x, part["y"].to_numpy(), rcond=None)[0]
        assert np.abs(best - part["p"]).max() < 1e-8
        assert np.abs(x.T @ (part["y"] - part["p"]).to_numpy()).max() < 1e-6


def test_prediction_floor_is_zero_kw(spark):
    df = spark.createDataFrame([(0, -50.0, 10.0, 2.0), (9, 1.0, 10.0, 2.0)], "Cluster int, x double, mean double, std double")
    coefs = spark.createDataFrame([(0, 0.0, [1.0])], "Cluster int, intercept double, coef array<double>")
    got = {r["Cluster"]: r["Predicted_Consumption_Scaled"] for r in ols.predict_scaled(df, coefs, ["x"]).collect()}
    assert got == {0: -5.0, 9: None}


def test_additive_recovers_planted_parts(spark):
    n = 200 * 24
    t = np.arange(n)
    rng = np.random.default_rng(1)
    drop = np.array([(T0 + timedelta(hours=int(i))).strftime("%m-%d") in ("04-25", "05-01") for i in t])
    signal = (0.001 * t + np.where(t > 2400, 0.002 * (t - 2400), 0.0) + 2 * np.sin(2 * np.pi * t / 24)
              + np.cos(2 * np.pi * t / 168) - 3 * drop)
    df = hourly_frame(spark, signal + rng.normal(0, 0.2, n))
    cut = F.lit(T0 + timedelta(hours=170 * 24)).cast("timestamp_ntz")
    train, test = df.filter(F.col("Date") < cut), df.filter(F.col("Date") >= cut)
    design = additive.design_for(train, [])
    coefs = additive.fit(train, design, "y")
    fitted = additive.forecast(coefs, design, train, keep=["y"], out="p").toPandas().sort_values("Date")
    assert np.sqrt(np.mean((fitted["p"] - fitted["y"]) ** 2)) < 0.35
    ahead = additive.forecast(coefs, design, test, keep=["y"], out="p").toPandas()
    model = np.abs(ahead["p"] - ahead["y"]).mean()
    naive = np.abs(signal[170 * 24:] - signal[170 * 24 - 168: n - 168]).mean()
    assert model < naive


def test_seasonal_arx_recovers_planted_lags(spark):
    rng = np.random.default_rng(4)
    n, phi, season = 6000, 0.5, 0.3
    u, x = np.zeros(n), rng.normal(size=n).cumsum() * 0.1
    shock = rng.normal(0, 1, n)
    for t in range(25, n):
        u[t] = phi * u[t - 1] + season * u[t - 24] - phi * season * u[t - 25] + shock[t]
    y = np.cumsum(u) + 4.0 * x
    df = hourly_frame(spark, y).join(hourly_frame(spark, x).withColumnRenamed("y", "x"), ["Cluster", "Date"])
    train = df.filter(F.col("Date") < F.lit(T0 + timedelta(hours=n - 24)).cast("timestamp_ntz"))
    coefs, state = seasonal_arx.fit(train, HOURLY, "y", ["x"])
    row = coefs.first()
    assert row["beta"][0] == pytest.approx(4.0, abs=0.6)
    ar, ma = np.array(row["arma"][:3]), np.array(row["arma"][3:])
    # Series and shock lags share one effect; their sum is the planted response.
    assert (ar + ma)[0] == pytest.approx(phi, abs=0.08) and (ar + ma)[1] == pytest.approx(season, abs=0.08)
    future = df.filter(F.col("Date") >= F.lit(T0 + timedelta(hours=n - 24)).cast("timestamp_ntz")).drop("y")
    out = seasonal_arx.forecast(coefs, state, future, HOURLY, ["x"], out="p").toPandas().sort_values("Date")
    assert len(out) == 24 and abs(out["p"].iloc[0] - y[n - 24]) < 5.0


def test_damping_leaves_stable_recursions_alone():
    stable = np.array([0.5, 0.2, -0.1])
    assert (seasonal_arx.damp(stable, (1, 24, 25)) == stable).all()
    wild = seasonal_arx.damp(np.array([1.3, 0.0, 0.0]), (1, 24, 25))
    assert wild[0] < 1.0


def test_windowed_beats_last_week_and_ignores_level(spark):
    rng = np.random.default_rng(6)
    t = np.arange(24 * 120)
    y = 50 + 10 * np.sin(2 * np.pi * t / 24) + 0.05 * t + rng.normal(0, 1, len(t))
    df = hourly_frame(spark, y).withColumn("_start", F.lit(T0 + timedelta(hours=24 * 100)).cast("timestamp_ntz"))
    coefs = windowed.fit(df.filter(F.col("Date") < F.col("_start")), HOURLY, "y")
    origins = windows.window_origins(df, HOURLY, "y", "_start")
    out = windowed.roll(origins, coefs, HOURLY, out="p").join(df, ["Cluster", "Date"]).toPandas().sort_values("Date")
    assert len(out) == 24 * 20
    start = 24 * 100
    naive = np.abs(y[start:] - y[start - 168: len(y) - 168]).mean()
    assert np.abs(out["p"] - out["y"]).mean() < naive
    few = windowed.fit(df.filter(F.col("Date") < F.lit(T0 + timedelta(hours=100)).cast("timestamp_ntz")), HOURLY, "y")
    assert few.count() == 0


def test_jenks_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    for seed, values in enumerate((rng.exponential(3, 90), np.round(rng.normal(5, 2, 300), 1), [1.0, 2.0, 9.0])):
        x = np.sort(np.asarray(values))
        v = np.unique(x)

        def sse(part):
            return ((part - part.mean()) ** 2).sum()

        best = min(
            (sse(x[x <= v[i]]) + sse(x[(x > v[i]) & (x <= v[j])]) + sse(x[x > v[j]]), v[i], v[j])
            for i in range(len(v) - 2) for j in range(i + 1, len(v) - 1))
        df = spark.createDataFrame([(float(a),) for a in x], "x double")
        got = segment.jenks_breaks(df, "x", fan_out=3, bucket_rows=20).first()
        assert (got["break_1"], got["break_2"]) == (best[1], best[2]), seed
        assert (got["low"], got["high"]) == (v[0], v[-1])


def planted_shapes(spark):
    rng = np.random.default_rng(9)
    h = np.arange(24)
    shapes = [np.exp(-((h - peak) ** 2) / 8.0) for peak in (3, 8, 12, 17, 21)]
    rows = []
    for i, s in enumerate(shapes):
        for c in range(20):
            v = (s + rng.normal(0, 0.01, 24)) * rng.uniform(1, 1000)
            rows.append((f"{i}-{c}", *map(float, v)))
    return spark.createDataFrame(rows, ["ClientID", *segment.HOURS])


def test_clusters_follow_shape_and_order(spark):
    scaled = segment.row_minmax(planted_shapes(spark))
    out = segment.profile_clusters(scaled, starts=6).collect()
    assert len(out) == 100
    assert all(str(r["Cluster"]) == r["ClientID"].split("-")[0] for r in out)
    costs = [r["inertia"] for r in segment.elbow_curve(scaled, 5, starts=3).orderBy("k").collect()]
    assert len(costs) == 5 and all(a >= b * 0.999 for a, b in zip(costs, costs[1:]))


def test_flat_client_scales_to_zero(spark):
    df = spark.createDataFrame([("a", *[3.0] * 24)], ["ClientID", *segment.HOURS])
    assert set(segment.row_minmax(df).first()[1:]) == {0.0}


def test_metric_edges(spark):
    df = spark.createDataFrame(
        [(0, 0.1, 5.0), (0, 2.0, 1.0), (1, 0.0, 1.0)], "Cluster int, Actual_kW double, Predicted_kW double")
    got = {r["Cluster"]: (r["Portfolio_MAPE"], r["Portfolio_WMAPE"]) for r in metrics.cluster_metrics(df).collect()}
    assert got["0"] == (50.0, round(5.9 / 2.1 * 100, 2)) and got["1"] == (None, None)
    assert got["Global"] == (50.0, round(6.9 / 2.1 * 100, 2))


def test_periods_are_closed_on_the_right(spark):
    rows = [(T0 + timedelta(days=i), 1.0, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "Date timestamp_ntz, Actual_kW double, Predicted_kW double")
    got = {r["Date"].day: (r["period"], r["Time_Period"]) for r in metrics.with_period(df).collect()}
    assert [got[d][0] for d in range(1, 10)] == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert got[1][1] == "Dec 31 to Jan 03" and got[9][1] == "Jan 07 to Jan 09"


def test_acf_and_pacf_of_planted_series(spark):
    rng = np.random.default_rng(3)
    x = np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    df = hourly_frame(spark, x)
    r = diagnostics.acf(df, HOURLY, "y", 20)
    got = [row["acf"] for row in r.orderBy("lag").collect()]
    c = x - x.mean()
    assert got == pytest.approx([float(c[: len(c) - k] @ c[k:] / (c @ c)) for k in range(21)])
    p = [row["pacf"] for row in diagnostics.pacf(r, ["Cluster"]).orderBy("lag").collect()]
    assert p[1] == pytest.approx(got[1]) and abs(p[2]) < 0.06 and p[0] == 1.0
    two = np.linalg.solve(np.array([[1, got[1]], [got[1], 1]]), np.array(got[1:3]))[1]
    assert p[2] == pytest.approx(two)


def test_decomposition_adds_up(spark):
    t = np.arange(24 * 14)
    df = hourly_frame(spark, 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 24))
    out = diagnostics.seasonal_decompose(df, HOURLY, "y", 24).toPandas().sort_values("Date")
    mid = out.dropna(subset=["trend"])
    assert len(mid) == len(t) - 24 and np.abs(mid["resid"]).max() < 1e-8


def test_model_tables_round_trip_and_mode_fallback(spark, tmp_path):
    path = str(tmp_path / "models")
    one = spark.createDataFrame([(0, 1.0)], "Cluster int, v double")
    store.save_model({"coefs": one}, path, "lr")
    store.save_model({"coefs": one.withColumn("v", F.lit(2.0))}, path, "prophet", "day_ahead")
    store.save_model({"coefs": one.withColumn("v", F.lit(3.0))}, path, "prophet", "day_ahead")
    assert store.load_model(spark, path, "lr", "long_term", ["coefs"])["coefs"].first()["v"] == 1.0
    assert store.load_model(spark, path, "prophet", "day_ahead", ["coefs"])["coefs"].first()["v"] == 3.0
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, path, "prophet", "long_term", ["coefs"])


def small_portfolio(spark, bump=0.0):
    rng = np.random.default_rng(12)
    n = 24 * 60
    rows = []
    for c in range(6):
        h = np.arange(n)
        load = (c + 1) * (10 + 5 * np.sin(2 * np.pi * (h - 3 * c) / 24)) + rng.random(n)
        load[24 * 50:] += bump
        rows += [(f"MT_{c:03d}", t, float(v)) for t, v in zip(hours(n), load)]
    meter = spark.createDataFrame(rows, "ClientID string, Date timestamp_ntz, Consumption double")
    dated = build.flag_holidays(build.calendar_features(meter))
    weather = spark.createDataFrame(
        [(t, float(5 + 3 * np.sin(i / 50)), 0.5 * (i % 7)) for i, t in enumerate(hours(n))],
        "Date timestamp_ntz, HDH double, CDH double")
    return build.process_data(
        dated, weather, F.lit(T0 + timedelta(days=50)).cast("timestamp_ntz"),
        Series(("ClientID",), "Date", 3600), {1: "Lag_1h", 24: "Lag_24h", 168: "Lag_1week"},
        day=24, rolling=4, baseline=240, baseline_least=24, k=2, starts=2)


def test_nothing_after_the_cut_leaks_and_all_models_serve(spark, tmp_path):
    cut = F.lit(T0 + timedelta(days=50)).cast("timestamp_ntz")
    s = Series(("ClientID",), "Date", 3600)
    table, changed = small_portfolio(spark), small_portfolio(spark, bump=500.0)
    labels = [
        sorted(map(tuple, x.select("ClientID", "Cluster", "Consumer_Category").distinct().collect()))
        for x in (table, changed)]
    assert labels[0] == labels[1] and len(labels[0]) == 6
    path = str(tmp_path / "models")
    for model, mode in (("lr", "day_ahead"), ("prophet", "long_term"), ("sarimax", "day_ahead"), ("nst", "day_ahead")):
        out = study.fit_and_score(table, model, mode, cut, s)
        summary = {r["Cluster"]: r["Portfolio_WMAPE"] for r in out.summary.collect()}
        assert summary["Global"] is not None and summary["Global"] < 60, (model, summary)
        store.save_model(out.tables, path, model)
        if model == "lr":
            other = study.fit_and_score(changed, model, mode, cut, s)
            for name in ("coefs", "scalers", "weather"):
                a, b = (sorted(map(str, o.tables[name].collect())) for o in (out, other))
                assert a == b, name
    requests = spark.createDataFrame(
        [(1, "0", "LR", "day_ahead", 30), (2, " mt_1 ", "prophet", "long_term", 24),
         (3, "MT_002", "sarimax", "day_ahead", 24), (4, "3", "nst", "day_ahead", 60),
         (5, "77", "lr", "day_ahead", 24), (6, "4", "arima", "day_ahead", 24)],
        "request_id int, client_id string, model string, mode string, horizon_hours int")
    origin = F.lit(T0 + timedelta(days=365 + 50)).cast("timestamp_ntz")
    rows = serving.forecast_batch(requests, table, path, origin, s=s).toPandas()
    served = rows[rows["error"].isna()]
    assert served.groupby("request_id").size().to_dict() == {1: 30, 2: 24, 3: 24, 4: 60}
    assert (served["kw"] >= 0).all() and served["kw"].notna().all()
    errors = rows[rows["error"].notna()].set_index("request_id")["error"].to_dict()
    assert errors == {5: "ClientID 'MT_077' not found.", 6: "Unknown model: arima"}
    early = serving.forecast_batch(
        requests.filter("request_id = 1"), table, path, F.lit("2031-01-01").cast("timestamp_ntz"), s=s).collect()
    assert len(early) == 1 and early[0]["error"].startswith("No readings")
    summary = serving.forecast_summary(
        spark.createDataFrame([(1, T0, 4.0), (1, T0 + timedelta(minutes=15), 4.0)], "request_id int, ts timestamp_ntz, kw double"),
        ["request_id"]).first()
    assert summary["total_kwh"] == 2.0 and summary["peak_time"] == T0


def test_each_mode_is_served_with_its_own_scalers_and_gaps_are_errors(spark, tmp_path):
    path = str(tmp_path / "models")
    clusters = spark.createDataFrame([("MT_001", 0), ("MT_002", 1)], "ClientID string, Cluster int")
    coefs = spark.createDataFrame([(0, 1.0, [0.0])], "Cluster int, intercept double, coef array<double>")
    names = spark.createDataFrame([(["Lag_24h_Scaled"],)], "names array<string>")
    for mode, mean, std in (("day_ahead", 0.0, 1.0), ("long_term", 100.0, 10.0)):
        scalers = spark.createDataFrame(
            [("MT_001", mean, std), ("MT_002", mean, std)], "ClientID string, mean double, std double")
        store.save_model({"coefs": coefs, "features": names, "scalers": scalers, "clusters": clusters}, path, "lr", mode)
    features = spark.createDataFrame(
        [(c, t, 1.0, 1.0, k) for c, k in (("MT_001", 0), ("MT_002", 1)) for t in hours(48)],
        "ClientID string, Date timestamp_ntz, Consumption double, Lag_24h double, Cluster int")
    requests = spark.createDataFrame(
        [(1, "1", "lr", "day_ahead", 3), (2, "1", "lr", "long_term", 2), (3, "2", "lr", "day_ahead", 4),
         (4, "1", "lr", "day_ahead", 0), (5, None, "lr", "day_ahead", 2)],
        "request_id int, client_id string, model string, mode string, horizon_hours int")
    origin = F.lit(T0 + timedelta(days=365)).cast("timestamp_ntz")
    rows = serving.forecast_batch(requests, features, path, origin, s=Series(("ClientID",), "Date", 3600)).collect()
    served = sorted((r["request_id"], r["kw"]) for r in rows if r["error"] is None)
    assert served == [(1, 1.0)] * 3 + [(2, 110.0)] * 2
    errors = {r["request_id"]: r["error"] for r in rows if r["error"] is not None}
    assert len(rows) == len(served) + 3 and errors == {
        3: "The model has no forecast for some of the asked hours.",
        4: "The horizon must be positive.",
        5: "ClientID 'none' not found.",
    }
