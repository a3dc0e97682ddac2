"""Chunks, blocks and grids against pandas, with cuts so small that every edge is crossed."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlens.operators import features, ranks, resample, series, windows
from gridlens.operators.series import Series

T0 = datetime(2014, 1, 1)
# One-second steps with stamps hours apart: a chunk holds only a handful of rows.
SPARSE = Series(("ClientID",), "Date", 1)
HOURLY = Series(("ClientID",), "Date", 3600)
SCHEMA = "ClientID string, Date timestamp_ntz, Consumption double, HDH double"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(series, "MIN_BLOCK_ROWS", 8)


def irregular(n=400, seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for c, scale in (("a", 1.0), ("b", 1e5), ("c", 10.0)):
        hours = np.sort(rng.choice(n * 3, n, replace=False))
        frames.append(pd.DataFrame({
            "ClientID": c, "Date": [T0 + timedelta(hours=int(h)) for h in hours],
            "Consumption": np.where(rng.random(n) < 0.05, np.nan, rng.random(n) * scale),
            "HDH": np.where(rng.random(n) < 0.02, np.nan, rng.random(n) * scale),
        }))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r)
            for r in pdf.itertuples(index=False)]
    rows = [(r[0], r[1].to_pydatetime() if hasattr(r[1], "to_pydatetime") else r[1], *r[2:]) for r in rows]
    return spark.createDataFrame(rows, SCHEMA)


def back(df):
    return df.toPandas().sort_values(["ClientID", "Date"]).reset_index(drop=True)


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9)


def test_lags_count_rows_across_cuts(spark, small_blocks):
    pdf = irregular()
    got = back(features.add_lags(to_spark(spark, pdf), SPARSE, {1: "l1", 30: "l30"}))
    by = pdf.groupby("ClientID")["Consumption"]
    same(got["l1"], by.shift(1))
    same(got["l30"], by.shift(30))


def test_all_features_in_one_pass(spark, small_blocks):
    pdf = irregular()
    got = back(features.add_lags_and_rolling(
        to_spark(spark, pdf), SPARSE, {1: "l1", 25: "l25"}, day=10, rolling=3, baseline=40,
        baseline_least=5, weather=("HDH",)))
    g = pdf.groupby("ClientID")
    want = pdf.assign(
        l25=g["Consumption"].shift(25), lag=g["HDH"].shift(10),
        anomaly=pdf["HDH"] - g["HDH"].transform(lambda x: x.rolling(40, min_periods=5).mean()),
        mean=g["Consumption"].transform(lambda x: x.shift(1).rolling(3).mean()),
    ).dropna(subset=["l25", "mean"]).reset_index(drop=True)
    assert len(got) == len(want)
    same(got["HDH_anomaly"], want["anomaly"])
    same(got["HDH_lag24h"], want["lag"])
    same(got["Rolling_Mean_4h"], want["mean"])


def test_long_window_slides_far_beyond_its_frame(spark, small_blocks):
    pdf = irregular(1500, seed=7)
    got = back(features.weather_anomaly(to_spark(spark, pdf), SPARSE, 100, 30, ("HDH",)))
    base = pdf.groupby("ClientID")["HDH"].transform(lambda x: x.rolling(100, min_periods=30).mean())
    same(got["HDH_anomaly"], pdf["HDH"] - base)


def test_count_guards(spark):
    pdf = pd.DataFrame({"ClientID": "a", "Date": [T0 + timedelta(hours=i) for i in range(20)],
                        "Consumption": np.arange(20.0), "HDH": np.arange(20.0)})
    df = to_spark(spark, pdf)
    rolled = back(features.rolling_mean_past(df, HOURLY, 16))["Rolling_Mean_4h"]
    assert rolled[:16].isna().all() and rolled[16] == 7.5
    anomaly = back(features.weather_anomaly(df, HOURLY, 12, 5, ("HDH",)))["HDH_anomaly"]
    assert anomaly[:4].isna().all() and anomaly[4] == 2.0 and anomaly[19] == 5.5


def test_gap_report(spark):
    pdf = irregular(50)
    got = features.gap_report(to_spark(spark, pdf), SPARSE, step=3600).count()
    gaps = pdf.groupby("ClientID")["Date"].diff().dropna()
    assert got == int((gaps != pd.Timedelta(hours=1)).sum())


def test_regular_grid_needs_no_numbering(spark, small_blocks):
    pdf = pd.DataFrame({"ClientID": "a", "Date": [T0 + timedelta(hours=i) for i in range(300)],
                        "Consumption": np.arange(300.0), "HDH": 0.0})
    df = to_spark(spark, pdf)
    lagged = features.add_lags(df, HOURLY, {24: "l"}, regular=True)
    assert lagged._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    same(back(lagged)["l"], pdf["Consumption"].shift(24))


def test_fill_forward_and_last_n(spark):
    pdf = irregular(200, seed=3)
    df = to_spark(spark, pdf)
    same(back(series.fill_forward(df, SPARSE, ["Consumption"]))["Consumption"],
         pdf.groupby("ClientID")["Consumption"].ffill())
    last = back(series.last_n(df, SPARSE, 7))
    assert list(last["Date"]) == list(pdf.groupby("ClientID").tail(7)["Date"])


def test_resample_and_asfreq_against_pandas(spark):
    rng = np.random.default_rng(5)
    quarters = np.sort(rng.choice(3000, 300, replace=False))
    pdf = pd.DataFrame({"ClientID": "a", "Date": [T0 + timedelta(minutes=15 * int(q)) for q in quarters],
                        "Consumption": rng.random(300), "HDH": 0.0})
    df = to_spark(spark, pdf)
    fine = Series(("ClientID",), "Date", 1)
    hourly = pdf.set_index("Date")["Consumption"].resample("1h").mean().ffill()
    got = back(resample.resample_mean_ffill(df, fine, ["Consumption"]))
    assert list(got["Date"]) == list(hourly.index)
    same(got["Consumption"], hourly)
    dense = pdf.set_index("Date")["Consumption"].asfreq("15min").ffill()
    got = back(resample.asfreq_ffill(df, fine, ["Consumption"], 900))
    same(got["Consumption"], dense)


def test_last_hour_rule(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(hours=1), 2.0)],
                               "ClientID string, Date timestamp_ntz, x double")
    assert resample.upsample_ffill(df, HOURLY).count() == 5
    assert resample.upsample_ffill(df, HOURLY, fill_last_hour=True).count() == 8


def test_mirror_repeats_and_skips_empty(spark):
    old = spark.createDataFrame(
        [("a", datetime(2014, 1, 1) + timedelta(hours=i), float(i)) for i in range(3)]
        + [("b", datetime(2010, 1, 1), 1.0)], "ClientID string, Date timestamp_ntz, Consumption double")
    req = spark.createDataFrame([(1, "a", 8), (2, "b", 8), (3, "a", 2)], "request_id int, ClientID string, horizon_steps int")
    origin = F.lit("2015-01-01 00:00:00").cast("timestamp_ntz")
    rows = resample.mirror_future(old, req, origin, HOURLY).orderBy("request_id", "step").collect()
    assert [r["Consumption"] for r in rows if r["request_id"] == 1] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert [r["Consumption"] for r in rows if r["request_id"] == 3] == [0, 1]
    assert not [r for r in rows if r["request_id"] == 2]
    assert rows[0]["Is_Holiday"] and rows[0]["Hour"] == 1 and rows[0]["Weekday"] == 4


def test_windows_and_tail(spark, small_blocks):
    pdf = pd.DataFrame({"ClientID": "a", "Date": [T0 + timedelta(hours=i) for i in range(60)],
                        "Consumption": np.arange(60.0), "HDH": 0.0})
    df = to_spark(spark, pdf)
    rows = windows.sliding_windows(df, HOURLY, "Consumption", 10, 4, 3).orderBy("start").collect()
    assert len(rows) == 60 - 10 - 3 + 1
    assert rows[20]["input"] == list(range(20, 30)) and rows[20]["target"] == list(range(26, 33))
    held = windows.tail_validation(df, HOURLY, 0.1, 2).filter("is_validation").count()
    assert held == 6 and windows.tail_validation(df, HOURLY, 0.1, 9).filter("is_validation").count() == 9


def test_rolling_origins_need_full_windows(spark):
    pdf = pd.DataFrame({"ClientID": "a", "Date": [T0 + timedelta(hours=i) for i in range(50)],
                        "Consumption": np.arange(50.0), "HDH": 0.0})
    df = to_spark(spark, pdf).withColumn("_start", F.lit("2014-01-02 00:00:00").cast("timestamp_ntz"))
    rows = windows.window_origins(df, HOURLY, "Consumption", "_start", 12, 8).orderBy("origin").collect()
    assert [r["input"][0] for r in rows] == [12.0, 20.0, 28.0]  # 24, 32, 40 to forecast; 48 has 2 rows left


def test_exact_quantiles_with_hot_value(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.exponential(50, 3000), np.full(1500, 7.0)])
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    got = {r["g"]: r for r in ranks.exact_quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.9, "c": 1.0}, 200).collect()}
    for k in range(3):
        for name, p in (("a", 0.25), ("b", 0.9), ("c", 1.0)):
            assert got[k][name] == pytest.approx(np.quantile(x[g == k], p))
