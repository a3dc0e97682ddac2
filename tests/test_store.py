"""Saved models: one version at a time; scopes that clear what they made; coverage of forecasts."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlens.models import store
from gridlens.operators import resample
from gridlens.operators.series import Series
from gridlens.plans import build, study
from gridlens.session import cut_lineage, remove_dir, scope

T0 = datetime(2013, 1, 1)


def one(spark, value):
    return spark.createDataFrame([(0, value)], "Cluster int, v double")


def test_a_save_that_stops_half_way_leaves_the_old_model(spark, tmp_path):
    path = str(tmp_path / "models")
    store.save_model({"coefs": one(spark, 1.0), "scalers": one(spark, 10.0)}, path, "lr")
    broken = one(spark, 20.0).withColumn("v", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception):
        store.save_model({"coefs": one(spark, 2.0), "scalers": broken}, path, "lr")
    found = store.load_model(spark, path, "lr", "day_ahead", ["coefs", "scalers"])
    assert [found[n].first()["v"] for n in ("coefs", "scalers")] == [1.0, 10.0]
    store.save_model({"coefs": one(spark, 3.0), "scalers": one(spark, 30.0)}, path, "lr")
    # Tables that were loaded before stay readable until old versions are cleared.
    again = store.load_model(spark, path, "lr", "day_ahead", ["coefs", "scalers"])
    assert found["coefs"].first()["v"] == 1.0 and again["scalers"].first()["v"] == 30.0
    assert store.clear_old_versions(spark, path, "lr") == 1
    assert store.load_model(spark, path, "lr", "any", ["coefs"])["coefs"].first()["v"] == 3.0


def test_a_mode_without_a_table_is_no_model(spark, tmp_path):
    path = str(tmp_path / "models")
    store.save_model({"coefs": one(spark, 1.0)}, path, "nst", "day_ahead")
    with pytest.raises(FileNotFoundError, match="scalers"):
        store.load_model(spark, path, "nst", "day_ahead", ["coefs", "scalers"])
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, path, "nst", "long_term", ["coefs"])


def test_a_scope_clears_its_folder_also_after_an_error(spark):
    kept = cut_lineage(one(spark, 1.0))
    with scope(spark) as outer:
        cut_lineage(one(spark, 2.0))
        with pytest.raises(KeyError):
            with scope(spark) as inner:
                assert cut_lineage(one(spark, 3.0)).first()["v"] == 3.0
                assert inner.startswith(outer) and os.path.isdir(inner)
                raise KeyError
        assert not os.path.exists(inner) and os.path.isdir(outer)
    assert not os.path.exists(outer) and kept.first()["v"] == 1.0
    remove_dir(spark, outer)  # nothing there any more


def test_coverage_counts_rows_without_a_forecast(spark):
    scored = spark.createDataFrame(
        [(0, 1.0), (0, None), (1, None), (None, 2.0)], "Cluster int, Predicted_kW double")
    got = {r["Cluster"]: (r["n_rows"], r["n_forecasts"]) for r in study.forecast_coverage(scored).collect()}
    assert got == {0: (2, 1), 1: (1, 0), None: (1, 1)}


def test_requests_for_no_step_get_no_rows(spark):
    history = spark.createDataFrame([("a", T0 + timedelta(hours=i), float(i)) for i in range(6)], "ClientID string, Date timestamp_ntz, x double")
    requests = spark.createDataFrame([(1, "a", 2), (2, "a", 0), (3, "a", None), (4, "a", -3)], "request_id int, ClientID string, horizon_steps int")
    origin = F.lit(T0 + timedelta(days=365)).cast("timestamp_ntz")
    rows = resample.mirror_future(history, requests, origin, Series(("ClientID",), "Date", 3600)).collect()
    assert sorted((r["request_id"], r["x"]) for r in rows) == [(1, 0.0), (1, 1.0)]


def test_raw_files_become_a_feature_table(spark, tmp_path):
    hours = [T0 + timedelta(hours=i) for i in range(24 * 16)]
    lines = [";MT_001;MT_002;MT_003"]
    for i, t in enumerate(hours):
        lines.append(f"{t:%Y-%m-%d %H:%M:%S};" + ";".join(f"{c + (i * (c + 1)) % 24 / 10:.1f}".replace(".", ",") for c in (1, 2, 3)))
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    reply = {"station": "Lisbon", "hourly": {"time": [f"{t:%Y-%m-%dT%H:%M}" for t in hours], "temperature_2m": [10.0 + i % 9 for i in range(len(hours))]}}
    (tmp_path / "weather.json").write_text(json.dumps(reply))
    out = str(tmp_path / "features")
    table = build.run_process_data(
        spark, str(tmp_path / "raw.csv"), str(tmp_path / "weather.json"), F.lit(T0 + timedelta(days=12)).cast("timestamp_ntz"), out,
        s=Series(("ClientID",), "Date", 3600), names={1: "Lag_1h", 24: "Lag_24h", 168: "Lag_1week"},
        day=24, rolling=4, baseline=240, baseline_least=24, k=2, starts=2)
    rows = {(r["ClientID"], r["Date"]): r for r in table.collect()}
    # A week goes to the longest lag.
    assert len(rows) == 3 * (len(hours) - 168)
    row = rows["MT_002", hours[200]]
    assert row["Consumption"] == pytest.approx(2 + (200 * 3) % 24 / 10, abs=1e-6) and row["HDH"] == pytest.approx(8.0 - 200 % 9, abs=1e-6)
    assert row["Lag_1week"] == pytest.approx(2 + (32 * 3) % 24 / 10, abs=1e-6) and row["Consumer_Category"] in ("Light", "Medium", "Heavy")
