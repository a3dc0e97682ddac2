"""Windows of several channels: lagged sums, the ridge path, and the model with outside inputs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.models import lagged, ridge, windowed
from gridlens.operators import windows
from gridlens.operators.series import Series

T0 = datetime(2013, 1, 1)
HOURLY = Series(("Cluster",), "Date", 3600)


def frame(spark, columns, cluster=0, gone=()):
    names = list(columns)
    rows = [
        (cluster, T0 + timedelta(hours=i), *(None if v is None or np.isnan(v) else float(v) for v in values))
        for i, values in enumerate(zip(*columns.values())) if i not in gone
    ]
    return spark.createDataFrame(rows, "Cluster int, Date timestamp_ntz, " + ", ".join(f"{n} double" for n in names))


def brute_products(x, length, late):
    """Windows without a missing value, by part."""
    found = {p: [] for p in lagged.PARTS}
    for t in range(len(x) - length + 1):
        w = x[t:t + length]
        if not np.isnan(w).any():
            part = "held" if late[t] else "mixed" if late[t + length - 1] else "train"
            found[part].append(w.T.ravel())
    return {p: np.array(w) for p, w in found.items() if w}


def test_lagged_sums_equal_all_windows(spark, monkeypatch):
    monkeypatch.setattr(lagged, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) + [5.0, 0.0, -2.0]
    x[37, 1] = x[200, 0] = x[201, 2] = np.nan
    length, late = 12, np.arange(400) >= 310
    df = frame(spark, {"y": x[:, 0], "a": x[:, 1], "b": x[:, 2], "h": late})
    df = df.withColumn("h", F.col("h") == 1)
    sums = lagged.add_up(lagged.window_sums(df, HOURLY, ["y", "a", "b"], length, "h"), ["Cluster"])
    got = lagged.window_products(sums.toPandas(), 3, length)
    wanted = brute_products(x, length, late)
    assert set(got) == set(wanted) == set(lagged.PARTS)
    for part, w in wanted.items():
        n, totals, g = got[part]
        assert n == len(w)
        assert np.allclose(totals.ravel(), w.sum(axis=0))
        assert np.allclose(g.reshape(3 * length, 3 * length), w.T @ w)
        m = lagged.centred_moments(n, totals, g, 9)
        z = w.reshape(-1, 3, length)
        level = z[:, :, :9].mean(axis=2, keepdims=True)
        inputs, targets = (z[:, :, :9] - level).reshape(len(w), -1), z[:, 0, 9:] - level[:, 0]
        for mine, its in ((m.sx, inputs.sum(0)), (m.sy, targets.sum(0)), (m.xx, inputs.T @ inputs),
                          (m.xy, inputs.T @ targets), (m.yy, (targets**2).sum(0))):
            assert np.allclose(mine, its, atol=1e-7)


def test_missing_hours_end_a_stretch(spark):
    y = np.arange(40.0)
    df = frame(spark, {"y": y}, gone={17})
    sums = lagged.add_up(lagged.window_sums(df, HOURLY, ["y"], 5, regular=True), ["Cluster"])
    n, totals, g = lagged.window_products(sums.toPandas(), 1, 5)["train"]
    w = np.array([y[t:t + 5] for t in range(36) if not t <= 17 < t + 5])
    assert n == len(w) and np.allclose(totals[0], w.sum(0)) and np.allclose(g[0, :, 0], w.T @ w)


def plain_moments(x, y):
    return lagged.Moments(float(len(x)), x.sum(0), y.sum(0), x.T @ x, x.T @ y, (y**2).sum(0))


def test_chosen_weight_equals_trying_each():
    rng = np.random.default_rng(5)
    for seed, noise in enumerate((0.1, 3.0, 30.0)):
        x = rng.normal(size=(90, 40)) * rng.uniform(0.1, 5, 40)
        x[:, 7], x[:, 8] = x[:, 6], 2.0
        y = x @ rng.normal(size=(40, 3)) + rng.normal(scale=noise, size=(90, 3)) + 4
        tx, ty, hx, hy = x[:60], y[:60], x[60:], y[60:]

        def solve(ax, ay, weight):
            mx, my, unit = ax.mean(0), ay.mean(0), ax.std(0)
            unit[unit < 1e-9] = np.inf
            z = (ax - mx) / unit
            coef = np.linalg.solve(z.T @ z / len(z) + weight * np.eye(40), z.T @ (ay - my) / len(z))
            return lambda bx: my + (bx - mx) / unit @ coef

        losses = [((solve(tx, ty, w)(hx) - hy) ** 2).sum() for w in ridge.WEIGHTS]
        assert np.allclose(ridge.Path(plain_moments(tx, ty)).losses(plain_moments(hx, hy), ridge.WEIGHTS), losses, rtol=1e-6)
        weight, intercept, coef = ridge.choose_and_fit(
            plain_moments(tx, ty), plain_moments(hx, hy), plain_moments(x, y), ridge.WEIGHTS)
        assert weight == ridge.WEIGHTS[int(np.argmin(losses))], seed
        assert np.allclose(intercept + x @ coef, solve(x, y, weight)(x))


def rolled(df, coefs, start, inputs=()):
    ready = df.withColumn("_start", F.lit(T0 + timedelta(hours=start)).cast("timestamp_ntz"))
    origins = windows.window_origins(ready, HOURLY, "y", "_start", others=inputs)
    out = windowed.roll(origins, coefs, HOURLY, out="p").join(df, ["Cluster", "Date"]).toPandas().sort_values("Date")
    return out


def test_outside_inputs_are_recovered(spark):
    """The load follows the cold of a day ago: only the form that sees the weather can know it."""
    rng = np.random.default_rng(9)
    n = 24 * 150
    cold = np.clip(rng.normal(size=n).cumsum() * 0.3 % 9 - 4, 0, None) + rng.exponential(1.0, n)
    flag = (np.arange(n) // 24 % 7 >= 5).astype(float)
    y = 20 + 3 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 0.2, n)
    y[24:] += 2.0 * cold[:-24]
    df = frame(spark, {"y": y, "HDH": cold, "Is_Weekend": flag})
    start = 24 * 120
    train = df.filter(F.col("Date") < F.lit(T0 + timedelta(hours=start)).cast("timestamp_ntz"))
    alone, both = windowed.fit(train, HOURLY, "y"), windowed.fit(train, HOURLY, "y", inputs=["HDH", "Is_Weekend"])
    row = both.filter("step = 5").first()
    assert len(row["coef"]) == 3 * 168 and row["ridge"] in ridge.WEIGHTS
    # One day before hour 168 + 5 is hour 149 of the window.
    weather = np.array(row["coef"][168:336])
    assert int(np.argmax(np.abs(weather))) == 149 and weather[149] == pytest.approx(2.0, abs=0.25)
    a, b = rolled(df, alone, start), rolled(df, both, start, ["HDH", "Is_Weekend"])
    assert len(a) == len(b) == 24 * 30
    assert np.abs(b["p"] - b["y"]).mean() < 0.5 * np.abs(a["p"] - a["y"]).mean()


def test_short_and_broken_series(spark):
    y = np.sin(np.arange(500.0))
    y[::100] = np.nan
    df = frame(spark, {"y": y}).unionByName(frame(spark, {"y": np.sin(np.arange(200.0))}, 1))
    coefs = windowed.fit(df, HOURLY, "y").toPandas()
    # No stretch of 192 whole hours in cluster 0; cluster 1 has windows, but none to hold out.
    assert set(coefs["Cluster"]) == {1} and len(coefs) == 24 and coefs["ridge"].nunique() == 1
    assert windowed.fit(df.limit(0), HOURLY, "y").count() == 0


def test_a_window_with_a_missing_input_has_no_forecast(spark):
    n = 24 * 30
    cold = np.ones(n) + np.arange(n) % 5
    df = frame(spark, {"y": np.sin(np.arange(n) / 4.0), "HDH": cold})
    coefs = windowed.fit(df, HOURLY, "y", inputs=["HDH"], ridge=0.1)
    cold[24 * 22 + 3] = np.nan
    out = rolled(frame(spark, {"y": np.sin(np.arange(n) / 4.0), "HDH": cold}), coefs, 24 * 20, ["HDH"])
    assert sorted(set(out["Date"].dt.day)) == [21, 22, 23]
