"""Moments that merge, sparse bends, many k-means at once, and forecasts without a recursion."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridlens.models import additive, linalg, ols, seasonal_arx
from gridlens.operators import lloyd, segment
from gridlens.operators.series import Series
from gridlens.session import cut_lineage

T0 = datetime(2013, 1, 1)
HOURLY = Series(("Cluster",), "Date", 3600)


def stamps(n):
    return [T0 + timedelta(hours=i) for i in range(n)]


# ---- least squares ------------------------------------------------------------------------

def test_a_large_mean_costs_no_digits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    y = x @ [1.5, -2.0, 0.25] + 3.0 + rng.normal(scale=0.1, size=900)
    rows = [(int(i % 2), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "Cluster int, a double, b double, c double, Consumption_Scaled double").repartition(7)
    far = df.withColumns({n: F.col(n) + 1e8 for n in "abc"})
    near, shifted = ({r["Cluster"]: r["coef"] for r in ols.fit(d, list("abc")).collect()} for d in (df, far))
    for cluster in (0, 1):
        part = np.arange(900) % 2 == cluster
        z = np.hstack([np.ones((part.sum(), 1)), x[part]])
        wanted = np.linalg.lstsq(z, y[part], rcond=None)[0][1:]
        assert np.allclose(near[cluster], wanted, atol=1e-10) and np.allclose(shifted[cluster], wanted, atol=1e-6)


def test_merged_moments_equal_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(linalg, "HELD_GROUPS", 3)
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 11}", float(a), None if i % 50 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(5, 2, (800, 2)))]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(9)
    got = {r["g"]: r for r in linalg.moments(df, ["g"], ["a", "b"]).collect()}
    assert len(got) == 11
    for g, r in got.items():
        x = np.array([(a, b) for k, a, b in rows if k == g and b is not None])
        assert r["n"] == len(x) and np.allclose(r["mean"], x.mean(0))
        assert np.allclose(np.reshape(r["products"], (2, 2)), (x - x.mean(0)).T @ (x - x.mean(0)))


def test_thresholded_descent_meets_its_conditions():
    rng = np.random.default_rng(7)
    for trial in range(20):
        z = rng.normal(size=(40, 9)).cumsum(axis=1)
        s, c, w = z.T @ z, z.T @ rng.normal(size=40) * 3, rng.uniform(0.5, 30, 9)
        d = linalg.soft_threshold(s, c, w)
        pull = c - s @ d
        assert np.allclose(pull[d != 0], (w * np.sign(d))[d != 0], atol=1e-6), trial
        assert (np.abs(pull[d == 0]) <= w[d == 0] + 1e-6).all(), trial


# ---- the additive model ---------------------------------------------------------------------

def test_one_planted_bend_is_the_only_one(spark):
    n = 24 * 100
    t = np.arange(n) / n
    at = additive.BEND_SPAN * 10 / additive.BENDS  # the tenth bend
    for seed, noise in ((1, 0.02), (2, 0.1)):
        y = 1.0 + 2.0 * t - 5.0 * np.clip(t - at, 0, None) + np.random.default_rng(seed).normal(0, noise, n)
        df = cut_lineage(spark.createDataFrame([(3, s, float(v)) for s, v in zip(stamps(n), y)], "Cluster int, Date timestamp_ntz, y double"))
        design = additive.design_for(df, [])
        coefs = cut_lineage(additive.fit(df, design, "y"))
        bends = {r["bend"]: r for r in additive.bends(coefs, design).collect()}
        # All other bends are exactly 0, but for a neighbour that takes a part of the planted one.
        assert 10 in bends and set(bends) <= {9, 10, 11}
        assert sum(r["change"] for r in bends.values()) * design.days == pytest.approx(-5.0, abs=0.5)
        assert abs((bends[10]["at"] - T0).total_seconds() / 86400 - at * design.days) < 0.01
        told = additive.optimality(df, design, coefs, "y").first()
        assert told["optimal"] and told["n_bends"] == len(bends)
        moved = coefs.withColumn("coef", F.transform("coef", lambda x: x * 1.01))
        assert not additive.optimality(df, design, moved, "y").first()["optimal"]


# ---- k-means ------------------------------------------------------------------------------------

def shapes(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.random((7, 24))
    x = centres[rng.integers(0, 7, n)] + rng.normal(0, 0.12, (n, 24))
    rows = [(f"MT_{i:03d}", *map(float, r)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, ["ClientID", *segment.HOURS])


def test_all_fits_at_once(spark):
    x, df = shapes(spark)
    tasks = [(k, 42 + i) for k in (1, 3, 5, 7) for i in range(4)]
    fits = lloyd.fit_all(df, segment.HOURS, tasks, "ClientID")
    again = lloyd.fit_all(df.repartition(5), segment.HOURS, tasks, "ClientID")
    for f, g in zip(fits, again):
        # A fit does not hang on the split into tasks, and is at rest: each centre is the mean of its rows.
        assert np.allclose(f.centres, g.centres) and f.cost == pytest.approx(g.cost)
        d = ((x[:, None] - f.centres) ** 2).sum(2)
        own = d.argmin(1)
        assert f.cost == pytest.approx(d.min(1).sum())
        assert all(np.allclose(f.centres[c], x[own == c].mean(0), atol=1e-6) for c in range(f.k))
    assert fits[0].cost == pytest.approx(((x - x.mean(0)) ** 2).sum())
    vectors = df.select(array_to_vector(F.array(*segment.HOURS)).alias("features"))
    for k in (3, 5, 7):
        library = min(KMeans(k=k, seed=42 + i).fit(vectors).summary.trainingCost for i in range(4))
        assert min(f.cost for f in fits if f.k == k) <= library * (1 + 1e-9)


def test_scans_do_not_grow_with_the_fits(spark, monkeypatch):
    _, df = shapes(spark, 120)
    scans = []
    real = lloyd._round
    monkeypatch.setattr(lloyd, "_round", lambda *a: (scans.append(1), real(*a)))
    fits = lloyd.fit_all(df, segment.HOURS, [(k, i) for k in range(1, 6) for i in range(5)], "ClientID")
    assert len(scans) == max(f.rounds for f in fits) < sum(f.rounds for f in fits) / 5


def test_few_and_equal_rows(spark):
    same = spark.createDataFrame([(str(i), *[1.0] * 24) for i in range(4)], ["ClientID", *segment.HOURS])
    fit, = lloyd.fit_all(same, segment.HOURS, [(3, 1)], "ClientID")
    assert len(fit.centres) == 1 and fit.cost == 0.0
    assert lloyd.fit_all(same.limit(0), segment.HOURS, [(2, 1)], "ClientID")[0].centres.shape == (0, 24)
    assert {r["Cluster"] for r in segment.profile_clusters(same, k=3).collect()} == {0}


# ---- forecasts by response ------------------------------------------------------------------------

def recursion(arma, u, e, y, dx, beta, season=24):
    """The hourly recursion, step by step."""
    u, e, out = list(u), list(e), []
    for t in range(len(dx)):
        lags = (1, season, season + 1)
        step = sum(a * u[-k] for a, k in zip(arma[:3], lags)) + sum(m * e[-k] for m, k in zip(arma[3:], lags))
        u.append(step)
        e.append(0.0)
        y += step + dx[t] @ beta
        out.append(y)
    return out


def test_response_equals_the_recursion(spark):
    rng = np.random.default_rng(11)
    state, coefs, future, wanted = [], [], [], {}
    for c in range(3):
        arma, beta = rng.uniform(-0.3, 0.3, 6), rng.normal(size=2)
        u, e, x = rng.normal(size=25), rng.normal(size=25), rng.normal(size=(25 + 60 + 10 * c, 2))
        y = float(rng.normal())
        when = stamps(len(x))
        state += [(c, when[i], y if i == 24 else 0.0, float(x[i, 0]), float(x[i, 1]), float(u[i]), float(e[i])) for i in range(25)]
        coefs.append((c, arma.tolist(), False, beta.tolist()))
        future += [(c, when[i], float(x[i, 0]), float(x[i, 1]), r) for i in range(24, len(x)) for r in range(2)]
        values = recursion(arma, u, e, y, np.diff(x[24:], axis=0), beta)
        wanted |= {(c, when[25 + h], r): v for h, v in enumerate(values) for r in range(2)}
    state = spark.createDataFrame(state, "Cluster int, Date timestamp_ntz, y double, a double, b double, u double, e double")
    coefs = spark.createDataFrame(coefs, "Cluster int, arma array<double>, damped boolean, beta array<double>")
    future = spark.createDataFrame(future, "Cluster int, Date timestamp_ntz, a double, b double, request int")
    got = seasonal_arx.forecast(coefs, state, future, HOURLY, ["a", "b"], out="p", keep=["request"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan
    rows = {(r["Cluster"], r["Date"], r["request"]): r["p"] for r in got.collect()}
    assert rows.keys() == wanted.keys()
    assert max(abs(rows[k] - wanted[k]) for k in wanted) < 1e-9


def test_unknown_inputs_change_nothing(spark):
    state = spark.createDataFrame([(0, T0, 5.0, 1.0, 0.0, 0.0)], "Cluster int, Date timestamp_ntz, y double, a double, u double, e double")
    coefs = spark.createDataFrame([(0, [0.0] * 6, False, [2.0])], "Cluster int, arma array<double>, damped boolean, beta array<double>")
    future = spark.createDataFrame([(0, s, v) for s, v in zip(stamps(4)[1:], (3.0, None, 1.0))], "Cluster int, Date timestamp_ntz, a double")
    got = seasonal_arx.forecast(coefs, state, future, HOURLY, ["a"], out="p").orderBy("Date").collect()
    assert [r["p"] for r in got] == [9.0, 5.0, 5.0]


def test_explosive_fits_are_marked(spark):
    arma = spark.createDataFrame([(0, [1.3, 0.0, 0.0, 0.1, 0.0, 0.0]), (1, [0.5, 0.2, -0.1, 0.1, 0.0, 0.0])], "Cluster int, arma array<double>")
    got = {r["Cluster"]: r for r in seasonal_arx._marked(arma, ["Cluster"], 24).collect()}
    assert got[0]["damped"] and got[0]["arma"][0] < 1.0 and got[0]["arma"][3] == 0.1
    assert not got[1]["damped"] and got[1]["arma"] == [0.5, 0.2, -0.1, 0.1, 0.0, 0.0]
