"""The meter views: right rows on odd tables, and a grid that no single task makes or shuffles."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlens import fixtures as fx
from gridlens.operators import features, series

START = datetime(2000, 1, 1)


def day(n, hours=0):
    return START + timedelta(days=n, hours=hours)


@pytest.fixture
def tables(spark, tmp_path):
    suppliers = [(k, k % 3) for k in range(40)] + [(None, 1), (7, 2), (50, None)]
    sales = [(k, day(k % 5 + 3 * j), float(k + j)) for k in range(0, 40, 2) for j in range(4)]
    sales += [(4, day(4), 2.0), (4, day(4), None), (60, day(2), 9.0), (8, day(2, 5), 9.0), (None, day(6), 3.0), (8, None, 9.0)]
    events = [(k, day(0, 5 * k + h), 1.25) for k in range(10) for h in (0, 0, 3)]
    events += [(None, day(0, 7), 2.0), (3, day(1), None), (3, None, 5.0), (77, None, 4.0)]
    make = spark.createDataFrame
    make(suppliers, "s_suppkey bigint, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    make(sales, "l_suppkey bigint, l_shipdate timestamp_ntz, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    make(events, "user_id bigint, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), suppliers, sales, events


def name(k):
    return None if k is None else f"MT_{k:03d}"


def found(df):
    rows = [tuple(r) for r in df.select("ClientID", "Cluster", "Date", "Consumption").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_daily_grid(spark, tables):
    d, suppliers, sales, _ = tables
    days = [t for _, t, _ in sales if t]
    steps = [min(days) + timedelta(days=n) for n in range((max(days) - min(days)).days + 1)]
    nations, sums = {}, defaultdict(float)
    for k, n in suppliers:
        if n is not None:
            nations[k] = max(nations.get(k, n), n)
    for k, t, v in sales:
        sums[k, t] += v or 0.0
    assert found(fx.daily_meter(spark, d)) == {(name(k), n, t, sums[k, t]) for k, n in nations.items() for t in steps}


def test_hourly_grid(spark, tables):
    d, _, _, events = tables
    hours = [t for _, t, _ in events if t]
    steps = [min(hours) + timedelta(hours=n) for n in range(int((max(hours) - min(hours)).total_seconds()) // 3600 + 1)]
    sums = defaultdict(float)
    for k, t, v in events:
        sums[k, t] += 100 * (v or 0.0)
    places = {(k, t) for k in {k for k, _, _ in events} for t in steps} | {(k, None) for k, t, _ in events if t is None}
    want = {(name(k), None if k is None else k % 5, t, sums[k, t]) for k, t in places}
    assert found(fx.hourly_meter(spark, d)) == want


def test_no_dates_give_no_days(spark, tables, tmp_path):
    d = tables[0]
    spark.read.parquet(f"{d}/lineitem.parquet").withColumn("l_shipdate", F.lit(None).cast("timestamp_ntz")).write.parquet(f"{d}/none/lineitem.parquet")
    spark.read.parquet(f"{d}/supplier.parquet").write.parquet(f"{d}/none/supplier.parquet")
    assert fx.daily_meter(spark, f"{d}/none").collect() == []


@pytest.mark.parametrize("view", ["daily_meter", "hourly_meter", "quarter_meter"])
def test_grid_is_made_by_many_tasks_behind_the_last_shuffle(spark, tables, monkeypatch, view):
    monkeypatch.setattr(fx, "TASK_ROWS", 100)
    meter = getattr(fx, view)(spark, tables[0])
    made = meter.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 4
    # Windows over clients need no shuffle of grid rows either.
    series = fx.Series(("ClientID",), "Date", fx.DAY)
    for df in (meter, features.add_lags(meter, series, {7: "lag"}, regular=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.rindex("Generate")]


def test_block_spread_is_compiled(spark):
    """Filters of arrays are evaluated row by row outside of generated code."""
    df = spark.range(100).select(F.lit("a").alias("ClientID"), F.timestamp_seconds(F.col("id") * fx.DAY).cast("timestamp_ntz").alias("Date"))
    spread = series.blocks(df, fx.DAILY, behind=3, ahead=2, regular=True, block_rows=10)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    found = {(r["_pos"], r["_block"], r["_core"]) for r in spread.collect()}
    want = {(p, b, b == p // 10) for p in range(100) for b in range(11) if 10 * b - 3 <= p < 10 * (b + 1) + 2}
    assert found == want
    assert spread.count() == len(want)


def test_wide_stages_are_split_into_methods_that_are_compiled(spark):
    assert int(fx.configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
