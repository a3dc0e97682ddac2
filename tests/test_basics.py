import json
from datetime import date, datetime

import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from gridlens import session
from gridlens.functions import dates, values
from gridlens.models import ols
from gridlens.operators import clean, merge, reshape, scale, weather
from gridlens.sources import meters

T = datetime


def test_comma_csv_with_unnamed_time_column(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        '"";MT_001;MT_002\n2011-01-01 00:15:00;1,5;0\n2011-01-01 00:30:00;-2,25;\n'
        "01/02/2011 00:00;7;8,0\n2011-01-01 00:15:00;9,5;3\n"
    )
    df = meters.read_meter_csv(spark, str(path))
    assert dict(df.dtypes) == {"Date": "timestamp_ntz", "MT_001": "double", "MT_002": "double"}
    once = meters.dedupe_timestamps(df, ["MT_001"])
    rows = {r["Date"]: (r["MT_001"], r["MT_002"]) for r in once.collect()}
    assert rows == {
        T(2011, 1, 1, 0, 15): (1.5, 0.0),
        T(2011, 1, 1, 0, 30): (-2.25, None),
        T(2011, 1, 2): (7.0, 8.0),
    }
    long = reshape.melt_clients(once)
    assert long.count() == 6 and set(long.columns) == {"Date", "ClientID", "Consumption"}


def test_unreadable_cells_are_told_and_never_merged(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("Date;MT_001\n2011-01-01;1.234,5\n01.02.2011 00:45;2\n01.02.2011 01:00;3\n2011-01-01;4\n2011-01-02;\n")
    with pytest.raises(Exception, match="unreadable cell"):
        meters.read_meter_csv(spark, str(path)).collect()
    assert {tuple(r) for r in meters.unread_cells(spark, str(path)).collect()} == {("Date", 2), ("MT_001", 1)}
    once = meters.dedupe_timestamps(meters.read_meter_csv(spark, str(path), bad="null"), ["MT_001"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(
        [(T(2011, 1, 1), 4.0), (T(2011, 1, 2), None), (None, 2.0), (None, 3.0)], key=str)


def test_missing_time_column_raises(spark):
    with pytest.raises(KeyError):
        meters.require_time_column(spark.createDataFrame([(1.0,)], ["MT_001"]))


def test_feature_table_round_trip_prunes_years(spark, tmp_path):
    rows = [("a", T(2012 + i % 3, 1, 1 + i), float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "ClientID string, Date timestamp_ntz, Consumption double")
    path = str(tmp_path / "features")
    meters.write_features(df, path)
    read = meters.read_features(spark, path, [2012, 2014], ["ClientID", "Consumption"])
    assert sorted(r[1] for r in read.collect()) == [0.0, 2.0, 3.0, 5.0, 6.0, 8.0]
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1][:60]


def test_weather_json_and_repeated_hour(spark, tmp_path):
    path = tmp_path / "weather.json"
    lines = [
        {"station": "Lisbon", "hourly": {"time": ["2011-10-30T01:00", "2011-10-30T01:00", "2011-10-30T02:00"],
                                         "temperature_2m": [10.0, 14.0, 20.0]}},
        {"station": "Porto", "hourly": {"time": ["2011-10-30T01:00"], "temperature_2m": [24.0]}},
        {"station": "Madrid", "hourly": {"time": ["2011-10-30T01:00"], "temperature_2m": [99.0]}},
    ]
    path.write_text("\n".join(json.dumps(x) for x in lines))
    hours = weather.national_weather(meters.read_station_weather(spark, str(path)))
    got = {r["Date"].hour: (r["HDH"], r["CDH"]) for r in hours.collect()}
    temp = (12.0 * 547 + 24.0 * 237) / (547 + 237)
    assert got[1] == (pytest.approx(18 - temp), 0.0) and got[2] == (0.0, 2.0)
    readings = spark.createDataFrame(
        [("a", T(2011, 10, 30, 1, 45)), ("a", T(2011, 10, 30, 5))], "ClientID string, Date timestamp_ntz")
    joined = weather.join_weather(readings, hours).orderBy("Date").collect()
    assert len(joined) == 2 and joined[1]["HDH"] is None


def test_easter_equals_dateutil(spark):
    rows = spark.range(1900, 2101).select("id", dates.easter_date("id").alias("e")).collect()
    assert all(r["e"] == easter(r["id"]) for r in rows)


def test_holidays_of_suspended_years(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2011-01-01', DATE'2016-12-31')) AS d").select(
        "d", dates.is_holiday("d").alias("h"))
    flagged = {r["d"] for r in days.filter("h").collect()}
    years = spark.createDataFrame([(y,) for y in range(2011, 2017)], "year int")
    assert flagged == {r["Holiday"] for r in dates.holiday_dates(years).collect()}
    for y in range(2011, 2017):
        kept = y not in (2013, 2014, 2015)
        assert (date(y, 12, 1) in flagged) == kept and (date(y, 10, 5) in flagged) == kept
        assert date(y, 12, 25) in flagged and easter(y) in flagged
    assert date(2012, 6, 7) in flagged and date(2013, 5, 30) not in flagged  # Corpus Christi
    assert date(2014, 3, 4) in flagged  # Carnival stays on
    one, names = dates.with_holiday_columns(spark.createDataFrame([(T(2014, 3, 4),)], "Date timestamp_ntz"))
    assert len(names) == 14 and sum(one.select(*names).first()) == 1


def test_calendar_is_one_based(spark):
    row = dates.calendar_features(
        spark.createDataFrame([(T(2014, 6, 1, 23, 45),)], "Date timestamp_ntz")).first()
    assert (row["Weekday"], row["Hour"], row["Month"], row["Is_Weekend"]) == (7, 24, 6, True)


def test_client_ids(spark):
    typed = ["13", " mt_13 ", "MT_013", "mt_0370", "1234", "MT_1_2", "other", "MT_000"]
    df = spark.createDataFrame([(t,) for t in typed], "c string")
    got = [r[0] for r in df.select(values.normalise_client_id(F.col("c"))).collect()]
    assert got == ["MT_013", "MT_013", "MT_013", "MT_370", "MT_1234", "MT_1_2", "OTHER", "MT_000"]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(values.clamp_nonneg(F.col("x"))).collect()] == [0.0, None, 2.0]


def edge_clients(spark):
    rows = []
    for day in range(1, 41):
        stamp = T(2014, 1, 1) if day == 1 else T(2014, 1 + (day > 31), day if day <= 31 else day - 31)
        rows += [
            ("zero", stamp, 0.0),
            ("late", stamp, 5.0 if day >= 20 else 0.0),
            ("one", stamp, 1.0 if day in (2, 40) else 0.0),
            ("boundary", stamp, 2.0 if day == 10 else 0.0),
            ("before", stamp, 2.0 if day == 9 else 0.0),
        ]
    return spark.createDataFrame(rows, "ClientID string, Date timestamp_ntz, Consumption double")


def test_cleaning_edges(spark):
    df = edge_clients(spark)
    trimmed = clean.trim_inactive_start(df)
    counts = {r["ClientID"]: r["count"] for r in trimmed.groupBy("ClientID").count().collect()}
    assert counts == {"late": 21, "one": 39, "boundary": 31, "before": 32}
    # The newest day is 9 February; its day − 30 is 10 January, which still counts.
    kept = {r[0] for r in clean.clean_clients(df).select("ClientID").distinct().collect()}
    assert kept == {"late", "boundary"}
    quality = {r["stage"]: r for r in clean.data_quality(df, trimmed).collect()}
    assert quality["before"]["rows"] == 200 and quality["after"]["clients"] == 4


def test_scaler_edges(spark):
    train = spark.createDataFrame(
        [("flat", 0.1)] * 3 + [("two", 1.0), ("two", 3.0)], "ClientID string, Consumption double")
    scaler = {r["ClientID"]: (r["mean"], r["std"]) for r in scale.fit_client_scaler(train).collect()}
    assert scaler["flat"][1] == 1.0 and scaler["two"] == (2.0, 1.0)
    test = spark.createDataFrame(
        [("two", 4.0), ("new", 4.0)], "ClientID string, Consumption double")
    got = scale.apply_scaler_join(test, scale.fit_client_scaler(train), ["Consumption"])
    assert {r["ClientID"]: r["Consumption_Scaled"] for r in got.collect()} == {"two": 2.0, "new": None}


def test_large_side_is_not_broadcast(spark):
    from gridlens.operators.joins import attach

    fact, dim = spark.range(100), spark.range(50).withColumn("v", F.lit(1))
    small, large = attach(fact, dim, ["id"]), attach(fact, dim, ["id"], max_rows=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
        assert "SortMergeJoin" in large._jdf.queryExecution().toString()
        assert small.count() == large.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_cut_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", T(2013, 5, 1), 1.0)], "ClientID string, Date timestamp_ntz, x double").write.parquet(path)
    train, _ = clean.split_by_date(spark.read.parquet(path), F.lit("2014-01-01").cast("timestamp_ntz"))
    plan = train.select("ClientID")._jdf.queryExecution().toString()
    assert "LessThan(Date" in plan and "x:double" not in plan.split("ReadSchema")[1]


def test_model_column_rules():
    cols = ["HDH", "CDH", "Is_Weekend", "Lag_24h", "Lag_1week", "Hour", "Weekday", "Month", "Consumer_Category"]
    assert ols.regressors("long_term", cols) == ["HDH", "CDH", "Is_Weekend"]
    assert ols.regressors("day_ahead", cols, flags=False)[-2:] == ["Lag_24h_Scaled", "Lag_1week_Scaled"]
    full = ols.feature_names([*cols, *ols.WEATHER, *ols.FLAGS])
    assert len(full) == len(set(full)) == 52
    with pytest.raises(ValueError):
        ols.regressors("weekly", cols)


def test_unseen_client_keeps_null_segment(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "ClientID string")
    segments = spark.createDataFrame([("a", 1, "Light")], "ClientID string, Cluster int, Consumer_Category string")
    got = {r["ClientID"]: r["Cluster"] for r in merge.attach_segments(rows, segments).collect()}
    assert got == {"a": 1, "b": None}


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = session.shared_dir(spark)
    assert path.startswith(base or "/tmp/run-") and path != session.shared_dir(spark)
    assert session.cut_lineage(spark.range(5)).count() == 5
