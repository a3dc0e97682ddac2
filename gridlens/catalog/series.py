"""Joins, aggregations, windows and time grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens import fixtures as fx
from gridlens.catalog.registry import q6, query, r6, using
from gridlens.operators import clean, features, merge, metrics, resample, scale, series, weather, windows
from gridlens.plans.build import client_mean

# ---- joins ------------------------------------------------------------------------------


@query("trim_inactive_start", using(fx.HOURLY_SQL, """
SELECT h.ClientID, h.Date, h.Consumption FROM hourly h
JOIN (SELECT ClientID, min(Date) AS s FROM hourly WHERE Consumption > 0 GROUP BY 1) f USING (ClientID)
WHERE h.Date >= f.s"""))
def trim_inactive_start(spark, d):
    return clean.trim_inactive_start(fx.hourly_meter(spark, d)).drop("Cluster")


RECENT_SQL = """
SELECT ClientID, sum(Consumption) AS recent FROM hourly
WHERE Date >= (SELECT max(Date) FROM hourly) - INTERVAL 1 DAY GROUP BY 1"""


@query("keep_active_clients", using(fx.HOURLY_SQL, f"""
SELECT ClientID, Date, Consumption FROM hourly
WHERE ClientID IN (SELECT ClientID FROM ({RECENT_SQL}) WHERE recent > 1)"""))
def keep_active_clients(spark, d):
    return clean.keep_active_clients(fx.hourly_meter(spark, d), days=1).drop("Cluster")


TRIMMED_SQL = """
trimmed AS (
  SELECT h.* FROM hourly h
  JOIN (SELECT ClientID, min(Date) AS s FROM hourly WHERE Consumption > 0 GROUP BY 1) f USING (ClientID)
  WHERE h.Date >= f.s)"""


@query("clean_clients", using(fx.HOURLY_SQL, TRIMMED_SQL, """
SELECT ClientID, Date, Consumption FROM trimmed WHERE ClientID IN (
  SELECT ClientID FROM trimmed WHERE Date >= (SELECT max(Date) FROM trimmed) - INTERVAL 1 DAY
  GROUP BY 1 HAVING sum(Consumption) > 1)"""))
def clean_clients(spark, d):
    return clean.clean_clients(fx.hourly_meter(spark, d), days=1).drop("Cluster")


@query("join_weather", using(fx.QUARTER_SQL, fx.WEATHER_SQL, f"""
SELECT q.ClientID, q.Date, q.Consumption, {q6('w.HDH')} AS HDH, {q6('w.CDH')} AS CDH
FROM quarter q LEFT JOIN weather w ON w.Date = date_trunc('hour', q.Date)"""))
def join_weather(spark, d):
    hours = weather.national_weather(fx.station_weather(spark, d), base=fx.BASE)
    joined = weather.join_weather(fx.quarter_meter(spark, d), hours)
    return joined.select("ClientID", "Date", "Consumption", r6("HDH").alias("HDH"), r6("CDH").alias("CDH"))


# Tier edges for the join query; jenks_breaks finds its own.
EDGES = (55.0, 70.0)


@query("attach_segments", using(fx.DAILY_SQL, f"""
SELECT d.ClientID, d.Date, s.Cluster, s.Consumer_Category FROM daily d LEFT JOIN (
  SELECT ClientID, max(Cluster) AS Cluster, CASE WHEN avg(Consumption) <= {EDGES[0]} THEN 'Light'
    WHEN avg(Consumption) <= {EDGES[1]} THEN 'Medium' ELSE 'Heavy' END AS Consumer_Category
  FROM daily WHERE Date < TIMESTAMP '{fx.DAILY_CUT}' AND Consumption > 0 GROUP BY 1) s USING (ClientID)"""))
def attach_segments(spark, d):
    from gridlens.operators.segment import volume_tier

    meter = fx.daily_meter(spark, d)
    train, _ = clean.split_by_date(meter.filter("Consumption > 0"), fx.stamp(fx.DAILY_CUT))
    tier = volume_tier(F.col("mean"), F.lit(EDGES[0]), F.lit(EDGES[1]))
    segments = merge.client_cluster_map(train).join(
        client_mean(train).select("ClientID", tier.alias("Consumer_Category")), "ClientID")
    return merge.attach_segments(meter.select("ClientID", "Date"), segments)


@query("safe_merge", using(fx.DAILY_SQL, f"""
SELECT d.ClientID, d.Cluster, d.Date, {q6('f.v')} AS Predicted_Consumption_Scaled
FROM daily d LEFT JOIN (SELECT Cluster, Date, avg(Consumption) AS v FROM daily
  WHERE Date >= TIMESTAMP '{fx.DAILY_CUT}' GROUP BY 1, 2) f USING (Cluster, Date)"""))
def safe_merge(spark, d):
    meter = fx.daily_meter(spark, d)
    _, test = clean.split_by_date(meter, fx.stamp(fx.DAILY_CUT))
    forecast = merge.cluster_series(test, ["Consumption"]).select(
        "Cluster", "Date", r6("Consumption").alias("Predicted_Consumption_Scaled"))
    old = meter.withColumn("Predicted_Consumption_Scaled", F.lit(-1.0)).drop("Consumption")
    return merge.safe_merge(old, forecast)


SCALER_SQL = f"""
scaler AS (
  SELECT ClientID, avg(Consumption) AS mean,
         CASE WHEN min(Consumption) = max(Consumption) THEN 1.0 ELSE stddev_pop(Consumption) END AS std
  FROM daily WHERE Date < TIMESTAMP '{fx.DAILY_CUT}' GROUP BY 1)"""


def daily_scaler(spark, d):
    train, _ = clean.split_by_date(fx.daily_meter(spark, d), fx.stamp(fx.DAILY_CUT))
    return scale.fit_client_scaler(train)


@query("apply_scaler_join", using(fx.DAILY_SQL, SCALER_SQL, f"""
SELECT ClientID, Date, {q6('(Consumption - mean) / std')} AS Consumption_Scaled
FROM daily LEFT JOIN scaler USING (ClientID)"""))
def apply_scaler_join(spark, d):
    scaled = scale.apply_scaler_join(fx.daily_meter(spark, d), daily_scaler(spark, d), ["Consumption"])
    return scaled.select("ClientID", "Date", r6("Consumption_Scaled").alias("Consumption_Scaled"))


# ---- aggregations -----------------------------------------------------------------------

@query("recent_consumption", using(fx.HOURLY_SQL, RECENT_SQL))
def recent_consumption(spark, d):
    return clean.recent_consumption(fx.hourly_meter(spark, d), days=1)


@query("national_temperature", using(fx.WEATHER_SQL, f"SELECT Date, {q6('temp')} AS temp FROM national"))
def national_temperature(spark, d):
    return weather.national_temperature(fx.station_weather(spark, d)).select("Date", r6("temp").alias("temp"))


@query("client_mean", using(fx.DAILY_SQL, f"""
SELECT ClientID, {q6('avg(Consumption)')} AS mean FROM daily WHERE Date < TIMESTAMP '{fx.DAILY_CUT}' GROUP BY 1"""))
def client_mean_query(spark, d):
    train, _ = clean.split_by_date(fx.daily_meter(spark, d), fx.stamp(fx.DAILY_CUT))
    return client_mean(train).select("ClientID", r6("mean").alias("mean"))


@query("fit_client_scaler", using(fx.DAILY_SQL, SCALER_SQL,
       f"SELECT ClientID, {q6('mean')} AS mean, {q6('std')} AS std FROM scaler"))
def fit_client_scaler(spark, d):
    return daily_scaler(spark, d).select("ClientID", r6("mean").alias("mean"), r6("std").alias("std"))


@query("fit_global_scaler", using(fx.WEATHER_SQL, f"""
SELECT {q6('avg(HDH)')} AS mean_HDH, {q6('stddev_pop(HDH)')} AS std_HDH,
       {q6('avg(CDH)')} AS mean_CDH, {q6('stddev_pop(CDH)')} AS std_CDH
FROM weather WHERE Date < TIMESTAMP '{fx.HOURLY_CUT}'"""))
def fit_global_scaler(spark, d):
    hours = weather.national_weather(fx.station_weather(spark, d), base=fx.BASE)
    train, _ = clean.split_by_date(hours, fx.stamp(fx.HOURLY_CUT))
    row = scale.fit_global_scaler(train, ["HDH", "CDH"])
    return row.select(*[r6(c).alias(c) for c in row.columns])


@query("cluster_series", using(fx.HOURLY_SQL, fx.WEATHER_SQL, f"""
SELECT h.Cluster, h.Date, {q6('avg(h.Consumption)')} AS Consumption, {q6('max(w.HDH)')} AS HDH,
       max(CAST(isodow(h.Date) >= 6 AS INTEGER)) AS Is_Weekend
FROM hourly h LEFT JOIN weather w USING (Date) GROUP BY 1, 2"""))
def cluster_series(spark, d):
    from gridlens.functions.dates import is_weekend

    hours = weather.national_weather(fx.station_weather(spark, d), base=fx.BASE)
    rows = weather.join_weather(fx.hourly_meter(spark, d), hours).withColumn("Is_Weekend", is_weekend("Date"))
    out = merge.cluster_series(rows, ["Consumption"], ["HDH"], ["Is_Weekend"])
    return out.withColumns({"Consumption": r6("Consumption"), "HDH": r6("HDH")})


PORTFOLIO_SQL = """
portfolio AS (
  SELECT Cluster, Date, sum(Actual_kW) AS Actual_kW, sum(Predicted_kW) AS Predicted_kW FROM naive
  WHERE Actual_kW IS NOT NULL AND Predicted_kW IS NOT NULL GROUP BY 1, 2)"""
MAPE_SQL = "avg(CASE WHEN Actual_kW > 0.1 THEN abs(Actual_kW - Predicted_kW) / Actual_kW END) * 100"
WMAPE_SQL = "sum(abs(Actual_kW - Predicted_kW)) / nullif(sum(abs(Actual_kW)), 0) * 100"
METRICS_SQL = f"""
SELECT CASE WHEN grouping(Cluster) = 1 THEN 'Global' ELSE CAST(Cluster AS VARCHAR) END AS Cluster,
       round({MAPE_SQL}, 2) AS Portfolio_MAPE, round({WMAPE_SQL}, 2) AS Portfolio_WMAPE
FROM portfolio GROUP BY GROUPING SETS ((Cluster), ())"""


@query("portfolio_sum", using(fx.NAIVE_SQL, PORTFOLIO_SQL, "SELECT * FROM portfolio"))
def portfolio_sum(spark, d):
    return metrics.portfolio_sum(fx.naive_scored(spark, d))


@query("cluster_metrics", using(fx.NAIVE_SQL, PORTFOLIO_SQL, METRICS_SQL))
def cluster_metrics(spark, d):
    return metrics.cluster_metrics(metrics.portfolio_sum(fx.naive_scored(spark, d)))


@query("naive_weekly_score", using(fx.NAIVE_SQL, PORTFOLIO_SQL, METRICS_SQL))
def naive_weekly_score(spark, d):
    """The flagship: error of "same day last week" per client group and overall."""
    lagged = features.add_lags(fx.daily_meter(spark, d), fx.DAILY, {7: "Predicted_kW"}, regular=True)
    _, test = clean.split_by_date(lagged.withColumnRenamed("Consumption", "Actual_kW"), fx.stamp(fx.DAILY_CUT))
    complete = clean.drop_incomplete(test, ["Actual_kW", "Predicted_kW"])
    return metrics.cluster_metrics(metrics.portfolio_sum(complete))


@query("data_quality", using(fx.HOURLY_SQL, TRIMMED_SQL, """
SELECT 'before' AS stage, count(*) AS rows, count(DISTINCT ClientID) AS clients,
       sum(CASE WHEN Consumption IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing FROM hourly
UNION ALL SELECT 'after', count(*), count(DISTINCT ClientID),
       sum(CASE WHEN Consumption IS NULL THEN 1 ELSE 0 END)::BIGINT FROM trimmed"""))
def data_quality(spark, d):
    meter = fx.hourly_meter(spark, d)
    return clean.data_quality(meter, clean.trim_inactive_start(meter))


@query("client_cluster_map", using(fx.DAILY_SQL,
       "SELECT ClientID, max(Cluster) AS Cluster FROM daily GROUP BY 1"))
def client_cluster_map(spark, d):
    return merge.client_cluster_map(fx.daily_meter(spark, d))


# ---- windows ----------------------------------------------------------------------------

@query("gap_report", using(fx.GAPPY_SQL, """
SELECT ClientID, Date, p AS Previous, CAST(epoch(Date) - epoch(p) AS BIGINT) AS gap_seconds
FROM (SELECT ClientID, Date, lag(Date) OVER (PARTITION BY ClientID ORDER BY Date) AS p FROM gappy)
WHERE p IS NOT NULL AND Date - p <> INTERVAL 15 MINUTE"""))
def gap_report(spark, d):
    return features.gap_report(fx.gappy_meter(spark, d), fx.QUARTERLY)


LAG = "lag({0}, {1}) OVER (PARTITION BY ClientID ORDER BY Date)"


@query("add_lags", using(fx.GAPPY_SQL, "SELECT ClientID, Date, Consumption, " + ", ".join(
    f"{LAG.format('Consumption', n)} AS lag_{n}" for n in (1, 4, 24)) + " FROM gappy"))
def add_lags(spark, d):
    names = {n: f"lag_{n}" for n in (1, 4, 24)}
    return features.add_lags(fx.gappy_meter(spark, d), fx.QUARTERLY, names).drop("Cluster")


def weather_readings(spark, d):
    hours = weather.national_weather(fx.station_weather(spark, d), base=fx.BASE)
    return weather.join_weather(fx.hourly_meter(spark, d).drop("Cluster"), hours)


READINGS_SQL = fx.HOURLY_SQL + "," + fx.WEATHER_SQL + """,
readings AS (SELECT h.ClientID, h.Cluster, h.Date, h.Consumption, w.HDH, w.CDH FROM hourly h LEFT JOIN weather w USING (Date))"""


@query("weather_lags", using(READINGS_SQL, f"""
SELECT ClientID, Date, {q6(LAG.format('HDH', 24))} AS HDH_lag24h, {q6(LAG.format('CDH', 24))} AS CDH_lag24h
FROM readings"""))
def weather_lags(spark, d):
    out = features.weather_lags(weather_readings(spark, d), fx.HOURLY, 24)
    return out.select("ClientID", "Date", r6("HDH_lag24h").alias("HDH_lag24h"), r6("CDH_lag24h").alias("CDH_lag24h"))


PAST4 = "OVER (PARTITION BY ClientID ORDER BY Date ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING)"


@query("rolling_mean_past", using(fx.QUARTER_SQL, f"""
SELECT ClientID, Date, CASE WHEN count(Consumption) {PAST4.format(16)} = 16
  THEN {q6(f'avg(Consumption) {PAST4.format(16)}')} END AS Rolling_Mean_4h FROM quarter"""))
def rolling_mean_past(spark, d):
    out = features.rolling_mean_past(fx.quarter_meter(spark, d), fx.QUARTERLY, regular=True)
    return out.select("ClientID", "Date", r6("Rolling_Mean_4h").alias("Rolling_Mean_4h"))


BASE30 = "OVER (PARTITION BY ClientID ORDER BY Date ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)"


def anomaly_sql(v: str) -> str:
    return f"CASE WHEN count({v}) {BASE30} >= 24 THEN {q6(f'{v} - avg({v}) {BASE30}')} END AS {v}_anomaly"


@query("weather_anomaly", using(READINGS_SQL, f"""
SELECT ClientID, Date, {anomaly_sql('HDH')}, {anomaly_sql('CDH')} FROM readings"""))
def weather_anomaly(spark, d):
    out = features.weather_anomaly(weather_readings(spark, d), fx.HOURLY, 240, 24)
    return out.select("ClientID", "Date", r6("HDH_anomaly").alias("HDH_anomaly"), r6("CDH_anomaly").alias("CDH_anomaly"))


@query("add_lags_and_rolling", using(READINGS_SQL, f"""
SELECT * FROM (SELECT ClientID, Date, Consumption, {LAG.format('Consumption', 1)} AS Lag_1h,
  {LAG.format('Consumption', 24)} AS Lag_24h, {LAG.format('Consumption', 168)} AS Lag_1week,
  CASE WHEN count(Consumption) {PAST4.format(4)} = 4 THEN {q6(f'avg(Consumption) {PAST4.format(4)}')} END AS Rolling_Mean_4h,
  {q6(LAG.format('HDH', 24))} AS HDH_lag24h, {q6(LAG.format('CDH', 24))} AS CDH_lag24h,
  {anomaly_sql('HDH')}, {anomaly_sql('CDH')} FROM readings)
WHERE Lag_1week IS NOT NULL AND Rolling_Mean_4h IS NOT NULL"""))
def add_lags_and_rolling(spark, d):
    out = features.add_lags_and_rolling(
        weather_readings(spark, d), fx.HOURLY, fx.HOUR_LAGS, 24, 4, 240, 24, regular=True)
    rounded = ["Rolling_Mean_4h", "HDH_lag24h", "CDH_lag24h", "HDH_anomaly", "CDH_anomaly"]
    return out.drop("HDH", "CDH").withColumns({c: r6(c) for c in rounded})


@query("last_n_per_group", using(fx.TYPES_SQL, """
SELECT Cluster, Date, Consumption FROM (SELECT *, row_number() OVER (PARTITION BY Cluster ORDER BY Date DESC) AS rn
FROM types) WHERE rn <= 336"""))
def last_n_per_group(spark, d):
    return windows.last_n_per_group(fx.type_series(spark, d), fx.TYPES, 336)


@query("last_hours_per_client", using(fx.HOURLY_SQL, """
SELECT ClientID, Date, Consumption FROM (SELECT *, row_number() OVER (PARTITION BY ClientID ORDER BY Date DESC) AS rn
FROM hourly) WHERE rn <= 168"""))
def last_hours_per_client(spark, d):
    return windows.last_hours_per_client(fx.hourly_meter(spark, d), fx.HOURLY).drop("Cluster")


@query("sliding_windows", using(fx.TYPES_SQL, """
numbered AS (SELECT *, row_number() OVER (PARTITION BY Cluster ORDER BY Date) - 1 AS i,
                    count(*) OVER (PARTITION BY Cluster) AS n FROM types),
starts AS (SELECT Cluster, Date AS start, i FROM numbered WHERE i + 192 <= n),
parts AS (SELECT 'input' AS part, 0 AS lo, 167 AS hi UNION ALL SELECT 'target', 144, 191)
SELECT s.Cluster, s.start, p.part, CAST(x.i - s.i - p.lo AS INTEGER) AS pos, x.Consumption AS value
FROM starts s JOIN numbered x ON x.Cluster = s.Cluster AND x.i BETWEEN s.i AND s.i + 191
JOIN parts p ON x.i - s.i BETWEEN p.lo AND p.hi"""))
def sliding_windows(spark, d):
    rows = windows.sliding_windows(fx.type_series(spark, d), fx.TYPES, "Consumption")
    parts = [
        rows.select("Cluster", "start", F.lit(p).alias("part"), F.posexplode(p).alias("pos", "value"))
        for p in ("input", "target")
    ]
    return parts[0].unionByName(parts[1])


W168 = "OVER (PARTITION BY Cluster ORDER BY Date ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"


@query("stationarise_window", using(fx.TYPES_SQL, f"""
SELECT Cluster, Date, {q6('m')} AS window_mean, {q6('s')} AS window_std, {q6('(Consumption - m) / s')} AS scaled
FROM (SELECT *, avg(Consumption) {W168} AS m, sqrt(var_pop(Consumption) {W168} + 1e-5) AS s,
      count(*) {W168} AS n FROM types) WHERE n = 168"""))
def stationarise_window(spark, d):
    out = windows.stationarise_window(fx.type_series(spark, d), fx.TYPES, "Consumption")
    return out.select("Cluster", "Date", *[r6(c).alias(c) for c in ("window_mean", "window_std", "scaled")])


@query("peak_row", using(fx.HOURLY_SQL, """
SELECT ClientID, Consumption AS peak, Date AS peak_time FROM (
  SELECT *, row_number() OVER (PARTITION BY ClientID ORDER BY Consumption DESC, Date) AS rn FROM hourly) WHERE rn = 1"""))
def peak_row(spark, d):
    return windows.peak_row(fx.hourly_meter(spark, d), ["ClientID"], "Consumption", "Date")


@query("order_series", using(fx.HOURLY_SQL, "SELECT ClientID, Date, Consumption FROM hourly"))
def order_series(spark, d):
    return features.order_series(fx.hourly_meter(spark, d).drop("Cluster"), fx.HOURLY)


# ---- time grids -------------------------------------------------------------------------

@query("resample_mean_ffill", using(fx.GAPPY_SQL, f"""
means AS (SELECT ClientID, date_trunc('hour', Date) AS h, avg(Consumption) AS v FROM gappy GROUP BY 1, 2),
grid AS (SELECT ClientID, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM means GROUP BY 1)
SELECT g.ClientID, g.h AS Date, {q6("last_value(m.v IGNORE NULLS) OVER (PARTITION BY g.ClientID ORDER BY g.h)")} AS Consumption
FROM grid g LEFT JOIN means m ON m.ClientID = g.ClientID AND m.h = g.h"""))
def resample_mean_ffill(spark, d):
    out = resample.resample_mean_ffill(fx.gappy_meter(spark, d).drop("Cluster"), fx.QUARTERLY, ["Consumption"])
    return out.withColumn("Consumption", r6("Consumption"))


@query("upsample_ffill", using(fx.HOURLY_SQL, """
SELECT ClientID, unnest(CASE WHEN Date = (SELECT max(Date) FROM hourly) THEN [Date]
  ELSE generate_series(Date, Date + INTERVAL 45 MINUTE, INTERVAL 15 MINUTE) END) AS Date, Consumption FROM hourly"""))
def upsample_ffill(spark, d):
    return resample.upsample_ffill(fx.hourly_meter(spark, d).drop("Cluster"), fx.HOURLY)


@query("asfreq_ffill", using(fx.GAPPY_SQL, """
grid AS (SELECT ClientID, unnest(generate_series(min(Date), max(Date), INTERVAL 15 MINUTE)) AS t FROM gappy GROUP BY 1)
SELECT g.ClientID, g.t AS Date, last_value(m.Consumption IGNORE NULLS) OVER (PARTITION BY g.ClientID ORDER BY g.t) AS Consumption
FROM grid g LEFT JOIN gappy m ON m.ClientID = g.ClientID AND m.Date = g.t"""))
def asfreq_ffill(spark, d):
    return resample.asfreq_ffill(fx.gappy_meter(spark, d).drop("Cluster"), fx.QUARTERLY, ["Consumption"])


@query("hourly_block_mean", using(fx.QUARTER_SQL, f"""
SELECT ClientID, (CAST(epoch(Date) AS BIGINT) // 900) // 4 AS block, {q6('avg(Consumption)')} AS Consumption
FROM quarter GROUP BY 1, 2"""))
def hourly_block_mean(spark, d):
    placed = fx.quarter_meter(spark, d).withColumn("step", F.floor(series.epoch("Date") / 900))
    out = resample.hourly_block_mean(placed, ["ClientID"], "step", ["Consumption"])
    return out.withColumn("Consumption", r6("Consumption"))


MIRROR_ORIGIN, MIRROR_STEPS = "2001-11-05 00:00:00", 400


@query("mirror_future", using(fx.DAILY_SQL, f"""
mirror AS (
  SELECT ClientID, Consumption, row_number() OVER (PARTITION BY ClientID ORDER BY Date) - 1 AS i,
         least(count(*) OVER (PARTITION BY ClientID), {MIRROR_STEPS}) AS m
  FROM daily WHERE Date BETWEEN TIMESTAMP '{MIRROR_ORIGIN}' - INTERVAL 1 YEAR
    AND TIMESTAMP '{MIRROR_ORIGIN}' - INTERVAL 1 YEAR + INTERVAL {MIRROR_STEPS} DAY)
SELECT ClientID, TIMESTAMP '{MIRROR_ORIGIN}' + j * INTERVAL 1 DAY AS Date, Consumption,
       CAST(isodow(TIMESTAMP '{MIRROR_ORIGIN}' + j * INTERVAL 1 DAY) AS INTEGER) AS Weekday
FROM (SELECT unnest(range(0, {MIRROR_STEPS})) AS j) s JOIN mirror ON i = j % m"""))
def mirror_future(spark, d):
    meter = fx.daily_meter(spark, d).drop("Cluster")
    requests = fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("request_id"), fx.client_name(F.col("s_suppkey")).alias("ClientID"),
        F.lit(MIRROR_STEPS).alias("horizon_steps"))
    out = resample.mirror_future(meter, requests, fx.stamp(MIRROR_ORIGIN), fx.DAILY)
    return out.select("ClientID", "Date", "Consumption", "Weekday")
