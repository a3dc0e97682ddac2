"""Segments, models, diagnostics and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens import fixtures as fx
from gridlens.catalog.basics import LAG7_FIT_SQL, lag7_fit
from gridlens.catalog.registry import q6, query, r6, using
from gridlens.catalog.series import BASE30, LAG, MAPE_SQL, READINGS_SQL, SCALER_SQL, WMAPE_SQL, daily_scaler
from gridlens.functions import dates
from gridlens.models import additive, lagged, ols, store
from gridlens.operators import (
    clean, diagnostics, features, merge, metrics, reshape, scale, segment, weather, windows,
)
from gridlens.operators.ranks import exact_quantiles
from gridlens.plans import build, serving, study
from gridlens.session import cut_lineage, shared_dir

# ---- segments ---------------------------------------------------------------------------

PROFILE_SQL = """
profile AS (
  SELECT c.ClientID, h.h AS Hour, coalesce(avg(m.Consumption), 0.0) AS v
  FROM (SELECT DISTINCT ClientID FROM hourly) c CROSS JOIN (SELECT unnest(range(1, 25)) AS h) h
  LEFT JOIN hourly m ON m.ClientID = c.ClientID AND hour(m.Date) + 1 = h.h GROUP BY 1, 2),
shape AS (
  SELECT ClientID, Hour, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0 END AS v FROM (
    SELECT *, min(v) OVER (PARTITION BY ClientID) AS lo, max(v) OVER (PARTITION BY ClientID) AS hi FROM profile))"""


def shapes(spark, d):
    meter = fx.hourly_meter(spark, d).withColumn("Hour", dates.hour_of_day("Date"))
    return segment.row_minmax(reshape.hourly_profile_matrix(meter))


@query("row_minmax", using(fx.HOURLY_SQL, PROFILE_SQL,
       f"SELECT ClientID, CAST(Hour AS INTEGER) AS Hour, {q6('v')} AS scaled FROM shape"))
def row_minmax(spark, d):
    long = shapes(spark, d).unpivot(["ClientID"], segment.HOURS, "h", "v")
    return long.select("ClientID", F.substring("h", 2, 2).cast("int").alias("Hour"), r6("v").alias("scaled"))


@query("profile_clusters")
def profile_clusters(spark, d):
    return segment.profile_clusters(shapes(spark, d))


@query("elbow_curve")
def elbow_curve(spark, d):
    return segment.elbow_curve(shapes(spark, d)).withColumn("inertia", r6("inertia"))


@query("cluster_shapes", using(fx.HOURLY_SQL, PROFILE_SQL, f"""
SELECT k.Cluster, CAST(s.Hour AS INTEGER) AS Hour, count(*) AS size, {q6('avg(s.v)')} AS mean_scaled
FROM shape s JOIN (SELECT DISTINCT ClientID, Cluster FROM hourly) k USING (ClientID) GROUP BY 1, 2"""))
def cluster_shapes(spark, d):
    clusters = merge.client_cluster_map(fx.hourly_meter(spark, d))
    out = segment.cluster_shapes(shapes(spark, d), clusters)
    return out.withColumn("mean_scaled", r6("mean_scaled"))


LOG_MEANS_SQL = "means AS (SELECT ClientID, ln(1 + avg(Consumption)) AS x FROM hourly GROUP BY 1)"
JENKS_SQL = """
vals AS (SELECT x, count(*)::DOUBLE AS w FROM means GROUP BY 1),
cum AS (SELECT row_number() OVER o AS n, x, sum(w) OVER o AS W, sum(w * (x - c)) OVER o AS S, sum(w * (x - c) * (x - c)) OVER o AS Q
        FROM vals, (SELECT sum(x * w) / sum(w) AS c FROM vals) WINDOW o AS (ORDER BY x)),
pairs AS (
  SELECT a.x AS break_1, b.x AS break_2,
         a.Q - a.S * a.S / a.W + (b.Q - a.Q) - (b.S - a.S) * (b.S - a.S) / (b.W - a.W)
         + (t.Q - b.Q) - (t.S - b.S) * (t.S - b.S) / (t.W - b.W) AS sse
  FROM cum a JOIN cum b ON a.n < b.n, (SELECT * FROM cum ORDER BY n DESC LIMIT 1) t WHERE b.n < t.n),
breaks AS (SELECT (SELECT min(x) FROM vals) AS low, break_1, break_2, (SELECT max(x) FROM vals) AS high
           FROM pairs ORDER BY sse LIMIT 1)"""


def log_means(spark, d):
    return segment.log_mean(build.client_mean(fx.hourly_meter(spark, d)))


@query("jenks_breaks", using(fx.HOURLY_SQL, LOG_MEANS_SQL, JENKS_SQL,
       f"SELECT {q6('low')} AS low, {q6('break_1')} AS break_1, {q6('break_2')} AS break_2, {q6('high')} AS high FROM breaks"))
def jenks_breaks(spark, d):
    out = segment.jenks_breaks(log_means(spark, d), "log_mean")
    return out.select(*[r6(c).alias(c) for c in out.columns])


TIERS_SQL = JENKS_SQL + """,
tiers AS (SELECT ClientID, x, CASE WHEN x <= break_1 THEN 'Light' WHEN x <= break_2 THEN 'Medium' ELSE 'Heavy' END AS Consumer_Category
          FROM means, breaks)"""


def tiers(spark, d):
    means = cut_lineage(log_means(spark, d))  # a break is one of these very values
    return segment.volume_segments(means, segment.jenks_breaks(means, "log_mean"))


@query("volume_tier", using(fx.HOURLY_SQL, LOG_MEANS_SQL, TIERS_SQL,
       f"SELECT ClientID, {q6('x')} AS log_mean, Consumer_Category FROM tiers"))
def volume_tier(spark, d):
    return tiers(spark, d).select("ClientID", r6("log_mean").alias("log_mean"), "Consumer_Category")


@query("tier_histogram", using(fx.HOURLY_SQL, LOG_MEANS_SQL, TIERS_SQL, f"""
SELECT Consumer_Category, CAST(least(floor((x - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin,
       {q6('100.0 * n / (SELECT count(*) FROM means)')} AS tier_percent, count(*) AS clients
FROM tiers JOIN (SELECT Consumer_Category, min(x) AS lo, max(x) AS hi, count(*) AS n FROM tiers GROUP BY 1) USING (Consumer_Category)
GROUP BY 1, 2, 3"""))
def tier_histogram(spark, d):
    return segment.tier_histogram(tiers(spark, d)).withColumn("tier_percent", r6("tier_percent"))


# ---- models -----------------------------------------------------------------------------

# The events are of one year, 2024, with Easter on 31 March.
BUILT_SQL = READINGS_SQL + f""",
holidays AS (
  SELECT make_date(2024, m, d) AS h FROM (VALUES {', '.join(f'({m}, {x})' for m, x in [*dates.FIXED_HOLIDAYS, *dates.SUSPENDABLE_HOLIDAYS])}) AS f(m, d)
  UNION SELECT DATE '2024-03-31' + n FROM (VALUES {', '.join(f'({n})' for n in [*dates.EASTER_HOLIDAYS, *dates.SUSPENDABLE_EASTER_HOLIDAYS])}) AS f(n)),
lagged AS (
  SELECT *, {LAG.format('HDH', 24)} AS HDH_lag24h, {LAG.format('CDH', 24)} AS CDH_lag24h,
         CASE WHEN count(HDH) {BASE30} >= 24 THEN HDH - avg(HDH) {BASE30} END AS HDH_anomaly,
         CASE WHEN count(CDH) {BASE30} >= 24 THEN CDH - avg(CDH) {BASE30} END AS CDH_anomaly,
         {LAG.format('Consumption', 24)} AS Lag_24h, {LAG.format('Consumption', 168)} AS Lag_1week FROM readings),
built AS (SELECT * FROM lagged WHERE Lag_1week IS NOT NULL),
spread AS (SELECT ClientID, avg(Consumption) AS mean, CASE WHEN stddev_pop(Consumption) > 0 THEN stddev_pop(Consumption) ELSE 1 END AS std FROM built GROUP BY 1)"""
PLAIN = [*ols.WEATHER, *ols.FLAGS]


@query("regressors", using(BUILT_SQL, f"""
ready AS (
  SELECT *, CAST(isodow(Date) >= 6 AS DOUBLE) AS Is_Weekend, CAST(CAST(Date AS DATE) IN (SELECT h FROM holidays) AS DOUBLE) AS Is_Holiday,
         (Lag_24h - mean) / std AS Lag_24h_Scaled, (Lag_1week - mean) / std AS Lag_1week_Scaled
  FROM built JOIN spread USING (ClientID))
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS regressor, {q6(f'avg({c})')} AS mean, {str(c in PLAIN).lower()} AS long_term FROM ready"
    for c in [*PLAIN, *ols.SCALED_LAGS])))
def regressors(spark, d):
    table = cut_lineage(fx.hourly_features(spark, d))
    names = ols.regressors("day_ahead", table.columns)
    p = scale.apply_scaler_join(table, scale.fit_client_scaler(table), ["Lag_24h", "Lag_1week"])
    stats = p.agg(*[r6(F.avg(F.col(n).cast("double"))).alias(n) for n in names])
    long_term = set(ols.regressors("long_term", table.columns))
    flags = F.col("regressor").isin(sorted(long_term))
    return stats.unpivot([], names, "regressor", "mean").withColumn("long_term", flags)


@query("cluster_ols_fit", LAG7_FIT_SQL)
def cluster_ols_fit(spark, d):
    return lag7_fit(spark, d).select(
        "Cluster", r6(F.col("coef")[0]).alias("slope"), r6("intercept").alias("intercept"))


OLS_SQL = fx.DAILY_SQL + "," + SCALER_SQL + f""",
scaled AS (
  SELECT ClientID, Cluster, Date, Consumption, mean, std, (Consumption - mean) / std AS y, (p - mean) / std AS x FROM (
    SELECT *, lag(Consumption, 7) OVER (PARTITION BY ClientID ORDER BY Date) AS p FROM daily) JOIN scaler USING (ClientID)),
fitted AS (SELECT Cluster, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM scaled
           WHERE x IS NOT NULL AND Date < TIMESTAMP '{fx.DAILY_CUT}' GROUP BY 1),
predicted AS (SELECT ClientID, Cluster, Date, Consumption, mean, std, greatest(b + a * x, -mean / std) AS s
              FROM scaled JOIN fitted USING (Cluster) WHERE Date >= TIMESTAMP '{fx.DAILY_CUT}')"""


def lag7_predicted(spark, d):
    lagged = features.add_lags(fx.daily_meter(spark, d), fx.DAILY, {7: "Lag_1week"}, regular=True)
    scaled = scale.apply_scaler_join(
        lagged, daily_scaler(spark, d), ["Consumption", "Lag_1week"], keep_stats=True)
    train, test = clean.split_by_date(scaled, fx.stamp(fx.DAILY_CUT))
    names = ["Lag_1week_Scaled"]
    return ols.predict_scaled(test, ols.fit(train, names), names)


@query("cluster_ols_predict", using(OLS_SQL,
       f"SELECT ClientID, Cluster, Date, {q6('s')} AS Predicted_Consumption_Scaled FROM predicted"))
def cluster_ols_predict(spark, d):
    return lag7_predicted(spark, d).select(
        "ClientID", "Cluster", "Date", r6("Predicted_Consumption_Scaled").alias("Predicted_Consumption_Scaled"))


@query("inverse_scale", using(OLS_SQL,
       f"SELECT ClientID, Date, {q6('greatest(s * std + mean, 0.0)')} AS Predicted_kW FROM predicted"))
def inverse_scale(spark, d):
    rows = lag7_predicted(spark, d).drop("mean", "std")
    out = scale.inverse_scale(rows, daily_scaler(spark, d))
    return out.select("ClientID", "Date", r6("Predicted_kW").alias("Predicted_kW"))


def scored_by(spark, d, model, mode):
    table = cut_lineage(fx.hourly_features(spark, d))
    out = study.fit_and_score(
        table, model, mode, fx.stamp(fx.HOURLY_CUT), fx.HOURLY, fx.HOUR)
    return out.scored.select(
        "ClientID", "Cluster", "Date", "Actual_kW", F.round("Predicted_kW", 3).alias("Predicted_kW"))


@query("additive_forecast")
def additive_forecast(spark, d):
    return scored_by(spark, d, "prophet", "long_term")


@query("seasonal_arx_forecast")
def seasonal_arx_forecast(spark, d):
    return scored_by(spark, d, "sarimax", "day_ahead")


@query("windowed_forecast")
def windowed_forecast(spark, d):
    return scored_by(spark, d, "nst", "day_ahead")


WINDOW_PLACES, WINDOW_CHANNELS = 6, ["Consumption", "Hour"]


@query("window_products", using(fx.TYPES_SQL, f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY Cluster ORDER BY Date) - 1 AS n, count(*) OVER (PARTITION BY Cluster) AS rows FROM types),
held AS (SELECT *, n >= rows - greatest(CAST(floor(rows * 0.1) AS BIGINT), 193) AS late FROM numbered),
long AS (SELECT Cluster, n, late, 'Consumption' AS channel, Consumption AS v FROM held
         UNION ALL SELECT Cluster, n, late, 'Hour', CAST(hour(Date) + 1 AS DOUBLE) FROM held),
windows AS (
  SELECT a.Cluster, a.n AS start, CASE WHEN a.late THEN 'held' WHEN b.late THEN 'mixed' ELSE 'train' END AS part
  FROM held a JOIN held b ON b.Cluster = a.Cluster AND b.n = a.n + {WINDOW_PLACES - 1}),
placed AS (SELECT w.Cluster, w.part, w.start, l.channel, CAST(l.n - w.start AS INTEGER) AS place, l.v
           FROM windows w JOIN long l ON l.Cluster = w.Cluster AND l.n BETWEEN w.start AND w.start + {WINDOW_PLACES - 1})
SELECT a.Cluster, a.part, a.channel AS channel_i, a.place AS place_i, b.channel AS channel_j, b.place AS place_j,
       count(*) AS windows, {q6('sum(a.v * b.v)')} AS total
FROM placed a JOIN placed b ON b.Cluster = a.Cluster AND b.start = a.start GROUP BY ALL"""))
def window_products(spark, d):
    """Products of all places of two-channel windows, before, across and within the held-out rows."""
    rows = fx.type_series(spark, d).withColumn("Hour", dates.hour_of_day("Date"))
    ready = windows.tail_validation(rows, fx.TYPES)
    sums = lagged.add_up(
        lagged.window_sums(ready, fx.TYPES, WINDOW_CHANNELS, WINDOW_PLACES, "is_validation"), ["Cluster"])
    out = lagged.products_table(sums, ["Cluster"], WINDOW_CHANNELS, WINDOW_PLACES)
    return out.withColumn("total", r6("total"))


@query("additive_optimality", using(fx.TYPES_SQL, "SELECT DISTINCT Cluster, true AS optimal FROM types"))
def additive_optimality(spark, d):
    """Does the additive fit of every cluster meet the conditions of a minimum, bends included?"""
    rows = cut_lineage(fx.type_series(spark, d).withColumn("y", F.col("Consumption") / 10_000).drop("Consumption"))
    design = additive.design_for(rows, [])
    coefs = cut_lineage(additive.fit(rows, design, "y"))
    return additive.optimality(rows, design, coefs, "y").select("Cluster", "optimal")


@query("run_pipelines", using(fx.HOURLY_SQL, fx.WEATHER_SQL, f"""
test AS (SELECT ClientID, Cluster, Date, CAST(epoch(Date) - epoch(TIMESTAMP '{fx.HOURLY_CUT}') AS BIGINT) // 3600 AS o
         FROM hourly WHERE Date >= TIMESTAMP '{fx.HOURLY_CUT}'),
seen AS (SELECT t.o, w.Date IS NOT NULL AS now, y.Date IS NOT NULL AS before
         FROM (SELECT DISTINCT o, Date FROM test) t LEFT JOIN weather w ON w.Date = t.Date
         LEFT JOIN weather y ON y.Date = t.Date - INTERVAL 24 HOUR),
first AS (SELECT greatest((SELECT min(o) FROM seen WHERE now), (SELECT min(o) FROM seen WHERE before)) AS f, (SELECT max(o) FROM seen) AS m),
counted AS (
  SELECT Cluster, count(*) AS n_rows, count(*) FILTER (now AND before) AS direct,
         count(*) FILTER (o // 24 * 24 + 23 <= m AND (f = 0 OR o // 24 = 0 OR o // 24 * 24 - 168 >= f)) AS windowed
  FROM test JOIN seen USING (o), first GROUP BY 1)
SELECT model, Cluster, n_rows, CASE model WHEN 'sarimax' THEN n_rows WHEN 'nst' THEN windowed ELSE direct END AS n_forecasts
FROM counted, (SELECT unnest(['lr', 'prophet', 'sarimax', 'nst']) AS model)"""))
def run_pipelines(spark, d):
    """All four models from the stored features to saved tables; how many hours each could forecast."""
    stored, saved = shared_dir(spark), shared_dir(spark)
    fx.hourly_features(spark, d).write.parquet(stored)
    parts = []
    for model, mode in (("lr", "day_ahead"), ("prophet", "long_term"), ("sarimax", "day_ahead"), ("nst", "day_ahead")):
        tables = study.run_pipeline(
            spark, stored, model, mode, fx.stamp(fx.HOURLY_CUT), saved, shared_dir(spark), fx.HOURLY, fx.HOUR)
        parts.append(tables["coverage"].withColumn("model", F.lit(model)))
    return reshape.union_splits(*parts).select("model", "Cluster", "n_rows", "n_forecasts")


@query("rolling_origin", using(fx.TYPES_SQL, f"""
placed AS (SELECT *, CAST(epoch(Date) - epoch(TIMESTAMP '{fx.HOURLY_CUT}') AS BIGINT) // 3600 AS o FROM types),
last AS (SELECT Cluster, max(o) AS m FROM placed GROUP BY 1)
SELECT p.Cluster, p.Date + INTERVAL 168 HOUR AS Date, CAST((p.o + 168) % 24 AS INTEGER) AS step, p.Consumption AS Predicted
FROM placed p JOIN last USING (Cluster)
WHERE p.o + 168 >= 0 AND ((p.o + 168) // 24) * 24 + 23 <= m"""))
def rolling_origin(spark, d):
    rows = fx.type_series(spark, d).withColumn("_start", fx.stamp(fx.HOURLY_CUT))
    origins = windows.window_origins(rows, fx.TYPES, "Consumption", "_start")
    # The naive model repeats the first day of the window: the same hour one week ago.
    out = windows.rolling_origin(origins, fx.TYPES, F.slice("input", 1, 24))
    return out.select("Cluster", "Date", "step", "Predicted")


@query("tail_validation", using(fx.HOURLY_SQL, """
SELECT ClientID, Date, n - rn < greatest(CAST(floor(n * 0.1) AS BIGINT), 193) AS is_validation
FROM (SELECT *, row_number() OVER (PARTITION BY ClientID ORDER BY Date) AS rn, count(*) OVER (PARTITION BY ClientID) AS n FROM hourly)"""))
def tail_validation(spark, d):
    return windows.tail_validation(fx.hourly_meter(spark, d).select("ClientID", "Date"), fx.HOURLY)


@query("fit_and_score")
def fit_and_score(spark, d):
    table = cut_lineage(fx.hourly_features(spark, d))
    return study.fit_and_score(
        table, "lr", "day_ahead", fx.stamp(fx.HOURLY_CUT), fx.HOURLY, fx.HOUR).summary


@query("process_data")
def process_data(spark, d):
    readings = build.flag_holidays(build.calendar_features(fx.hourly_meter(spark, d).drop("Cluster")))
    hours = weather.national_weather(fx.station_weather(spark, d), base=fx.BASE)
    return build.process_data(
        readings, hours, fx.stamp(fx.HOURLY_CUT), fx.HOURLY, fx.HOUR_LAGS, day=24, rolling=4,
        baseline=240, baseline_least=24)


# ---- evaluation and diagnostics ---------------------------------------------------------

@query("mape", using(fx.NAIVE_SQL, f"SELECT ClientID, round({MAPE_SQL}, 2) AS MAPE FROM naive GROUP BY 1"))
def mape(spark, d):
    return fx.naive_scored(spark, d).groupBy("ClientID").agg(F.round(metrics.mape(), 2).alias("MAPE"))


@query("wmape", using(fx.NAIVE_SQL, f"SELECT ClientID, round({WMAPE_SQL}, 2) AS WMAPE FROM naive GROUP BY 1"))
def wmape(spark, d):
    return fx.naive_scored(spark, d).groupBy("ClientID").agg(F.round(metrics.wmape(), 2).alias("WMAPE"))


PERIOD_SQL = """
edges AS (SELECT epoch_us(min(Date)) AS lo, epoch_us(max(Date)) AS hi FROM naive),
binned AS (
  SELECT *, CAST(least(greatest(ceil((epoch_us(Date) - lo) / ((hi - lo) / 4.0)), 1), 4) AS INTEGER) AS period FROM naive, edges
  WHERE Actual_kW IS NOT NULL AND Predicted_kW IS NOT NULL),
named AS (
  SELECT *, strftime(make_timestamp(CAST(floor(lo + (hi - lo) / 4.0 * (period - 1) - CASE WHEN period = 1 THEN (hi - lo) * 0.001 ELSE 0 END) AS BIGINT)), '%b %d')
    || ' to ' || strftime(make_timestamp(CAST(floor(lo + (hi - lo) / 4.0 * period) AS BIGINT)), '%b %d') AS Time_Period FROM binned)"""


@query("period_metrics", using(fx.NAIVE_SQL, PERIOD_SQL, f"""
SELECT period, Time_Period, round({MAPE_SQL}, 2) AS MAPE, round({WMAPE_SQL}, 2) AS WMAPE FROM named GROUP BY 1, 2"""))
def period_metrics(spark, d):
    return metrics.period_metrics(cut_lineage(fx.naive_scored(spark, d)))


@query("error_box_stats", using(fx.NAIVE_SQL, PERIOD_SQL, f"""
errors AS (
  SELECT period, 'Abs_Error' AS kind, abs(Actual_kW - Predicted_kW) AS e FROM binned
  UNION ALL SELECT period, 'APE', abs(Actual_kW - Predicted_kW) / Actual_kW * 100 FROM binned WHERE Actual_kW > 0.1),
box AS (SELECT period, kind, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM errors GROUP BY 1, 2)
SELECT period, kind, {q6('q1')} AS q1, {q6('median')} AS median, {q6('q3')} AS q3,
       {q6('least(min(CASE WHEN e >= q1 - 1.5 * (q3 - q1) THEN e END), q1)')} AS whisker_low,
       {q6('greatest(max(CASE WHEN e <= q3 + 1.5 * (q3 - q1) THEN e END), q3)')} AS whisker_high
FROM errors JOIN box USING (period, kind) GROUP BY period, kind, q1, median, q3"""))
def error_box_stats(spark, d):
    out = metrics.error_box_stats(cut_lineage(fx.naive_scored(spark, d)))
    cols = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return out.select("period", "kind", *[r6(c).alias(c) for c in cols])


@query("exact_quantiles", using(fx.HOURLY_SQL, f"""
SELECT Cluster, {q6('quantile_cont(Consumption, 0.9)')} AS p90, {q6('quantile_cont(Consumption, 0.99)')} AS p99
FROM hourly GROUP BY 1"""))
def exact_quantiles_query(spark, d):
    out = exact_quantiles(
        fx.hourly_meter(spark, d), ["Cluster"], "Consumption", {"p90": 0.9, "p99": 0.99}, bucket_rows=1000)
    return out.select("Cluster", r6("p90").alias("p90"), r6("p99").alias("p99"))


def errors_sql(lag: int, name: str) -> str:
    return f"""
p{lag} AS (SELECT Cluster, Date, sum(Consumption) AS Actual_kW, sum(p) AS Predicted_kW FROM (
  SELECT *, lag(Consumption, {lag}) OVER (PARTITION BY ClientID ORDER BY Date) AS p FROM daily)
  WHERE p IS NOT NULL AND Date >= TIMESTAMP '{fx.DAILY_CUT}' GROUP BY 1, 2),
m{lag} AS (SELECT CASE WHEN grouping(Cluster) = 1 THEN 'Global' ELSE CAST(Cluster AS VARCHAR) END AS Cluster,
  round({MAPE_SQL}, 2) AS {name}_MAPE, round({WMAPE_SQL}, 2) AS {name}_WMAPE FROM p{lag} GROUP BY GROUPING SETS ((Cluster), ()))"""


@query("model_comparison", using(fx.DAILY_SQL, errors_sql(7, "week"), errors_sql(1, "day"),
       "SELECT * FROM m7 JOIN m1 USING (Cluster)"))
def model_comparison(spark, d):
    lagged = features.add_lags(fx.daily_meter(spark, d), fx.DAILY, {7: "week", 1: "day"}, regular=True)
    _, test = clean.split_by_date(lagged.withColumnRenamed("Consumption", "Actual_kW"), fx.stamp(fx.DAILY_CUT))
    tables = {
        name: metrics.cluster_metrics(metrics.portfolio_sum(test.withColumn("Predicted_kW", F.col(name))))
        for name in ("week", "day")
    }
    return metrics.model_comparison(tables)


# Seasonal means of whole-number loads often end exactly in half of the sixth place, where the order
# of addition decides the rounding. Their halves end before the ninth place, so that one has no ties.
SEASON_PLACES = 9


@query("seasonal_decompose", using(fx.HOURLY_SQL, f"""
t AS (
  SELECT *, CASE WHEN count(*) OVER w = 25 THEN (sum(Consumption) OVER w - (first_value(Consumption) OVER w + last_value(Consumption) OVER w) / 2) / 24 END AS trend
  FROM hourly WINDOW w AS (PARTITION BY ClientID ORDER BY Date ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
raw AS (SELECT ClientID, hour(Date) AS h, avg(Consumption - trend) AS r FROM t GROUP BY 1, 2),
season AS (SELECT ClientID, h, r - avg(r) OVER (PARTITION BY ClientID) AS s FROM raw)
SELECT t.ClientID, t.Date, {q6('t.trend')} AS trend, round(s.s, {SEASON_PLACES}) + 0.0 AS seasonal,
       round(t.Consumption - s.s - t.trend, {SEASON_PLACES}) + 0.0 AS resid
FROM t JOIN season s ON s.ClientID = t.ClientID AND s.h = hour(t.Date)"""))
def seasonal_decompose(spark, d):
    meter = fx.hourly_meter(spark, d).drop("Cluster")
    out = diagnostics.seasonal_decompose(meter, fx.HOURLY, "Consumption", 24)
    season = [(F.round(c, SEASON_PLACES) + F.lit(0.0)).alias(c) for c in ("seasonal", "resid")]
    return out.select("ClientID", "Date", r6("trend").alias("trend"), *season)


@query("acf", using(fx.HOURLY_SQL, f"""
x AS (SELECT ClientID, row_number() OVER (PARTITION BY ClientID ORDER BY Date) AS i,
             Consumption - avg(Consumption) OVER (PARTITION BY ClientID) AS v FROM hourly),
k AS (SELECT unnest(range(0, 49)) AS lag),
v0 AS (SELECT ClientID, sum(v * v) AS t FROM x GROUP BY 1)
SELECT a.ClientID, CAST(k.lag AS INTEGER) AS lag, {q6('sum(a.v * b.v) / any_value(v0.t)')} AS acf
FROM x a CROSS JOIN k JOIN x b ON b.ClientID = a.ClientID AND b.i = a.i + k.lag JOIN v0 ON v0.ClientID = a.ClientID GROUP BY 1, 2"""))
def acf(spark, d):
    out = diagnostics.acf(fx.hourly_meter(spark, d), fx.HOURLY, "Consumption", 48)
    return out.withColumn("acf", r6("acf"))


@query("pacf", using(fx.TYPES_SQL, f"""
x AS (SELECT Cluster, row_number() OVER (PARTITION BY Cluster ORDER BY Date) AS i,
             Consumption - avg(Consumption) OVER (PARTITION BY Cluster) AS v FROM types),
k AS (SELECT unnest(range(0, 49)) AS lag),
v0 AS (SELECT Cluster, sum(v * v) AS t FROM x GROUP BY 1),
correlations AS (
  SELECT a.Cluster, k.lag, sum(a.v * b.v) / any_value(v0.t) AS acf
  FROM x a CROSS JOIN k JOIN x b ON b.Cluster = a.Cluster AND b.i = a.i + k.lag JOIN v0 ON v0.Cluster = a.Cluster GROUP BY 1, 2),
r AS (SELECT Cluster, list(acf ORDER BY lag) AS r FROM correlations GROUP BY 1),
steps AS (
  WITH RECURSIVE s(Cluster, lag, phi, error, last) AS (
    SELECT Cluster, 0, []::DOUBLE[], 1.0::DOUBLE, 1.0::DOUBLE FROM r
    UNION ALL
    SELECT Cluster, lag + 1, list_append(list_transform(phi, lambda p, i: p - l * phi[len(phi) - i + 1]), l), error * (1 - l * l), l
    FROM (SELECT s.*, (r.r[lag + 2] - coalesce(list_sum(list_transform(phi, lambda p, i: p * r.r[lag + 2 - i])), 0.0)) / error AS l
          FROM s JOIN r USING (Cluster) WHERE lag < 48))
  SELECT * FROM s)
SELECT Cluster, CAST(lag AS INTEGER) AS lag, {q6('last')} AS pacf FROM steps"""))
def pacf(spark, d):
    correlations = diagnostics.acf(fx.type_series(spark, d), fx.TYPES, "Consumption", 48)
    return diagnostics.pacf(correlations, ["Cluster"]).withColumn("pacf", r6("pacf"))


# ---- serving ----------------------------------------------------------------------------

NAME_CASE = "CASE Cluster " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in segment.CLUSTER_NAMES.items()
) + " ELSE 'Cluster ' || CAST(Cluster AS VARCHAR) END"


@query("client_profiles", using(fx.DAILY_SQL, f"""
SELECT *, {NAME_CASE} AS behaviour FROM (
  SELECT ClientID, max(Cluster) AS Cluster, max(CASE WHEN Cluster <= 1 THEN 'Light' WHEN Cluster <= 3 THEN 'Medium' ELSE 'Heavy' END) AS Consumer_Category,
         round(avg(Consumption), 2) AS mean_kw, round(max(Consumption), 2) AS max_kw, round(sum(Consumption) * 24, 2) AS total_kwh
  FROM daily GROUP BY 1)"""))
def client_profiles(spark, d):
    meter = fx.daily_meter(spark, d).withColumn("Consumer_Category", fx.tier_of_cluster(F.col("Cluster")))
    return serving.client_profiles(meter, step_hours=24.0)


MODEL_OF = "CASE CAST(FLOOR(user_id / 3) AS BIGINT) % 6 WHEN 0 THEN 'LR' WHEN 1 THEN 'prophet' WHEN 2 THEN 'sarimax' WHEN 3 THEN 'nst' WHEN 4 THEN 'lr' ELSE 'arima' END"


def all_requests(spark, d):
    """One request per user, written in three ways, one of which names no client; models cycle
    and include an unknown one."""
    users = fx.table(spark, d, "events").select("user_id").distinct()
    key = F.col("user_id").cast("string")
    written = (
        F.when(F.col("user_id") % 3 == 0, key)
        .when(F.col("user_id") % 3 == 1, F.concat(F.lit(" mt_"), key, F.lit(" ")))
        .otherwise(F.concat(F.lit("MT_X"), key))
    )
    return users.select(
        F.col("user_id").alias("request_id"), written.alias("client_id"), F.expr(MODEL_OF).alias("model"),
        F.when(F.col("user_id") % 2 == 0, "day_ahead").otherwise("LONG_TERM").alias("mode"),
        F.lit(48).alias("horizon_hours"))


@query("request_errors", f"""
WITH r AS (SELECT DISTINCT user_id, {MODEL_OF} AS model, user_id % 3 = 2 AS wrong FROM events),
train AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00')
SELECT r.user_id AS request_id, CASE WHEN wrong THEN 'MT_X' || CAST(r.user_id AS VARCHAR) ELSE {fx.CLIENT_SQL.format('r.user_id')} END AS ClientID,
  CASE WHEN wrong THEN 'ClientID ''MT_X' || CAST(r.user_id AS VARCHAR) || ''' not found.'
       WHEN lower(model) = 'arima' THEN 'Unknown model: arima'
       WHEN t.user_id IS NULL THEN 'Client ''' || {fx.CLIENT_SQL.format('r.user_id')} || ''' has no scaler.' END AS error
FROM r LEFT JOIN train t USING (user_id)""")
def request_errors(spark, d):
    meter = fx.gappy_meter(spark, d)
    train, _ = clean.split_by_date(meter, fx.stamp("2024-01-03 00:00:00"))
    out = serving.request_errors(
        all_requests(spark, d), merge.client_cluster_map(meter), scale.fit_client_scaler(train))
    return out.select("request_id", "ClientID", "error")


@query("forecast_batch")
def forecast_batch(spark, d):
    """Fit and save all four models, then serve every request from the saved tables.

    The event data is one month long, so the origin is one year after its last days: those are
    the rows that get mirrored. Each model is saved once, for any mode.
    """
    table = cut_lineage(fx.hourly_features(spark, d))
    path = shared_dir(spark)
    plans = [
        ("lr", "day_ahead", store.ANY_MODE), ("prophet", "long_term", store.ANY_MODE),
        ("sarimax", "day_ahead", store.ANY_MODE), ("nst", "day_ahead", store.ANY_MODE),
    ]
    for model, mode, saved_as in plans:
        out = study.fit_and_score(table, model, mode, fx.stamp(fx.HOURLY_CUT), fx.HOURLY, fx.HOUR)
        store.save_model(out.tables, path, model, saved_as)
    return serving.forecast_batch(
        all_requests(spark, d), table, path, fx.stamp("2025-01-29 00:00:00"), s=fx.HOURLY, hour=fx.HOUR)


@query("forecast_summary", using(fx.NAIVE_SQL, """
SELECT ClientID, round(sum(Predicted_kW * 24), 3) AS total_kwh, round(avg(Predicted_kW), 3) AS mean_kw,
       round(max(Predicted_kW), 3) AS peak_kw, min(CASE WHEN Predicted_kW = mx THEN Date END) AS peak_time,
       min(Date) AS period_start, max(Date) AS period_end
FROM (SELECT *, max(Predicted_kW) OVER (PARTITION BY ClientID) AS mx FROM naive) WHERE Predicted_kW IS NOT NULL GROUP BY 1"""))
def forecast_summary(spark, d):
    return serving.forecast_summary(
        fx.naive_scored(spark, d), ["ClientID"], "Predicted_kW", "Date", step_hours=24.0)
