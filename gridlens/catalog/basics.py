"""Sources, projections, scalars and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens import fixtures as fx
from gridlens.catalog.registry import q6, query, r6, using
from gridlens.functions import dates, values
from gridlens.models import ols, store
from gridlens.operators import clean, features, reshape, scale
from gridlens.session import cut_lineage, shared_dir
from gridlens.sources import meters

# ---- sources and sinks ------------------------------------------------------------------

CELLS = [f"{r}_{t}" for r, t in fx.WIDE_CELLS]


@query("read_meter_csv", using(
    fx.WIDE_SQL, "SELECT Date, " + ", ".join(f'"{c}" / 2 AS "{c}"' for c in CELLS) + " FROM wide"))
def read_meter_csv(spark, d):
    wide = fx.wide_meter(spark, d)
    comma = [
        F.regexp_replace((F.col(c) / 2).cast("string"), r"\.", ",").alias(c) for c in CELLS
    ]
    path = shared_dir(spark)
    stamp = F.date_format("Date", "yyyy-MM-dd HH:mm:ss").alias("_c0")
    wide.select(stamp, *comma).write.option("sep", ";").option("header", True).csv(path)
    return meters.read_meter_csv(spark, path)


@query("unread_cells", """
SELECT 'Date' AS "column", count(CASE WHEN l_linenumber = 7 THEN 1 END) AS cells FROM lineitem
UNION ALL SELECT 'MT_001', count(CASE WHEN l_returnflag = 'A' THEN 1 END) FROM lineitem""")
def unread_cells(spark, d):
    """One row a line item; stamps of seventh lines and readings of returned ones are spoilt on purpose."""
    line = fx.table(spark, d, "lineitem")
    spoilt = F.date_format("l_shipdate", "dd.MM.yyyy HH:mm")
    stamp = F.when(F.col("l_linenumber") == 7, spoilt).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    load = F.concat(F.when(F.col("l_returnflag") == "A", "1.000,").otherwise(""), F.col("l_quantity").cast("int"))
    path = shared_dir(spark)
    line.select(stamp.alias("_c0"), load.alias("MT_001")).write.option("sep", ";").option("header", True).csv(path)
    return meters.unread_cells(spark, path)


TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("dedupe_timestamps", f"""
SELECT Date, {', '.join(TIE)} FROM (
  SELECT l_shipdate AS Date, {', '.join(TIE)},
         row_number() OVER (PARTITION BY l_shipdate ORDER BY {', '.join(TIE)}) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedupe_timestamps(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("Date"), *TIE)
    return meters.dedupe_timestamps(rows, TIE)


@query("require_time_column", using(
    fx.WIDE_SQL, "SELECT 'Date' AS time_column, count(Date) AS stamps FROM wide"))
def require_time_column(spark, d):
    wide = fx.wide_meter(spark, d)
    name = meters.require_time_column(wide)
    return wide.agg(F.lit(name).alias("time_column"), F.count(name).alias("stamps"))


@query("read_features", using(
    fx.DAILY_SQL, "SELECT ClientID, Date, Consumption FROM daily WHERE year(Date) IN (1996, 1997)"))
def read_features(spark, d):
    path = shared_dir(spark)
    meters.write_features(fx.daily_meter(spark, d), path)
    years = [1996, 1997]  # the feature itself: only these folders are read
    return meters.read_features(spark, path, years, ["ClientID", "Date", "Consumption"])


@query("write_features", using(fx.DAILY_SQL, """
SELECT CAST(year(Date) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT ClientID) AS clients,
       min(Date) AS first_day, max(Date) AS last_day, sum(Consumption) AS total
FROM daily GROUP BY 1"""))
def write_features(spark, d):
    path = shared_dir(spark)
    meters.write_features(fx.daily_meter(spark, d), path)
    per_client = meters.read_features(spark, path).groupBy("year", "ClientID").agg(
        F.count(F.lit(1)).alias("n"), F.min("Date").alias("lo"), F.max("Date").alias("hi"),
        F.sum("Consumption").alias("c"),
    )
    return per_client.groupBy("year").agg(
        F.sum("n").alias("n_rows"), F.count("ClientID").alias("clients"),
        F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.sum("c").alias("total"),
    )


LAG7_FIT_SQL = using(fx.DAILY_SQL, f"""
SELECT Cluster, {q6('regr_slope(Consumption, p)')} AS slope,
       {q6('regr_intercept(Consumption, p)')} AS intercept
FROM (SELECT *, lag(Consumption, 7) OVER (PARTITION BY ClientID ORDER BY Date) AS p FROM daily)
WHERE p IS NOT NULL AND Date < TIMESTAMP '{fx.DAILY_CUT}' GROUP BY Cluster""")


def lag7_fit(spark, d):
    lagged = features.add_lags(fx.daily_meter(spark, d), fx.DAILY, {7: "lag7"}, regular=True)
    train, _ = clean.split_by_date(lagged, fx.stamp(fx.DAILY_CUT))
    return ols.fit(train, ["lag7"], target="Consumption")


@query("save_model", LAG7_FIT_SQL)
def save_model(spark, d):
    path = shared_dir(spark)
    store.save_model({"coefs": lag7_fit(spark, d)}, path, "lr")
    coefs = store.load_model(spark, path, "lr", "day_ahead", ["coefs"])["coefs"]
    return coefs.select(
        "Cluster", r6(F.col("coef")[0]).alias("slope"), r6("intercept").alias("intercept")
    )


@query("read_station_weather", using(
    fx.STATIONS_SQL, f"SELECT station, Date, {q6('temp')} AS temp FROM stations"))
def read_station_weather(spark, d):
    stations = fx.station_weather(spark, d)
    hours = F.sort_array(F.collect_list(F.struct(
        F.date_format("Date", "yyyy-MM-dd'T'HH:mm").alias("time"), F.col("temp"))))
    # One reply per station and day, so no array grows beyond 24 hours.
    replies = stations.groupBy("station", F.to_date("Date").alias("day")).agg(hours.alias("h"))
    path = shared_dir(spark)
    replies.select("station", F.struct(
        F.col("h.time").alias("time"), F.col("h.temp").alias("temperature_2m")
    ).alias("hourly")).write.json(path)
    return meters.read_station_weather(spark, path).select("station", "Date", r6("temp").alias("temp"))


# ---- projections and filters ------------------------------------------------------------

@query("split_by_date", using(fx.DAILY_SQL, f"""
SELECT ClientID, Date, CASE WHEN Date < TIMESTAMP '{fx.DAILY_CUT}' THEN 'train' ELSE 'test' END AS part
FROM daily"""))
def split_by_date(spark, d):
    train, test = clean.split_by_date(fx.daily_meter(spark, d), fx.stamp(fx.DAILY_CUT))
    cols = ["ClientID", "Date"]
    return train.select(*cols, F.lit("train").alias("part")).unionByName(
        test.select(*cols, F.lit("test").alias("part")))


@query("drop_incomplete", using(fx.DAILY_SQL, """
SELECT * FROM (SELECT ClientID, Date, lag(Consumption, 28) OVER (PARTITION BY ClientID ORDER BY Date)
AS lag28 FROM daily) WHERE lag28 IS NOT NULL"""))
def drop_incomplete(spark, d):
    lagged = features.add_lags(fx.daily_meter(spark, d), fx.DAILY, {28: "lag28"}, regular=True)
    return clean.drop_incomplete(lagged, ["lag28"]).select("ClientID", "Date", "lag28")


@query("select_model_columns", using(fx.DAILY_SQL, """
SELECT Cluster, CAST(isodow(Date) AS INTEGER) AS Weekday, CAST(hour(Date) + 1 AS INTEGER) AS Hour,
       CAST(month(Date) AS INTEGER) AS Month, isodow(Date) >= 6 AS Is_Weekend FROM daily"""))
def select_model_columns(spark, d):
    return ols.select_model_columns(dates.calendar_features(fx.daily_meter(spark, d)))


@query("downcast", """
SELECT event_id, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS small,
       CAST(isodow(ts) >= 6 AS INTEGER) AS Is_Weekend FROM events""")
def downcast(spark, d):
    rows = fx.table(spark, d, "events").select(
        "event_id", (F.col("value") / 3).alias("small"), dates.is_weekend("ts").alias("Is_Weekend"))
    small = values.flags_to_int(values.downcast(rows, ["small"]), ["Is_Weekend"])
    return small.withColumn("small", F.col("small").cast("double"))


# ---- dates, text, arithmetic ------------------------------------------------------------

@query("calendar_features", """
SELECT event_id, CAST(isodow(ts) AS INTEGER) AS Weekday, CAST(hour(ts) + 1 AS INTEGER) AS Hour,
       CAST(month(ts) AS INTEGER) AS Month, isodow(ts) >= 6 AS Is_Weekend FROM events""")
def calendar_features(spark, d):
    rows = fx.table(spark, d, "events").select("event_id", "ts")
    return dates.calendar_features(rows, "ts").drop("ts")


EASTER_SQL = """
c1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
c2 AS (SELECT *, b // 4 AS dd, b % 4 AS e, (b + 8) // 25 AS f FROM c1),
c3 AS (SELECT *, (b - f + 1) // 3 AS g FROM c2),
c4 AS (SELECT *, (19 * a + b - dd - g + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM c3),
c5 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM c4),
c6 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM c5),
easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS e FROM c6)"""
ORDER_YEARS_SQL = "years AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders)"


def order_years(spark, d):
    return fx.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@query("easter_date", using(ORDER_YEARS_SQL, EASTER_SQL,
       "SELECT CAST(y AS INTEGER) AS year, CAST(e AS TIMESTAMP) AS easter FROM easter"))
def easter_date(spark, d):
    return order_years(spark, d).select(
        "year", dates.easter_date("year").cast("timestamp_ntz").alias("easter"))


# The test dates lie in 1995–2001, so two of those years are suspended here.
OFF = [1997, 1998]
HOLIDAYS_SQL = f"""
holidays AS (
  SELECT y, make_date(y, m, dd) AS h FROM years, (VALUES {', '.join(f'({m}, {x})' for m, x in dates.FIXED_HOLIDAYS)}) AS f(m, dd)
  UNION SELECT y, CAST(e + n AS DATE) FROM easter, (VALUES {', '.join(f'({n})' for n in dates.EASTER_HOLIDAYS)}) AS f(n)
  UNION SELECT y, make_date(y, m, dd) FROM years, (VALUES {', '.join(f'({m}, {x})' for m, x in dates.SUSPENDABLE_HOLIDAYS)}) AS f(m, dd) WHERE y NOT IN (1997, 1998)
  UNION SELECT y, CAST(e + 60 AS DATE) FROM easter WHERE y NOT IN (1997, 1998))"""


@query("holiday_dates", using(ORDER_YEARS_SQL, EASTER_SQL, HOLIDAYS_SQL,
       "SELECT CAST(y AS INTEGER) AS year, CAST(h AS TIMESTAMP) AS Holiday FROM holidays"))
def holiday_dates(spark, d):
    days = dates.holiday_dates(order_years(spark, d), OFF)
    return days.withColumn("Holiday", F.col("Holiday").cast("timestamp_ntz"))


@query("flag_holidays", using(ORDER_YEARS_SQL, EASTER_SQL, HOLIDAYS_SQL, """
SELECT o_orderkey, o_orderdate AS Date,
       CAST(o_orderdate AS DATE) IN (SELECT h FROM holidays) AS Is_Holiday FROM orders"""))
def flag_holidays(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("Date"))
    return dates.flag_holidays(rows, suspended=OFF)


@query("floor_hour", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def floor_hour(spark, d):
    return fx.table(spark, d, "events").select("event_id", dates.floor_hour("ts").alias("hour"))


@query("degree_hours", """
SELECT event_id, greatest(0.0, 50.0 - value) AS HDH, greatest(0.0, value - 50.0) AS CDH FROM events""")
def degree_hours(spark, d):
    return fx.table(spark, d, "events").select("event_id", *values.degree_hours(F.col("value"), 50.0))


@query("log1p_expm1", f"""
SELECT event_id, {q6('ln(1 + value)')} AS log_value, {q6('exp(ln(1 + value)) - 1')} AS back FROM events""")
def log1p_expm1(spark, d):
    logged = fx.table(spark, d, "events").select("event_id", F.log1p("value").alias("x"))
    return logged.select("event_id", r6("x").alias("log_value"), r6(F.expm1("x")).alias("back"))


@query("clamp_nonneg", "SELECT event_id, greatest(value - 50.0, 0.0) AS kw FROM events")
def clamp_nonneg(spark, d):
    return fx.table(spark, d, "events").select(
        "event_id", values.clamp_nonneg(F.col("value") - 50.0).alias("kw"))


# Each customer number is written in one of five ways people type it.
WRITTEN_SQL = """CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS VARCHAR)
  WHEN 1 THEN ' mt_' || CAST(c_custkey AS VARCHAR) || ' ' WHEN 2 THEN 'MT_00' || CAST(c_custkey AS VARCHAR)
  WHEN 3 THEN lower(c_name) ELSE 'Mt_' || CAST(c_custkey AS VARCHAR) || '_x' END"""


@query("normalise_client_id", f"""
SELECT c_custkey, written, CASE WHEN regexp_full_match(u, '(MT_)?[0-9]+')
  THEN {fx.CLIENT_SQL.format("CAST(regexp_extract(u, '[0-9]+') AS BIGINT)")} ELSE u END AS ClientID
FROM (SELECT c_custkey, written, upper(trim(written)) AS u FROM (SELECT c_custkey, {WRITTEN_SQL} AS written FROM customer))""")
def normalise_client_id(spark, d):
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 5
    written = (
        F.when(kind == 0, key)
        .when(kind == 1, F.concat(F.lit(" mt_"), key, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("MT_00"), key))
        .when(kind == 3, F.lower("c_name"))
        .otherwise(F.concat(F.lit("Mt_"), key, F.lit("_x")))
    )
    rows = fx.table(spark, d, "customer").select("c_custkey", written.alias("written"))
    return rows.withColumn("ClientID", values.normalise_client_id(F.col("written")))


@query("time_marks", f"""
SELECT event_id, {q6('hour(ts) / 23.0 - 0.5')} AS mark_hour,
       {q6('(isodow(ts) - 1) / 6.0 - 0.5')} AS mark_weekday FROM events""")
def time_marks(spark, d):
    rows = fx.table(spark, d, "events").select("event_id", *dates.time_marks("ts"))
    return rows.select("event_id", r6("mark_hour").alias("mark_hour"), r6("mark_weekday").alias("mark_weekday"))


FOURIER = [("daily", 1.0, 3), ("weekly", 7.0, 2)]


@query("fourier_terms", "SELECT event_id, " + ", ".join(
    q6(f"{fn}(floor(epoch(ts)) / 86400.0 * (2.0 * pi() * {k} / {p}))") + f" AS {name}_{fn}_{k}"
    for name, p, n in FOURIER for k in range(1, n + 1) for fn in ("sin", "cos")) + " FROM events")
def fourier_terms(spark, d):
    terms = [t for name, p, n in FOURIER for t in dates.fourier_terms("ts", p, n, name)]
    rows = fx.table(spark, d, "events").select("event_id", *terms)
    return rows.select("event_id", *[r6(c).alias(c) for c in rows.columns if c != "event_id"])


# ---- reshaping --------------------------------------------------------------------------

@query("melt_clients", using(fx.WIDE_SQL, " UNION ALL ".join(
    f"SELECT Date, '{c}' AS ClientID, \"{c}\" AS Consumption FROM wide" for c in CELLS)))
def melt_clients(spark, d):
    return reshape.melt_clients(fx.wide_meter(spark, d))


@query("hourly_profile_matrix", using(fx.HOURLY_SQL, "SELECT ClientID, " + ", ".join(
    f"coalesce({q6(f'avg(CASE WHEN hour(Date) = {h - 1} THEN Consumption END)')}, 0.0) AS h{h}"
    for h in range(1, 25)) + " FROM hourly GROUP BY 1"))
def hourly_profile_matrix(spark, d):
    meter = fx.hourly_meter(spark, d).withColumn("Hour", dates.hour_of_day("Date"))
    matrix = reshape.hourly_profile_matrix(meter)
    return matrix.select("ClientID", *[r6(f"h{h}").alias(f"h{h}") for h in range(1, 25)])


CALENDAR = ["Hour", "Weekday", "Month"]
PART = {"Hour": "hour(ts) + 1", "Weekday": "isodow(ts)", "Month": "month(ts)"}


@query("one_hot", "SELECT event_id, " + ", ".join(
    f'CAST({PART[c]} = {v} AS INTEGER) AS "{c}_{v}"' for c in CALENDAR for v in reshape.LEVELS[c][1:])
    + " FROM events")
def one_hot(spark, d):
    rows = dates.calendar_features(fx.table(spark, d, "events").select("event_id", "ts"), "ts")
    return reshape.one_hot(rows.drop("ts", "Is_Weekend"), {c: reshape.LEVELS[c] for c in CALENDAR})


EXPECTED = ["Month_1", "Weekday_7", "Hour_24", "Lag_1week_Scaled", "HDH", "Is_Weekend"]


@query("align_features", using(fx.DAILY_SQL, f"""
SELECT ClientID, Date, 0.0::DOUBLE AS Month_1, CAST(isodow(Date) = 7 AS DOUBLE) AS Weekday_7, CAST(hour(Date) = 23 AS DOUBLE) AS Hour_24,
       {q6('(p - m) / s')} AS Lag_1week_Scaled, 0.0::DOUBLE AS HDH, CAST(isodow(Date) >= 6 AS DOUBLE) AS Is_Weekend
FROM (SELECT *, lag(Consumption, 7) OVER (PARTITION BY ClientID ORDER BY Date) AS p,
        avg(Consumption) OVER (PARTITION BY ClientID) AS m, stddev_pop(Consumption) OVER (PARTITION BY ClientID) AS s
      FROM daily)"""))
def align_features(spark, d):
    meter = fx.daily_meter(spark, d)
    rows = features.add_lags(dates.calendar_features(meter), fx.DAILY, {7: "Lag_1week"}, regular=True)
    ready = scale.apply_scaler_join(rows, scale.fit_client_scaler(meter), [], keep_stats=True)
    out = reshape.align_features(ready, EXPECTED, ["ClientID", "Date"])
    return out.withColumn("Lag_1week_Scaled", r6("Lag_1week_Scaled"))


@query("union_splits", using(fx.DAILY_SQL, "SELECT ClientID, Date, Consumption FROM daily"))
def union_splits(spark, d):
    cols = ["ClientID", "Date", "Consumption"]
    train, test = clean.split_by_date(fx.daily_meter(spark, d).select(*cols), fx.stamp(fx.DAILY_CUT))
    return reshape.union_splits(train, test)


@query("repeat_and_tile", using(fx.TYPES_SQL, f"""
SELECT p.Cluster, j AS step, {q6('p.v')} AS v
FROM (SELECT unnest(range(0, 200)) AS j) t
JOIN (SELECT Cluster, hour(Date) AS h, avg(Consumption) AS v FROM types GROUP BY 1, 2) p
  ON p.h = (t.j // 4) % 24"""))
def repeat_and_tile(spark, d):
    pattern = fx.type_series(spark, d).groupBy("Cluster", F.hour("Date").cast("long").alias("step")).agg(
        F.avg("Consumption").alias("v"))
    return reshape.repeat_and_tile(pattern, 200).select("Cluster", "step", r6("v").alias("v"))
