"""Meter-shaped views over the test tables, each with its SQL twin for the oracle.

Loads are whole numbers (pieces sold, hundredths of an event's value), so sums and means do not
depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.functions.dates import calendar_features, flag_holidays, floor_hour
from gridlens.operators.resample import floor_step
from gridlens.operators.series import Series
from gridlens.session import configure

DAY, HOUR, QUARTER = 86_400, 3_600, 900
DAILY = Series(("ClientID",), "Date", DAY)
HOURLY = Series(("ClientID",), "Date", HOUR)
QUARTERLY = Series(("ClientID",), "Date", QUARTER)
TYPES = Series(("Cluster",), "Date", HOUR)

DAILY_CUT = "2000-01-01 00:00:00"
HOURLY_CUT = "2024-01-23 00:00:00"
BASE = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def client_name(number: Column) -> Column:
    digits = number.cast("string")
    width = F.greatest(F.lit(3), F.length(digits))
    return F.concat(F.lit("MT_"), F.repeat(F.lit("0"), width - F.length(digits)), digits)


CLIENT_SQL = (
    "'MT_' || lpad(CAST({0} AS VARCHAR), greatest(3, length(CAST({0} AS VARCHAR)))::INT, '0')"
)


#: About so many grid rows are made by one task.
TASK_ROWS = 1_000_000


def _micros(time: Column | str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp") if isinstance(time, str) else time.cast("timestamp"))


def _grid(keys: DataFrame, stamps: DataFrame, step: int) -> DataFrame:
    """Each key at every step from the oldest to the newest stamp, generated per key."""
    lo, hi = stamps.agg(F.min("Date")).scalar(), stamps.agg(F.max("Date")).scalar()
    steps = F.explode(F.sequence(lo, hi, F.expr(f"INTERVAL '{step}' SECOND")))
    return keys.withColumn("Date", steps)


def _filled(sums: DataFrame, step: int, lo: int | None, hi: int | None, keys: int) -> DataFrame:
    """Sums of (ClientID, Date) on a grid, with rows of 0 for the steps between ``lo`` and ``hi`` without one.

    A row knows the stamps beside it and generates the empty steps up to the next one (a client's first
    row also those before it), so only the sums are shuffled. They are dealt by client to a number of
    tasks that follows from the rows to be made: sums are few, and tasks cut by their size alone would
    each make a large part of the grid. A client's sums are at most one a step. Sums without a stamp stay.
    """
    width = step * 1_000_000
    grid = keys * ((hi - lo) // width + 1) if lo is not None else 0
    spread = min(sums.sparkSession.sparkContext.defaultParallelism, grid // 50_000)
    order = Window.partitionBy("ClientID").orderBy("_at")
    nothing = F.array().cast("array<bigint>")
    steps = (lambda a, b: nothing) if lo is None else (lambda a, b: F.sequence(a, b, F.lit(width)))
    first, last = F.lit(lo).cast("long"), F.lit(hi).cast("long")
    begin = F.when(F.lag("_at").over(order).isNull(), first).otherwise(F.col("_at"))
    following = F.lead("_at").over(order)
    made = F.when(F.col("_at").isNotNull(), steps(F.col("_begin"), F.coalesce(F.col("_next") - width, last)))
    alone = F.when(F.col("_next").isNull(), steps(first, last)).otherwise(nothing)
    made = made.otherwise(F.concat(F.array(F.lit(None).cast("long")), alone))
    known = F.when(F.col("_step") == F.col("_at"), F.coalesce("Consumption", F.lit(0.0)))
    return (
        sums.withColumn("_at", _micros("Date"))
        .repartition(max(1, spread, -(-grid // TASK_ROWS)), "ClientID")
        .withColumns({"_begin": begin, "_next": following, "Cluster": F.first("Cluster", True).over(order)})
        .withColumn("_step", F.explode(made))
        .withColumns({
            "Date": F.timestamp_micros("_step").cast("timestamp_ntz"),
            "Consumption": F.when(F.col("_step").isNull(), F.col("Consumption")).otherwise(F.coalesce(known, F.lit(0.0))),
        })
        .select("ClientID", "Cluster", "Date", "Consumption")
    )


def daily_meter(spark: SparkSession, d: str, cluster: bool = True) -> DataFrame:
    """Suppliers × all days; pieces sold per day. Cluster = nation of the supplier.

    A row of 0 at the oldest day stands for each supplier, so the grid needs no join.
    """
    suppliers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("Cluster")
    )
    sales = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("Date"),
        F.col("l_quantity").alias("Consumption"),
    )
    lo, hi = sales.agg(F.min(_micros("Date")), F.max(_micros("Date"))).first()
    oldest = F.timestamp_micros(F.lit(lo).cast("long")).cast("timestamp_ntz")
    seeds = suppliers.withColumns({"Date": oldest, "Consumption": F.lit(0.0)})
    both = seeds.unionByName(sales, allowMissingColumns=True)
    # Only days of the grid count.
    summed = both.filter((_micros("Date") - F.lit(lo).cast("long")) % (DAY * 1_000_000) == 0).groupBy("k", "Date").agg(
        F.max("Cluster").alias("Cluster"), F.sum("Consumption").alias("Consumption")
    )
    named = summed.select(client_name(F.col("k")).alias("ClientID"), "Cluster", "Date", "Consumption")
    # A sale of a key that is no supplier has no nation and is not in the grid.
    out = _filled(named, DAY, lo, hi, suppliers.count()).filter(F.col("Cluster").isNotNull())
    return out if cluster else out.drop("Cluster")


DAILY_SQL = f"""
daily AS (
  SELECT {CLIENT_SQL.format('g.s_suppkey')} AS ClientID, g.s_nationkey AS Cluster, g.Date,
         coalesce(q.c, 0.0) AS Consumption
  FROM (SELECT s_suppkey, s_nationkey, unnest(generate_series(
          (SELECT min(l_shipdate) FROM lineitem), (SELECT max(l_shipdate) FROM lineitem),
          INTERVAL 1 DAY)) AS Date FROM supplier) g
  LEFT JOIN (SELECT l_suppkey, l_shipdate, sum(l_quantity) AS c FROM lineitem GROUP BY 1, 2) q
    ON q.l_suppkey = g.s_suppkey AND q.l_shipdate = g.Date)"""


def _event_meter(spark: SparkSession, d: str, step: int, filled: bool = True) -> DataFrame:
    events = table(spark, d, "events").select(
        F.col("user_id").alias("k"), floor_step("ts", step).alias("Date"),
        F.round(F.col("value") * 100).alias("Consumption"),
    )
    summed = events.groupBy("k", "Date").agg(F.sum("Consumption").alias("Consumption"))
    rows = summed.select(
        client_name(F.col("k")).alias("ClientID"), (F.col("k") % 5).cast("int").alias("Cluster"),
        "Date", "Consumption",
    )
    if not filled:
        return rows
    lo, hi, users = events.agg(
        F.min(_micros("Date")), F.max(_micros("Date")), F.approx_count_distinct("k")
    ).first()
    return _filled(rows, step, lo, hi, users)


def hourly_meter(spark: SparkSession, d: str) -> DataFrame:
    """Users × all hours; hundredths of event value. Cluster = last digit of the user in base 5."""
    return _event_meter(spark, d, HOUR)


def quarter_meter(spark: SparkSession, d: str) -> DataFrame:
    return _event_meter(spark, d, QUARTER)


def gappy_meter(spark: SparkSession, d: str) -> DataFrame:
    """Only the quarter hours that have events."""
    return _event_meter(spark, d, QUARTER, filled=False)


def _event_sql(name: str, minutes: int) -> str:
    bucket = f"time_bucket(INTERVAL '{minutes} minutes', ts)"
    return f"""
{name}_sums AS (
  SELECT user_id, {bucket} AS Date, sum(round(value * 100)) AS c FROM events GROUP BY 1, 2),
{name} AS (
  SELECT {CLIENT_SQL.format('g.user_id')} AS ClientID, CAST(g.user_id % 5 AS INTEGER) AS Cluster,
         g.Date, coalesce(q.c, 0.0) AS Consumption
  FROM (SELECT user_id, unnest(generate_series(
          (SELECT min(Date) FROM {name}_sums), (SELECT max(Date) FROM {name}_sums),
          INTERVAL '{minutes} minutes')) AS Date FROM (SELECT DISTINCT user_id FROM events)) g
  LEFT JOIN {name}_sums q ON q.user_id = g.user_id AND q.Date = g.Date)"""


HOURLY_SQL = _event_sql("hourly", 60)
QUARTER_SQL = _event_sql("quarter", 15)
GAPPY_SQL = f"""
gappy AS (
  SELECT {CLIENT_SQL.format('user_id')} AS ClientID, CAST(user_id % 5 AS INTEGER) AS Cluster,
         time_bucket(INTERVAL '15 minutes', ts) AS Date, sum(round(value * 100)) AS Consumption
  FROM events GROUP BY 1, 2, 3)"""


# The event types stand in for clusters (a series each) and for weather stations.
TYPE_NUMBERS = {"view": 0, "click": 1, "error": 2, "purchase": 3, "signup": 4}
STATIONS = {"view": "Lisbon", "click": "Porto", "error": "Faro", "purchase": "Evora", "signup": "Lisbon"}


def _lookup(table_: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table_.items() for x in kv])


def type_series(spark: SparkSession, d: str) -> DataFrame:
    """Event type × all hours; hundredths of event value."""
    events = table(spark, d, "events").select(
        F.element_at(_lookup(TYPE_NUMBERS), F.col("event_type")).alias("Cluster"),
        floor_hour("ts").alias("Date"), F.round(F.col("value") * 100).alias("Consumption"),
    )
    kinds = events.select("Cluster").distinct()
    grid = _grid(kinds, events, HOUR).withColumn("Consumption", F.lit(0.0))
    return grid.unionByName(events).groupBy("Cluster", "Date").agg(
        F.sum("Consumption").alias("Consumption")
    )


TYPE_CASE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in TYPE_NUMBERS.items()
) + " END"
TYPES_SQL = f"""
type_sums AS (
  SELECT CAST({TYPE_CASE} AS INTEGER) AS Cluster, date_trunc('hour', ts) AS Date,
         sum(round(value * 100)) AS c FROM events GROUP BY 1, 2),
types AS (
  SELECT g.Cluster, g.Date, coalesce(q.c, 0.0) AS Consumption
  FROM (SELECT Cluster, unnest(generate_series((SELECT min(Date) FROM type_sums),
          (SELECT max(Date) FROM type_sums), INTERVAL 1 HOUR)) AS Date
        FROM (SELECT DISTINCT Cluster FROM type_sums)) g
  LEFT JOIN type_sums q ON q.Cluster = g.Cluster AND q.Date = g.Date)"""


def station_weather(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(
        F.element_at(_lookup(STATIONS), F.col("event_type")).alias("station"),
        floor_hour("ts").alias("Date"),
    ).agg((F.avg(F.round(F.col("value") * 100)) / 100).alias("temp"))


STATION_CASE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in STATIONS.items()
) + " END"
STATIONS_SQL = f"""
stations AS (
  SELECT {STATION_CASE} AS station, date_trunc('hour', ts) AS Date,
         avg(round(value * 100)) / 100 AS temp FROM events GROUP BY 1, 2)"""
WEIGHT_CASE = "CASE station WHEN 'Lisbon' THEN 547 WHEN 'Porto' THEN 237 WHEN 'Faro' THEN 64 ELSE 56 END"
WEATHER_SQL = STATIONS_SQL + f""",
national AS (
  SELECT Date, sum(temp * {WEIGHT_CASE}) / sum(CAST({WEIGHT_CASE} AS DOUBLE)) AS temp
  FROM stations GROUP BY 1),
weather AS (
  SELECT Date, greatest(0.0, {BASE} - temp) AS HDH, greatest(0.0, temp - {BASE}) AS CDH
  FROM national)"""


def wide_meter(spark: SparkSession, d: str) -> DataFrame:
    """Days in rows, one column of pieces sold per return flag and line status."""
    line = table(spark, d, "lineitem")
    cells = [
        F.coalesce(
            F.sum(F.when((F.col("l_returnflag") == r) & (F.col("l_linestatus") == t), F.col("l_quantity"))),
            F.lit(0.0),
        ).alias(f"{r}_{t}")
        for r, t in WIDE_CELLS
    ]
    return line.groupBy(F.col("l_shipdate").alias("Date")).agg(*cells)


WIDE_CELLS = [(r, t) for r in ("A", "N", "R") for t in ("F", "O")]
WIDE_SQL = "wide AS (SELECT l_shipdate AS Date, " + ", ".join(
    f"coalesce(sum(CASE WHEN l_returnflag = '{r}' AND l_linestatus = '{t}' THEN l_quantity END), 0.0)"
    f' AS "{r}_{t}"'
    for r, t in WIDE_CELLS
) + " FROM lineitem GROUP BY 1)"


def naive_scored(spark: SparkSession, d: str) -> DataFrame:
    """Daily readings from the cut on with the value seven days before as the prediction."""
    from gridlens.operators.features import add_lags

    lagged = add_lags(daily_meter(spark, d), DAILY, {7: "Predicted_kW"}, regular=True)
    return lagged.withColumnRenamed("Consumption", "Actual_kW").filter(
        F.col("Date") >= stamp(DAILY_CUT)
    )


NAIVE_SQL = DAILY_SQL + f""",
naive AS (
  SELECT * FROM (
    SELECT ClientID, Cluster, Date, Consumption AS Actual_kW,
           lag(Consumption, 7) OVER (PARTITION BY ClientID ORDER BY Date) AS Predicted_kW
    FROM daily) WHERE Date >= TIMESTAMP '{DAILY_CUT}')"""


def hourly_features(spark: SparkSession, d: str) -> DataFrame:
    """Hourly readings with calendar, weather, lags and fixed segments: the processed table."""
    from gridlens.operators.features import add_lags_and_rolling
    from gridlens.operators.weather import join_weather, national_weather

    readings = flag_holidays(calendar_features(hourly_meter(spark, d)))
    weather = national_weather(station_weather(spark, d), base=BASE)
    built = add_lags_and_rolling(
        join_weather(readings, weather), HOURLY, HOUR_LAGS, day=24, rolling=4,
        baseline=240, baseline_least=24, regular=True,
    )
    return built.withColumn("Consumer_Category", tier_of_cluster(F.col("Cluster")))


HOUR_LAGS = {1: "Lag_1h", 24: "Lag_24h", 168: "Lag_1week"}


def tier_of_cluster(cluster: Column) -> Column:
    return F.when(cluster <= 1, "Light").when(cluster <= 3, "Medium").otherwise("Heavy")
