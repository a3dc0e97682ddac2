"""Client groups by the shape of their day and by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators import lloyd
from gridlens.operators.ranks import running_totals
from gridlens.session import cut_lineage

HOURS = [f"h{h}" for h in range(1, 25)]

# Names of the five day shapes; a lookup the caller may replace.
CLUSTER_NAMES = {
    0: "Standard Daytime Business",
    1: "Standard Residential",
    2: "Extended Commercial / Mixed-Use",
    3: "Split-Shift / Siesta Profile",
    4: "Night-Shift Industrial",
}


def row_minmax(profiles: DataFrame, cols: list[str] = HOURS) -> DataFrame:
    """Each client's values on a 0–1 scale of its own; a flat client becomes all 0."""
    # Own columns for range and minimum: written inline they would be repeated per hour.
    ranged = profiles.withColumn("_low", F.least(*cols)).withColumn("_high", F.greatest(*cols))
    span = F.col("_high") - F.col("_low")
    return ranged.withColumns(
        {c: F.when(span > 0, (F.col(c) - F.col("_low")) / span).otherwise(F.lit(0.0)) for c in cols}
    ).drop("_low", "_high")


def stable_order(centers: list[list[float]]) -> list[int]:
    """New label of each centre: by the hour of its peak, then by its mean, then by its values."""
    rank = sorted(
        range(len(centers)),
        key=lambda i: (
            max(range(len(centers[i])), key=lambda h: (centers[i][h], -h)),
            sum(centers[i]) / len(centers[i]),
            list(centers[i]),
        ),
    )
    return [rank.index(i) for i in range(len(centers))]


def profile_clusters(scaled: DataFrame, k: int = 5, seed: int = 42, starts: int = 10,
                     client: str = "ClientID") -> DataFrame:
    """k-means on day shapes, best of several starts: one row (client, Cluster).

    Labels follow the centres' shape, so they do not hang on the order of rows or starts.
    """
    fits = lloyd.fit_all(scaled, HOURS, [(k, seed + i) for i in range(starts)], client)
    best = min(fits, key=lambda f: f.cost)
    label = stable_order(best.centres.tolist())
    return lloyd.nearest(scaled, HOURS, best.centres, label, [client])


def elbow_curve(scaled: DataFrame, k_max: int = 10, seed: int = 42, starts: int = 10,
                client: str = "ClientID") -> DataFrame:
    """Cost of the best of several fits for each k, all fitted in the same scans of the profiles."""
    tasks = [(k, seed + i) for k in range(1, k_max + 1) for i in range(starts if k > 1 else 1)]
    best: dict[int, float] = {}
    for f in lloyd.fit_all(scaled, HOURS, tasks, client):
        if len(f.centres):
            best[f.k] = min(f.cost, best.get(f.k, f.cost))
    return scaled.sparkSession.createDataFrame(sorted(best.items()), "k int, inertia double")


def cluster_shapes(scaled: DataFrame, clusters: DataFrame, client: str = "ClientID") -> DataFrame:
    """Mean scaled value per cluster and hour, with the cluster's size."""
    sized = scaled.join(clusters, client).groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in HOURS]
    )
    long = sized.unpivot(["Cluster", "size"], HOURS, "h", "mean_scaled")
    return long.select(
        "Cluster", F.substring("h", 2, 2).cast("int").alias("Hour"), "size", "mean_scaled"
    )


def log_mean(means: DataFrame, value: str = "mean") -> DataFrame:
    return means.withColumn("log_mean", F.log1p(value))


def _sse(weight: Column, total: Column, squares: Column) -> Column:
    return F.when(weight > 0, squares - total * total / weight).otherwise(F.lit(0.0))


def jenks_breaks(values: DataFrame, value: str, fan_out: int = 32,
                 bucket_rows: int = 200_000) -> DataFrame:
    """Exact natural breaks into three classes: one row (low, break_1, break_2, high).

    Equal values are counted once with a weight. For a fixed second break j, the best first
    break never moves left as j moves right, so the search goes level by level: each open range
    of j is cut at a few points, and a point only tries the first breaks that its neighbours
    leave open. A level holds about ``fan_out`` rows per distinct value, far from the square of
    their number, and is plain joins and grouped minima.
    """
    distinct = values.filter(F.col(value).isNotNull()).groupBy(value).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    # Shift to the mean before squaring: the sums keep their digits.
    centre = distinct.agg(F.sum(F.col(value) * F.col("w")) / F.sum("w")).scalar()
    shifted = distinct.select(
        F.col(value).alias("v"), "w", F.lit(1.0).alias("one"),
        ((F.col(value) - centre) * F.col("w")).alias("s"),
        ((F.col(value) - centre) * (F.col(value) - centre) * F.col("w")).alias("q"),
    )
    sums = cut_lineage(
        running_totals(shifted, "v", ["one", "w", "s", "q"], (), bucket_rows).select(
            F.col("_cum_one").cast("long").alias("n"), "v",
            F.col("_cum_w").alias("W"), F.col("_cum_s").alias("S"), F.col("_cum_q").alias("Q"),
        )
    )
    spark = values.sparkSession
    size, low, high = sums.agg(F.max("n"), F.min("v"), F.max("v")).first()
    if not size or size < 3:
        raise ValueError("three classes need at least three distinct values")
    whole = sums.filter(F.col("n") == size).select(
        F.struct(*[F.col(c).alias(c) for c in ("W", "S", "Q")])
    ).scalar()

    # Break i means: class 1 holds values 1…i, class 2 values i+1…j, class 3 the rest.
    open_ranges = spark.createDataFrame([(2, size - 1, 1, size - 2)], "j0 long, j1 long, i0 long, i1 long")
    found = None
    while True:
        ranges = open_ranges.filter(F.col("j0") <= F.col("j1"))
        if ranges.isEmpty():
            break
        span = F.col("j1") - F.col("j0") + 1
        cuts = F.least(F.lit(fan_out), span)
        points = ranges.withColumn(
            "j", F.explode(F.array_distinct(F.transform(
                F.sequence(F.lit(1), F.lit(fan_out)),
                lambda c: F.col("j0") + F.floor((F.least(c.cast("long"), cuts) - 0.5) * span / cuts),
            )))
        )
        # First breaks to try, generated in two steps so that no row holds one long list.
        last_i = F.least(F.col("i1"), F.col("j") - 1)
        tries = points.withColumn(
            "i_from", F.explode(F.sequence(F.col("i0"), last_i, F.lit(4096).cast("long")))
        ).repartition("j", "i_from").withColumn(
            "i", F.explode(F.sequence(F.col("i_from"), F.least(F.col("i_from") + 4095, last_i)))
        )
        at_i = sums.select(*[F.col(c).alias(a) for c, a in zip(("n", "W", "S", "Q"), ("i", "Wi", "Si", "Qi"))])
        at_j = sums.select(*[F.col(c).alias(a) for c, a in zip(("n", "W", "S", "Q"), ("j", "Wj", "Sj", "Qj"))])
        first = _sse(F.col("Wi"), F.col("Si"), F.col("Qi"))
        second = _sse(F.col("Wj") - F.col("Wi"), F.col("Sj") - F.col("Si"), F.col("Qj") - F.col("Qi"))
        third = _sse(whole["W"] - F.col("Wj"), whole["S"] - F.col("Sj"), whole["Q"] - F.col("Qj"))
        best = (
            tries.join(at_i, "i").join(at_j, "j")
            .withColumn("sse", first + second + third)
            .groupBy("j0", "j1", "i0", "i1", "j")
            .agg(F.min_by(F.struct("i", "sse"), F.struct("sse", "i")).alias("b"))
            .select("j0", "j1", "i0", "i1", "j", "b.i", "b.sse")
        )
        level = cut_lineage(best)
        here = level.agg(F.min(F.struct("sse", "j", "i"))).first()[0]
        found = here if found is None or here < found else found
        side = Window.partitionBy("j0", "j1").orderBy("j")
        left = level.select(
            (F.coalesce(F.lag("j").over(side), F.col("j0") - 1) + 1).alias("a0"),
            (F.col("j") - 1).alias("a1"),
            F.coalesce(F.lag("i").over(side), F.col("i0")).alias("c0"),
            F.col("i").alias("c1"),
        )
        right = level.groupBy("j0", "j1", "i1").agg(
            F.max("j").alias("j"), F.max_by("i", "j").alias("i")
        ).select((F.col("j") + 1).alias("a0"), F.col("j1").alias("a1"), F.col("i").alias("c0"), F.col("i1").alias("c1"))
        open_ranges = left.union(right).toDF("j0", "j1", "i0", "i1")

    _, j, i = found
    names = {i: "break_1", j: "break_2"}
    picked = sums.filter(F.col("n").isin([i, j])).groupBy().agg(
        *[F.max(F.when(F.col("n") == at, F.col("v"))).alias(name) for at, name in names.items()]
    )
    return picked.select(
        F.lit(float(low)).alias("low"), "break_1", "break_2", F.lit(float(high)).alias("high")
    )


def volume_tier(value: Column, break_1: Column, break_2: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value <= break_1, "Light")
        .when(value <= break_2, "Medium")
        .otherwise("Heavy")
    )


def volume_segments(means: DataFrame, breaks: DataFrame) -> DataFrame:
    """Tier of every client from its ``log_mean``; the one row of breaks is a scalar subquery."""
    row = breaks.select(F.struct("break_1", "break_2")).scalar()
    return means.withColumn(
        "Consumer_Category",
        volume_tier(F.col("log_mean"), row.getField("break_1"), row.getField("break_2")),
    )


def tier_histogram(tiers: DataFrame, bins: int = 60) -> DataFrame:
    """Clients per tier and bin of ``log_mean``, each tier over its own range, and its share."""
    per_tier = tiers.groupBy("Consumer_Category").agg(
        F.min("log_mean").alias("lo"), F.max("log_mean").alias("hi"),
        F.count(F.lit(1)).alias("tier_clients"),
    )
    share = F.col("tier_clients") / F.sum("tier_clients").over(Window.partitionBy(F.lit(0)))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("log_mean") - F.col("lo")) / width), F.lit(bins - 1))
    )
    # Three tiers: the second table has three rows.
    return (
        tiers.join(F.broadcast(per_tier.withColumn("tier_percent", share * 100)), "Consumer_Category")
        .withColumn("bin", place.cast("int"))
        .groupBy("Consumer_Category", "bin", "tier_percent")
        .agg(F.count(F.lit(1)).alias("clients"))
    )
