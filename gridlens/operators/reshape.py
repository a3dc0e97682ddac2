"""Wide to long, long to wide, dummies, and repeated patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALENDAR_COLUMNS = ("Date", "Weekday", "Hour", "Month", "Is_Weekend", "Is_Holiday")

# The levels of each dummy-coded column.
LEVELS: dict[str, list] = {
    "Hour": list(range(1, 25)),
    "Weekday": list(range(1, 8)),
    "Month": list(range(1, 13)),
    "Consumer_Category": ["Heavy", "Light", "Medium"],
}


def melt_clients(df: DataFrame, fixed: Sequence[str] = CALENDAR_COLUMNS) -> DataFrame:
    """One row per client and stamp."""
    ids = [c for c in fixed if c in df.columns]
    values = [c for c in df.columns if c not in ids]
    return df.unpivot(ids, values, "ClientID", "Consumption")


def hourly_profile_matrix(df: DataFrame, client: str = "ClientID", hour: str = "Hour",
                          value: str = "Consumption") -> DataFrame:
    """Mean use per client and hour, one column ``h1`` … ``h24`` each, 0 where none is known."""
    means = [
        F.coalesce(F.avg(F.when(F.col(hour) == h, F.col(value))), F.lit(0.0)).alias(f"h{h}")
        for h in range(1, 25)
    ]
    return df.groupBy(client).agg(*means)


def dummy_names(levels: dict[str, list], drop_first: bool = True) -> list[str]:
    return [f"{c}_{v}" for c, vs in levels.items() for v in (vs[1:] if drop_first else vs)]


def one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = True,
            keep: bool = False) -> DataFrame:
    """0/1 columns over fixed levels, so train and serving always agree on the columns."""
    dummies = {
        f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1).otherwise(0)
        for c, vs in levels.items()
        for v in (vs[1:] if drop_first else vs)
    }
    wide = df.withColumns(dummies)
    return wide if keep else wide.drop(*levels)


def align_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = (),
                   levels: dict[str, list] | None = None) -> DataFrame:
    """Exactly the expected columns in order, as doubles, 0 where the input has none.

    Raw lags are scaled when the input carries the client's ``mean`` and ``std``.
    """
    levels = {c: v for c, v in (levels or LEVELS).items() if c in df.columns}
    wide = one_hot(df, levels)
    out = []
    for name in expected:
        raw = name.removesuffix("_Scaled")
        if name in wide.columns:
            col = F.col(name).cast("double")
        elif raw != name and raw in wide.columns and "std" in wide.columns:
            col = (F.col(raw) - F.col("mean")) / F.col("std")
        else:
            col = F.lit(0.0)
        out.append(col.alias(name))
    return wide.select(*keep, *out)


def union_splits(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def repeat_and_tile(df: DataFrame, horizon: int, repeat: int = 4, period: int = 24,
                    place: str = "step") -> DataFrame:
    """Repeat each pattern row ``repeat`` times and tile the pattern up to ``horizon`` steps.

    Each row generates its own target steps, so nothing is joined.
    """
    length = period * repeat
    tiles = -(-horizon // length)
    target = F.col("_tile") * length + F.col(place) * repeat + F.col("_rep")
    return (
        df.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
        .withColumn(place, target)
        .drop("_tile", "_rep")
        .filter(F.col(place) < horizon)
    )
