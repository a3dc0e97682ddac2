"""Least squares for many groups in one pass over the rows.

Every task keeps, per group, the number, means and centred products of its rows; such moments merge
exactly, two at a time, so that a large mean beside a small spread costs no digits. Each group is
then solved in its own small task. Rows are never shuffled and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.operators.joins import attach

HELD_GROUPS = 256
#: Tasks' moments of a group are merged in this many parts, then the parts.
MERGE_PARTS = 256

#: Number of rows, their means, and sums of products of distances from the means.
Part = tuple[float, np.ndarray, np.ndarray]


def _schema(df: DataFrame, groups: Sequence[str], tail: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{g}` {types[g]}" for g in groups] + [tail])


def part_of(x: np.ndarray) -> Part:
    mean = x.mean(axis=0)
    z = x - mean
    return float(len(x)), mean, z.T @ z


def merged(a: Part, b: Part) -> Part:
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def moments(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a group (groups, n, mean, products): centred moments of its complete rows."""
    groups, columns = list(groups), list(columns)
    width = len(columns)
    kinds = {f.name: f.dataType for f in df.schema}
    tail = "n double, mean array<double>, products array<double>"

    def table(found: dict[tuple, Part], schema: pa.Schema, task: int | None = None) -> pa.RecordBatch:
        rows = [
            dict(zip(groups, key)) | {"n": n, "mean": mean, "products": m.ravel()} | ({} if task is None else {"_task": task})
            for key, (n, mean, m) in found.items()
        ]
        return pa.RecordBatch.from_pylist(rows, schema)

    def shape(with_task: bool) -> pa.Schema:
        fields = [pa.field(g, _arrow(kinds[g])) for g in groups] + ([pa.field("_task", pa.int32())] if with_task else [])
        many = pa.list_(pa.float64())
        return pa.schema([*fields, pa.field("n", pa.float64()), pa.field("mean", many), pa.field("products", many)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() % MERGE_PARTS
        sums: dict[tuple, Part] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            keys = pd.DataFrame({g: batch.column(g).to_pandas() for g in groups})
            for at in keys.groupby(groups, sort=False, dropna=False).indices.values():
                key = tuple(batch.column(g)[int(at[0])].as_py() for g in groups)
                part = part_of(x[at])
                sums[key] = merged(sums[key], part) if key in sums else part
            if len(sums) > HELD_GROUPS:
                yield table(sums, shape(True), task)
                sums = {}
        yield table(sums, shape(True), task)

    def merge_all(rows: pa.Table) -> pa.Table:
        total: Part | None = None
        for n, mean, m in zip(*(rows[c].to_pylist() for c in ("n", "mean", "products"))):
            part = (n, np.array(mean), np.array(m).reshape(width, width))
            total = part if total is None else merged(total, part)
        key = tuple(rows[g][0].as_py() for g in groups)
        return pa.Table.from_batches([table({key: total}, shape(False))])

    complete = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    parts = complete.mapInArrow(add_up, _schema(df, groups, "_task int, " + tail))
    parts = parts.groupBy(*groups, "_task").applyInArrow(merge_all, _schema(df, groups, tail))
    return parts.groupBy(*groups).applyInArrow(merge_all, _schema(df, groups, tail))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def gram(df: DataFrame, groups: Sequence[str], features: Sequence[str],
         targets: Sequence[str]) -> DataFrame:
    """Moments of features and targets, in this order, per group."""
    return moments(df, groups, [*features, *targets])


def ridge_solution(xx: np.ndarray, xy: np.ndarray, n: float, size: np.ndarray,
                   penalty: np.ndarray | None, tolerance: float) -> np.ndarray:
    """Coefficients from centred products. Columns are scaled and solved with a pseudo-inverse, so
    features that repeat each other do no harm; ``size`` is each column's distance from 0."""
    spread = np.sqrt(np.clip(np.diag(xx) / n, 0.0, None))
    moves = spread > 1e-14 * np.maximum(size, 1e-300)
    unit = np.where(moves, spread, 1.0)
    a = xx / n / np.outer(unit, unit)
    a[~moves, :] = 0.0
    a[:, ~moves] = 0.0
    if penalty is not None:
        a = a + np.diag(np.where(moves, penalty / n / unit**2, 0.0))
    b = xy / n / unit[:, None]
    b[~moves, :] = 0.0
    # A ridge weight can dwarf the column it belongs to: bring the diagonal back to 1 before
    # small eigenvalues are judged.
    level = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    value, vector = np.linalg.eigh(a / np.outer(level, level))
    keep = value > tolerance * max(value.max(initial=0.0), 1e-300)
    inverse = (vector[:, keep] / value[keep]) @ vector[:, keep].T
    return (inverse @ (b / level[:, None])) / (level * unit)[:, None]


def soft_threshold(s: np.ndarray, c: np.ndarray, weights: np.ndarray, sweeps: int = 200,
                   tolerance: float = 1e-9) -> np.ndarray:
    """The δ that minimises δᵀSδ/2 − cᵀδ + Σ weights·|δ|.

    Coordinate descent finds about which ones are not 0. Features that nearly repeat each other make
    it slow to end, so from there the non-zero ones are solved for exactly, one sign change at a time,
    until no condition of a minimum is broken.
    """
    d, diagonal = np.zeros(len(c)), np.diag(s)
    live = diagonal > 1e-12 * max(diagonal.max(initial=0.0), 1e-300)
    rest = c.astype(float).copy()  # c − S·d
    for _ in range(sweeps):
        before = d.copy()
        for j in np.flatnonzero(live):
            pull = rest[j] + diagonal[j] * d[j]
            new = np.sign(pull) * max(abs(pull) - weights[j], 0.0) / diagonal[j]
            if new != d[j]:
                rest -= s[:, j] * (new - d[j])
                d[j] = new
        if np.abs(d - before).max(initial=0.0) <= 1e-14 * np.abs(d).max(initial=0.0):
            break

    def value(x):
        return x @ s @ x / 2 - c @ x + weights @ np.abs(x)

    slack = tolerance * max(np.abs(c).max(initial=0.0), 1e-300)
    sign = np.sign(d)
    for _ in range(100 * len(c)):
        on = sign != 0
        target = np.zeros(len(c))
        target[on] = np.linalg.lstsq(s[np.ix_(on, on)], c[on] - weights[on] * sign[on], rcond=1e-14)[0]
        # Go to the solution for these signs, or to the best place on the way where one turns 0.
        turns = on & (d * target < 0)
        shares = np.append(d[turns] / (d[turns] - target[turns]), 1.0)
        places = [d + x * (target - d) for x in shares]
        for place, j in zip(places, np.flatnonzero(turns)):
            place[j] = 0.0
        d = min(places, key=value)
        d[np.abs(d) <= 1e-15 * np.abs(d).max(initial=0.0)] = 0.0
        settled = bool((np.sign(d) == np.where(target != 0, np.sign(target), 0)).all())
        sign = np.sign(d)
        if settled:
            pull = c - s @ d
            broken = np.where(live & (d == 0), np.abs(pull) - weights, -np.inf)
            j = int(np.argmax(broken)) if len(broken) else 0
            if not len(broken) or broken[j] <= slack:
                return d
            sign[j] = np.sign(pull[j])
    return d


def solve(sums: DataFrame, groups: Sequence[str], n_features: int, targets: Sequence[str],
          penalty: Sequence[float] | None = None, tolerance: float = 1e-10,
          absolute: Sequence[float] | None = None) -> DataFrame:
    """Rows (groups, target, intercept, coef) from the moments of ``gram``.

    ``penalty`` holds one ridge weight per feature: weight·coef²/2 beside half the sum of squares.
    ``absolute`` holds, where not 0, a weight on |coef| instead; those features are found by
    coordinate descent after the others are solved out, so most of them are exactly 0.
    """
    groups, k = list(groups), n_features

    def coefficients(n, xx, xy, size):
        if absolute is None or not np.any(absolute):
            return ridge_solution(xx, xy, n, size, None if penalty is None else np.asarray(penalty), tolerance)
        bent = np.flatnonzero(absolute)
        plain = np.flatnonzero(np.asarray(absolute) == 0)
        weights = np.zeros(k) if penalty is None else np.asarray(penalty)
        # Of the plain features, what they explain of the targets and of the other features.
        both = np.hstack([xy[plain], xx[np.ix_(plain, bent)]])
        part = ridge_solution(xx[np.ix_(plain, plain)], both, n, size[plain], weights[plain], tolerance)
        direct, through = part[:, :xy.shape[1]], part[:, xy.shape[1]:]
        s = xx[np.ix_(bent, bent)] - xx[np.ix_(bent, plain)] @ through
        c = xy[bent] - xx[np.ix_(bent, plain)] @ direct
        coef = np.zeros((k, xy.shape[1]))
        for t in range(xy.shape[1]):
            coef[bent, t] = soft_threshold((s + s.T) / 2, c[:, t], np.asarray(absolute)[bent])
        coef[plain] = direct - through @ coef[bent]
        return coef

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean = float(pdf["n"].iloc[0]), np.asarray(pdf["mean"].iloc[0], dtype=float)
        m = np.asarray(pdf["products"].iloc[0], dtype=float).reshape(len(mean), len(mean))
        size = np.sqrt(np.diag(m)[:k] / n + mean[:k] ** 2)
        coef = coefficients(n, m[:k, :k], m[:k, k:], size)
        intercept = mean[k:] - mean[:k] @ coef
        out = pd.DataFrame(
            {
                "target": list(targets),
                "intercept": intercept,
                "coef": [coef[:, t].tolist() for t in range(len(targets))],
            }
        )
        for n_, g in enumerate(groups):
            out.insert(n_, g, pdf[g].iloc[0])
        return out

    schema = _schema(sums, groups, "target string, intercept double, coef array<double>")
    return sums.groupBy(*groups).applyInPandas(one_group, schema)


def dot(features: Sequence[str], coef: Column, intercept: Column) -> Column:
    """Weighted sum. Many terms go through arrays: written out, they outgrow the size limit of
    a generated method."""
    if len(features) <= 16:
        total = intercept
        for n, f in enumerate(features):
            total = total + F.col(f).cast("double") * coef.getItem(n)
        return total
    values = F.array(*[F.col(f).cast("double") for f in features])
    products = F.zip_with(values, coef, lambda x, c: x * c)
    return F.aggregate(products, F.lit(0.0), lambda a, p: a + p) + intercept


def predict(df: DataFrame, coefs: DataFrame, groups: Sequence[str], features: Sequence[str],
            out: str) -> DataFrame:
    """One more column from one target's coefficients; groups without a model get NULL."""
    model = coefs.select(*groups, F.col("intercept").alias("_b"), F.col("coef").alias("_c"))
    scored = attach(df, model, list(groups), "left")
    return scored.withColumn(out, dot(features, F.col("_c"), F.col("_b"))).drop("_b", "_c")
