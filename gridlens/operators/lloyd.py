"""k-means for many numbers of clusters and many starts at once.

All fits go over the rows together: a scan of the rows adds up, for every centre of every fit that
still moves, the rows nearest to it. So the number of scans is that of the slowest fit, not the sum
over fits. Starting centres are drawn by squared distance, one more for all fits in each scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.session import cut_lineage

MAX_ROUNDS = 100
#: Rows whose distances to all centres are held at a time.
ROWS_AT_ONCE = 4_096


@dataclass
class Fit:
    """Centres, the sum of squared distances to them, and the rounds it took."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    rounds: int = 0
    moving: bool = True


def _values(batch: pa.RecordBatch, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows without a missing value, and which those are."""
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols])
    whole = ~np.isnan(x).any(axis=1)
    return x[whole], whole


def _points(batch: pa.RecordBatch, cols: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    x, whole = _values(batch, cols)
    marks = batch.column("_mark").to_numpy(zero_copy_only=False).astype(np.uint64)[whole]
    for at in range(0, len(x), ROWS_AT_ONCE):
        yield x[at:at + ROWS_AT_ONCE], marks[at:at + ROWS_AT_ONCE]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, never below 0."""
    d = (x**2).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres**2).sum(axis=1)
    return np.maximum(d, 0.0)


def _uniform(marks: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row that depends on its mark and the seed alone."""
    with np.errstate(over="ignore"):
        z = marks + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z.astype(float) + 0.5) / 2.0**64


def _draw(rows: DataFrame, cols: Sequence[str], fits: list[Fit], step: int) -> dict[int, np.ndarray]:
    """One more centre for each fit: a row drawn with a chance in proportion to its squared distance
    to the centres that the fit has (any row, for the first). The row with the smallest exponential
    waiting time is such a draw, whatever the split into tasks."""
    tasks = [(i, f.seed, f.centres.copy()) for i, f in enumerate(fits) if f.k > len(f.centres)]

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for x, marks in _points(batch, cols):
                for i, seed, centres in tasks:
                    weight = _distances(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        wait = -np.log(_uniform(marks, 1_000 * seed + step)) / weight
                    j = int(np.argmin(wait)) if len(wait) else -1
                    if j >= 0 and wait[j] < np.inf and (i not in best or wait[j] < best[i][0]):
                        best[i] = (float(wait[j]), x[j])
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(list(best), pa.int32()),
            "wait": pa.array([w for w, _ in best.values()], pa.float64()),
            "x": pa.array([v.tolist() for _, v in best.values()], pa.list_(pa.float64())),
        })

    found = rows.mapInArrow(race, "i int, wait double, x array<double>").groupBy("i").agg(
        F.min_by("x", "wait").alias("x")
    )
    return {r["i"]: np.array(r["x"]) for r in found.collect()}


def _round(rows: DataFrame, cols: Sequence[str], fits: list[Fit]) -> None:
    """Move every centre of the given fits to the mean of its rows; a fit whose centres stay is done."""
    offsets = np.cumsum([0, *(len(f.centres) for f in fits)])
    centres, width = np.vstack([f.centres for f in fits]), len(cols)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), width + 2))  # sums, rows, cost
        for batch in batches:
            for x, _ in _points(batch, cols):
                d = _distances(x, centres)
                ones = np.hstack([x, np.ones((len(x), 1))])
                for a, b in zip(offsets, offsets[1:]):
                    own = d[:, a:b].argmin(axis=1)
                    near = np.zeros((len(x), b - a))
                    near[np.arange(len(x)), own] = 1.0
                    total[a:b, :-1] += near.T @ ones
                    total[a:b, -1] += near.T @ d[np.arange(len(x)), a + own]
        seen = np.flatnonzero(total[:, -2])
        yield pa.RecordBatch.from_pydict(
            {"c": pa.array(seen, pa.int32())} | {f"s{n}": pa.array(total[seen, n]) for n in range(width + 2)}
        )

    schema = "c int, " + ", ".join(f"s{n} double" for n in range(width + 2))
    sums = rows.mapInArrow(add_up, schema).groupBy("c").agg(*[F.sum(f"s{n}").alias(f"s{n}") for n in range(width + 2)])
    # One row a centre: their number is that of the fits, not of the rows.
    total = np.zeros((len(centres), width + 2))
    for r in sums.collect():
        total[r["c"]] = r[1:]
    for f, a, b in zip(fits, offsets, offsets[1:]):
        part = total[a:b]
        moved = np.where(part[:, -2:-1] > 0, part[:, :-2] / np.maximum(part[:, -2:-1], 1), f.centres)
        cost = float(part[:, -1].sum())
        f.rounds += 1
        f.moving = f.rounds < MAX_ROUNDS and cost < f.cost * (1 - 1e-12) and not np.allclose(moved, f.centres, rtol=0, atol=1e-12)
        f.cost = cost
        if f.moving:
            f.centres = moved


def fit_all(rows: DataFrame, cols: Sequence[str], tasks: Sequence[tuple[int, int]], mark: str) -> list[Fit]:
    """Fit each (k, seed). ``mark`` names a column that tells rows apart; rows with a NULL are left out.

    The rows are written once and scanned max(k) times for the starts and then once a round. Fewer
    distinct rows than k give fewer centres; no rows give none.
    """
    ready = rows.select(F.xxhash64(mark).alias("_mark"), *[F.col(c).cast("double").alias(c) for c in cols])
    ready = cut_lineage(ready)
    fits = [Fit(k, seed, np.empty((0, len(cols)))) for k, seed in tasks]
    for step in range(max((f.k for f in fits), default=0)):
        for i, x in _draw(ready, cols, fits, step).items():
            fits[i].centres = np.vstack([fits[i].centres, x])
    for f in fits:
        f.moving = len(f.centres) > 0
    while moving := [f for f in fits if f.moving]:
        _round(ready, cols, moving)
    return fits


def nearest(df: DataFrame, cols: Sequence[str], centres: np.ndarray, labels: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the label (``Cluster``) of each row's nearest centre, the first of equals; rows with
    a NULL are left out."""
    known, types = np.array(labels), dict(df.dtypes)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, whole = _values(batch, cols)
            own = known[_distances(x, centres).argmin(axis=1)] if len(x) else known[:0]
            kept = [batch.column(c).filter(pa.array(whole)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.int32())], names=[*keep, "Cluster"])

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["Cluster int"])
    ready = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return ready.mapInArrow(label, schema)
