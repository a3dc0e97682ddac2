"""Products of all pairs of places in windows of several channels, from lagged sums and edges.

The product of place i of channel c with place j of channel d, added up over windows that start at
a, a + 1, …, b − 1, is the same as that of places i − 1 and j − 1 but for the first and the window
behind the last. So a block of rows only adds up products at each lag from the windows' first place,
and a stretch of windows sends its first window and the one behind its last; everything else is
running sums along diagonals, made once a series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import series as S
from gridlens.operators.series import Series
from gridlens.session import cut_lineage

BLOCK_ROWS = 2_048
#: Windows before the held-out rows, windows within them, and those that hold rows of both.
PARTS = ("train", "held", "mixed")


def window_sums(df: DataFrame, s: Series, channels: Sequence[str], length: int,
                held: str | None = None, regular: bool = True) -> DataFrame:
    """Rows (keys, part, idx, v, sign, edge) from which ``window_products`` makes all products.

    A window is ``length`` rows in a row without a gap or NULL. ``held`` names a boolean column that
    is true from some row of a series on. A block's work is one product of small matrices a lag.
    """
    keys, channels = s.key_list, list(channels)
    flag = F.col(held) if held else F.lit(False)
    spread = S.blocks(
        df, s, behind=1, ahead=length, regular=regular, block_rows=max(BLOCK_ROWS, length)
    ).select(*keys, "_block", "_pos", "_core", flag.alias("_held"),
             *[F.col(c).cast("double").alias(f"_x{n}") for n, c in enumerate(channels)])
    names = [f"_x{n}" for n in range(len(channels))]
    types = dict(df.dtypes)
    schema = ", ".join(
        [f"`{k}` {types[k]}" for k in keys]
        + ["part string, idx int, v double, sign int, edge array<double>"]
    )

    def block_sums(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        x = np.column_stack([rows[c].to_numpy().astype(float) for c in names])
        pos, own = rows["_pos"].to_numpy(), rows["_core"].to_numpy()
        late = rows["_held"].to_numpy()
        part = _window_parts(x, pos, late, length)
        ones = np.hstack([x, np.ones((len(x), 1))])
        width = ones.shape[1]
        sums: dict[int, np.ndarray] = {}
        edges: list[tuple[int, int, np.ndarray]] = []
        first, last = np.flatnonzero(own)[[0, -1]] if own.any() else (0, -1)
        a = first
        while a <= last:
            b = a + 1
            while b <= last and part[b] == part[a] and pos[b] == pos[b - 1] + 1:
                b += 1
            if part[a] >= 0:
                m = sums.setdefault(part[a], np.zeros((length, width, width)))
                for k in range(length):
                    m[k] += ones[a:b].T @ ones[a + k:b + k]
                if a == 0 or part[a - 1] != part[a] or pos[a - 1] != pos[a] - 1:
                    edges.append((part[a], -1, x[a:a + length - 1].T))
                if b >= len(part) or part[b] != part[a] or pos[b] != pos[b - 1] + 1:
                    edges.append((part[a], 1, x[b:b + length - 1].T))
            a = b
        n_sums = sum(m.size for m in sums.values())
        ends = np.append(np.zeros(n_sums + 1, np.int32), np.cumsum([w.size for *_, w in edges], dtype=np.int32))
        values = np.concatenate([np.empty(0), *(w.ravel() for *_, w in edges)])
        none = np.arange(n_sums + len(edges)) < n_sums
        columns = {
            "part": pa.array(
                [PARTS[p] for p, m in sums.items() for _ in range(m.size)] + [PARTS[p] for p, *_ in edges], pa.string()
            ),
            "idx": pa.array(
                np.concatenate([np.empty(0), *(np.arange(m.size) for m in sums.values()), np.zeros(len(edges))]).astype(np.int32),
                mask=~none,
            ),
            "v": pa.array(np.concatenate([np.empty(0), *(m.ravel() for m in sums.values()), np.zeros(len(edges))]), mask=~none),
            "sign": pa.array(np.array([0] * n_sums + [sign for _, sign, _ in edges], np.int32), mask=none),
            "edge": pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(none)),
        }
        of_series = {k: pa.repeat(rows[k][0], len(none)) for k in keys}
        return pa.table(of_series | columns)

    return spread.groupBy(*keys, "_block").applyInArrow(block_sums, schema)


def _window_parts(x: np.ndarray, pos: np.ndarray, late: np.ndarray, length: int) -> np.ndarray:
    """For each row the place in PARTS of the window that starts there; −1 where there is none."""
    part = np.full(len(x), -1)
    n = len(x) - length + 1
    if n > 0:
        missing = np.append(0, np.cumsum(np.isnan(x).any(axis=1)))
        whole = (missing[length:] == missing[:n]) & (pos[length - 1:] - pos[:n] == length - 1)
        kind = np.where(late[:n], 1, np.where(late[length - 1:], 2, 0))
        part[:n] = np.where(whole, kind, -1)
    return part


def add_up(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lagged sums added up over the blocks of a series; edges as they are. The blocks' work is written
    once, since both are read from it."""
    sums = cut_lineage(sums)
    lagged = sums.filter("idx IS NOT NULL").groupBy(*keys, "part", "idx").agg(F.sum("v").alias("v"))
    edges = sums.filter("sign IS NOT NULL").select(*keys, "part", "sign", "edge")
    return lagged.unionByName(edges, allowMissingColumns=True)


def window_products(pdf: pd.DataFrame, channels: int, length: int) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """For each part of one series: the number of windows, the sums of all places (channel, place),
    and of all products of places (channel, place, channel, place)."""
    out = {}
    width = channels + 1
    for part, rows in pdf.groupby("part"):
        lagged, edges = rows[rows["idx"].notna()], rows[rows["sign"].notna()]
        m = np.zeros(length * width * width)
        m[lagged["idx"].to_numpy(dtype=int)] = lagged["v"].to_numpy(dtype=float)
        m = m.reshape(length, width, width)
        n, totals = m[0, -1, -1], m[:, -1, :channels].T
        moves = np.zeros((channels * (length - 1), channels * (length - 1)))
        for sign, edge in zip(edges["sign"], edges["edge"]):
            w = np.asarray(edge, dtype=float)
            moves += int(sign) * np.outer(w, w)
        moves = moves.reshape(channels, length - 1, channels, length - 1)
        g = np.empty((channels, length, channels, length))
        g[:, 0] = m[:, :channels, :channels].transpose(1, 2, 0)
        g[:, :, :, 0] = m[:, :channels, :channels].transpose(2, 0, 1)
        for i in range(1, length):
            g[:, i, :, 1:] = g[:, i - 1, :, :-1] + moves[:, i - 1]
        out[str(part)] = (float(n), totals, g)
    return out


def products_table(sums: DataFrame, keys: Sequence[str], channels: Sequence[str], length: int) -> DataFrame:
    """Rows (keys, part, channel_i, place_i, channel_j, place_j, windows, total) of every product."""
    keys, names, types = list(keys), np.array(list(channels), dtype=object), dict(sums.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [
        "part string, channel_i string, place_i int, channel_j string, place_j int, windows bigint, total double"
    ])

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, (n, _, g) in window_products(pdf, len(names), length).items():
            ci, i, cj, j = (a.ravel() for a in np.indices(g.shape))
            out.append(pd.DataFrame({
                "part": part, "channel_i": names[ci], "place_i": i.astype("int32"), "channel_j": names[cj],
                "place_j": j.astype("int32"), "windows": int(n), "total": g.ravel(),
            }))
        whole = pd.concat(out)
        for n, k in enumerate(keys):
            whole.insert(n, k, pdf[k].iloc[0])
        return whole

    return sums.groupBy(*keys).applyInPandas(table, schema)


@dataclass
class Moments:
    """Sums over windows: their number, of inputs and targets, and of their products."""

    n: float
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        mine, its = vars(self), vars(other)
        return Moments(**{k: mine[k] + its[k] for k in mine})

    def about(self, mx: np.ndarray, my: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of products of distances from these values."""
        xx = self.xx - np.outer(self.sx, mx) - np.outer(mx, self.sx) + self.n * np.outer(mx, mx)
        xy = self.xy - np.outer(self.sx, my) - np.outer(mx, self.sy) + self.n * np.outer(mx, my)
        return xx, xy, self.yy - 2 * my * self.sy + self.n * my**2


def centred_moments(n: float, totals: np.ndarray, g: np.ndarray, seq: int) -> Moments:
    """Inputs are the first ``seq`` places of all channels, targets the later ones of the first; each
    channel is taken from its own mean over the window's inputs, a target from the first channel's."""
    x, level = totals[:, :seq], totals[:, :seq].mean(axis=1, keepdims=True)
    xx = g[:, :seq, :, :seq]
    xx = xx - xx.mean(axis=1, keepdims=True)
    xx = xx - xx.mean(axis=3, keepdims=True)
    to_first = g[:, :seq, 0]
    xy = to_first[:, :, seq:] - to_first[:, :, :seq].mean(axis=2, keepdims=True)
    xy = xy - xy.mean(axis=1, keepdims=True)
    first = g[0, :, 0]
    later = np.diagonal(first)[seq:]
    yy = later - 2 * first[:seq, seq:].mean(axis=0) + first[:seq, :seq].mean()
    size = x.size
    return Moments(
        n, (x - level).reshape(size), totals[0, seq:] - level[0], xx.reshape(size, size),
        xy.reshape(size, -1), yy,
    )
