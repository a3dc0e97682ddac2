"""Near copies among embeddings by product quantisation.

A coarse quantiser deals the unit vectors to inverted lists; what is left after taking out the
list's centre is coded in subspaces. Lists are compared where the border between their cells
allows a pair at the threshold, so no pair is missed. There, table look-ups give the inner
product with each coded member, and what the code lost bounds the error, so no pair that reaches
the threshold is dropped by the codes. The rest is compared by the exact cosine in double precision.

The bound: unit vectors of cosine t lie sqrt(2 - 2t) apart. Each is at least as far from the other
as the two distances to the plane half way between the centres of their lists add up to.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlens.llm.arrow import list_array, lists, sorted_groups
from gridlens.llm.common import clear_of
from gridlens.llm.components import components
from gridlens.session import cut_lineage

#: Vectors that centres and codes are learned from, in the order of a hash.
SAMPLE_ROWS = 20_000
LISTS_PER_VECTOR = 1 / 256
MOST_LISTS = 4_096
SUBSPACES = 8
CODES = 64
#: Lists meet in blocks of about a fifth of all vectors, at most so many.
BLOCK = 16_384
#: Room for rounding in the bounds.
SLACK = 1e-9
OUTPUTS = ["n_links", "component_id", "kept"]


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres by Lloyd's rounds, from rows drawn at random; an empty centre stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first; equal distances by number."""
    out = []
    for start in range(0, len(x), 4_096):
        d = (centres**2).sum(1) - 2 * x[start:start + 4_096] @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


@dataclass
class Index:
    """Centres of the lists and the code words of each subspace."""

    centres: np.ndarray
    words: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, n_lists: int) -> Index:
        centres = k_means(sample, n_lists)
        centres = centres[np.argsort(nearest(centres, k_means(centres, math.isqrt(len(centres))), 1)[:, 0], kind="stable")]
        rest = sample - centres[nearest(sample, centres, 1)[:, 0]]
        return cls(centres, [k_means(part, CODES) for part in np.array_split(rest, min(SUBSPACES, rest.shape[1]), axis=1)])

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.words), axis=1)

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they lose."""
        rest = x - self.centres[home]
        codes = [nearest(part, words, 1)[:, 0] for part, words in zip(self.split(rest), self.words)]
        lost = rest - np.concatenate([w[c] for w, c in zip(self.words, codes)], axis=1)
        return np.stack(codes, axis=1), np.sqrt((lost**2).sum(1))

    def gaps(self, in_list: int) -> np.ndarray:
        """Distances of all centres from one."""
        return np.sqrt(((self.centres - self.centres[in_list]) ** 2).sum(1))

    def beyond(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """For rows and lists by how much the squared distance to the list's centre exceeds that to the own one.

        Over twice the distance of the centres, this is the distance from the plane half way between them.
        """
        d = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return d - d[np.arange(len(x)), home][:, None]

    def products(self, queries: np.ndarray, in_list: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded members of one list, from a table for each subspace."""
        total = np.repeat((queries @ self.centres[in_list])[:, None], len(codes), axis=1)
        for part, words, code in zip(self.split(queries), self.words, codes.T):
            total += (part @ words.T)[:, code]
        return total


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length, also where squares over- or underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and fp: a digest of the vector's numbers, null where it cannot link, with the vector."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    arrow = pa.float32() if kind == "float" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, kept = [], [], []
            for v in batch.column("embedding"):
                x = np.array(v.as_py() or [], dtype=object)
                x = None if any(e is None for e in x) else x.astype(np.float64)
                good = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
                x = x + 0.0 if good else np.empty(0)
                fps.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)
                           if good else None)
                sizes.append(len(x))
                kept.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), list_array(kept, arrow)],
                names=["vec_id", "fp", "dim", "vector"],
            )

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
        run, f"vec_id long, fp long, dim int, vector array<{kind}>"
    )


def units(column: pa.ChunkedArray) -> np.ndarray:
    return unit(np.stack(lists(column)).astype(np.float64))


def _indexed(classes: DataFrame, index: Index) -> DataFrame:
    """``classes`` with their list, code and what the code lost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(pa.chunked_array([batch.column("vector")]))
            home = nearest(x, index.centres, 1)[:, 0]
            codes, lost = index.code(x, home)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), batch.column("copies"), pa.array(home.astype(np.int32)),
                 pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(lost), batch.column("vector")],
                names=["fp", "copies", "home", "codes", "lost", "vector"],
            )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("fp", "copies", "vector").mapInArrow(
        run, f"fp long, copies long, home int, codes binary, lost double, vector {kind}"
    )


def blocks_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first block and its number of blocks: lists that follow each other share
    a block of ``most`` vectors, and a larger list has blocks of its own."""
    first, count, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for i, size in enumerate(sizes):
        if size > most:
            count[i] = -(-size // most)
            first[i] = at + 1
            at, room = at + count[i], 0
            continue
        if at < 0 or size > room:
            at, room = at + 1, most
        first[i] = at
        room -= size
    return first, count


def _dealt(coded: DataFrame, index: Index, sizes: np.ndarray, most: int, apart: float) -> DataFrame:
    """``coded`` for each pair (i, j) of blocks in which a row may have a partner."""
    first, count = blocks_of(sizes, most)
    n_blocks = int((first + count).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                batch = whole.slice(start, 1_024)
                home = batch.column("home").to_numpy()
                own = first[home] + (batch.column("fp").to_numpy().view(np.uint64) % count[home].astype(np.uint64)).astype(np.int64)
                x = units(pa.chunked_array([batch.column("vector")]))
                beyond = index.beyond(x, home)
                may = np.zeros((len(home), n_blocks), bool)
                for a in np.unique(home):
                    rows = np.flatnonzero(home == a)
                    row, to = np.nonzero(beyond[rows] <= 2 * apart * index.gaps(a) + SLACK)
                    for k in range(int(count[to].max())):
                        some = count[to] > k
                        may[rows[row[some]], first[to[some]] + k] = True
                row, other = np.nonzero(may)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(own[row], other).astype(np.int32)), pa.array(np.maximum(own[row], other).astype(np.int32)),
                     pa.array(own[row].astype(np.int32)), *taken.columns],
                    names=["i", "j", "block", *batch.schema.names],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"i int, j int, block int, {fields}")


def _close(x: np.ndarray, codes: np.ndarray, lost: np.ndarray, index: Index, in_list: int, q: np.ndarray, m: np.ndarray,
           threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows q and members m of a list with a cosine of ``threshold`` or more."""
    found = [(q[:0], m[:0])]
    for start in range(0, len(q) if len(m) else 0, 1_024):
        some = q[start:start + 1_024]
        i, j = np.nonzero(index.products(x[some], in_list, codes[m]) + lost[m] >= threshold - SLACK)
        i, j = some[i], m[j]
        exact = np.empty(len(i))
        for at in range(0, len(i), 65_536):
            exact[at:at + 65_536] = np.einsum("ij,ij->i", x[i[at:at + 65_536]], x[j[at:at + 65_536]])
        found.append((i[exact >= threshold], j[exact >= threshold]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _met(x: np.ndarray, home: np.ndarray, block: np.ndarray, codes: np.ndarray, lost: np.ndarray, index: Index,
         threshold: float, apart: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows, each pair once, from one block or between two."""
    low, high = block == block.min(), block == block.max()
    beyond = index.beyond(x, home)
    for a in np.unique(home[low]):
        gaps = index.gaps(a)
        left = np.flatnonzero(low & (home == a))
        for b in np.unique(home[high]):
            if b < a and (low == high).all():
                continue
            right = np.flatnonzero(high & (home == b))
            if a == b:
                i, j = _close(x, codes, lost, index, b, left, right, threshold)
                # Within one block both orders of a pair and the row itself are found.
                once = i < j if block[left[0]] == block[right[0]] else slice(None)
                yield i[once], j[once]
                continue
            half = apart * gaps[b] + SLACK
            s, t = beyond[left, b], beyond[right, a]
            near = s <= half
            if near.any():
                yield _close(x, codes, lost, index, b, left[near], right[t <= 2 * half - s[near].min()], threshold)
            if (t <= half).any():
                far = left[~near & (s <= 2 * half - t.min())]
                yield _close(x, codes, lost, index, b, far, right[t <= half], threshold)


def _compared(met: DataFrame, index: Index, threshold: float, apart: float) -> DataFrame:
    """(fp, root, links) of vectors with links, for each pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["i", "j"]):
            block = group.column("block").to_numpy()
            if group.column("i")[0].as_py() != group.column("j")[0].as_py() and block.min() == block.max():
                continue
            fp, copies = group.column("fp").to_numpy(), group.column("copies").to_numpy()
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint8).reshape(len(fp), -1)
            pairs = list(_met(units(group.column("vector")), group.column("home").to_numpy(), block, codes,
                              group.column("lost").to_numpy(), index, threshold, apart))
            if not any(len(a) for a, _ in pairs):
                continue
            a, b = (np.concatenate(part) for part in zip(*pairs))
            links = np.zeros(len(fp), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            # Labels by the order of fp, so that a root is the smallest fp of its part.
            order = np.argsort(fp, kind="stable")
            at = np.empty(len(fp), np.int64)
            at[order] = np.arange(len(fp))
            a, b = at[a], at[b]
            label = np.arange(len(fp))
            while True:
                new = label.copy()
                np.minimum.at(new, a, label[b])
                np.minimum.at(new, b, label[a])
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            some = np.unique(np.concatenate([a, b]))
            names = fp[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some]), pa.array(names[label[some]]), pa.array(links[order[some]])], names=["fp", "root", "links"]
            )

    return (
        met.repartition("i", "j").sortWithinPartitions("i", "j")
        .mapInArrow(run, "fp long, root long, links long")
    )


def link_embeddings(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    Two vectors link when the cosine is ``threshold`` or more. Rows with the same numbers are one
    class, so copies are never paired. No pair is missed: two lists are compared unless the border
    between their cells shows that they hold none.

    * Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing;
      so do those of another length than the commonest one (of equally common ones the longest).
    * Rows that repeat a vec_id are vectors of their own; a null vec_id links, but is never the
      smallest of its component.
    * Extra columns are not looked at; no rows give no rows.

    The index is fitted to at most SAMPLE_ROWS vectors and holds at most MOST_LISTS centres.
    """
    base = clear_of(vectors, ["fp", "dim", "vector"])
    rows = cut_lineage(_usable(base))
    common = rows.where("fp is not null").groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    digests = rows.select("vec_id", F.when(F.col("dim") == F.lit(common["dim"] if common else -1), F.col("fp")).alias("fp"))
    if common is None:
        return digests.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                              F.lit(True).alias("kept"))
    classes = cut_lineage(
        rows.where(F.col("fp").isNotNull() & (F.col("dim") == common["dim"])).groupBy("fp")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    )
    sample = classes.orderBy(F.xxhash64("fp"), "fp").select("vector").limit(SAMPLE_ROWS).collect()
    n_lists = int(min(MOST_LISTS, max(1, classes.count() * LISTS_PER_VECTOR)))
    index = Index.fit(unit(np.array([r["vector"] for r in sample], np.float64)), n_lists)

    # The rounding of a cosine that is taken for the threshold is a part of the distance.
    apart = math.sqrt(max(0.0, 2 - 2 * threshold) + 1e-12)
    coded = cut_lineage(_indexed(classes, index))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in coded.groupBy("home").count().collect():  # one row a list, MOST_LISTS at most
        sizes[r["home"]] = r["count"]
    most = int(min(BLOCK, sizes.sum() // 5 + 1))
    found = cut_lineage(_compared(_dealt(coded, index, sizes, most, apart), index, threshold, apart))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    by_class = cut_lineage(
        classes.select("fp", "copies", "first_id")
        .join(roots.withColumnsRenamed({"node": "fp", "component": "root"}), "fp", "left").join(links, "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    smallest = by_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = by_class.join(smallest, "root").select("fp", "n_links", "component_id")
    return digests.join(by_class, "fp", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
