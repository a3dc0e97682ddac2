"""Uniform shuffle of documents into shards of exact size.

Rows are dealt to partitions by a hash. A communication matrix says how many rows of each
partition go to each shard; it is drawn from the law that a uniform shuffle of all rows would
give (multivariate hypergeometric). Each partition then puts its rows in a random order and hands
out the first so many to shard 0, the next to shard 1 and so on; each shard puts what it got in
a random order again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from gridlens.llm.common import clear_of, groups_for, text_of

OUTPUTS = ["size", "text_crc32", "shard", "slot"]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement, are good.

    Exact inversion over twelve standard deviations to either side of the mean, for
    populations of any size.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    spread = 12 * np.sqrt(mean * (bad / total) * (total - draws) / max(1, total - 1)) + 12
    first, last = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    x = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - x) * (draws - x)) - np.log((x + 1) * (bad - draws + x + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    odds = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(odds, rng.random() * odds[-1], side="right"))


def communication_matrix(counts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition (``counts``) to each shard (``shards`` holds their sizes)."""
    rng = np.random.default_rng(seed)
    room, matrix = list(shards), []
    for count in counts:
        left, rest, row = count, sum(room), []
        for j, space in enumerate(room):
            rest -= space
            k = hypergeometric(rng, space, rest, left)
            row.append(k)
            left -= k
            room[j] -= k
        matrix.append(row)
    return matrix


def shuffle_to_shards(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """All columns and rows of ``docs`` with size, text_crc32, shard and slot.

    ``size`` is the UTF-8 length of the text plus 16, ``text_crc32`` its checksum; a null text
    counts as empty. Shard sizes differ by one row at most, ``slot`` counts from 0 without
    gaps in each shard. The same rows give the same result, whatever their order or files.

    * Null, repeated or missing ids are allowed: rows are told apart by id and text, and rows
      that agree in both can trade places.
    * Fewer rows than shards leave the last shards empty; no rows give no rows.
    * Columns of ``docs`` named like an output are replaced.

    The matrix has at most 4,096 rows of ``n_shards`` numbers. Window groups hold about 2,000
    rows up to 8 million rows, a 4,096th of all rows beyond.
    """
    spark = docs.sparkSession
    text = text_of()
    base = clear_of(docs, [*OUTPUTS, "_part", "_ends", "_rank", "_sub", "_before"])
    rows = base.withColumns({
        "size": (F.octet_length(text) + 16).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
    })

    def order(step: int) -> list:
        return [F.xxhash64(F.lit(seed + step), "doc_id", "text_crc32"), F.col("doc_id"), F.col("text_crc32")]

    total = docs.count()
    n_parts = groups_for(total)
    rows = rows.withColumn("_part", F.pmod(order(0)[0], F.lit(n_parts)).cast("int"))
    counts = dict.fromkeys(range(n_parts), 0) | dict(map(tuple, rows.groupBy("_part").count().collect()))
    shards = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts[i] for i in range(n_parts)], shards, seed)
    ends = spark.createDataFrame(
        [(i, np.cumsum(row).tolist()) for i, row in enumerate(matrix)], "_part int, _ends array<long>"
    )

    local = Window.partitionBy("_part").orderBy(*order(1))
    dealt = (
        rows.withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(ends), "_part")  # at most 4,096 rows of n_shards numbers
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    )

    n_sub = max(1, -(-n_parts // n_shards))
    dealt = dealt.withColumn("_sub", F.pmod(order(2)[0], F.lit(n_sub)).cast("int"))
    before = dealt.groupBy("shard", "_sub").count().withColumn(
        "_before",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    again = Window.partitionBy("shard", "_sub").orderBy(*order(3))
    return (
        dealt.withColumn("_rank", F.row_number().over(again))
        .join(F.broadcast(before.drop("count")), ["shard", "_sub"])  # as bounded as the matrix
        .withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .select(*base.columns, *OUTPUTS)
    )
