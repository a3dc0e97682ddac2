"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlens.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for all nodes of ``edges`` (long a, b).

    In each round every node points to its smallest neighbour, pointers are followed twice, and
    edges are redrawn between the nodes pointed to. Rounds end when no edge is left between
    different nodes; dense and star-like groups need one or two, long chains a number that
    grows with the logarithm of their length. Each round is a written table.
    """
    edges = cut_lineage(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("to")
        )
        points = cut_lineage(points)
        onward = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
        points = cut_lineage(
            points.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        )
        labels = points if labels is None else labels.alias("l").join(
            points.alias("p"), F.col("l.to") == F.col("p.node"), "left"
        ).select("l.node", F.coalesce("p.to", "l.to").alias("to"))
        labels = cut_lineage(labels)
        left = points.withColumnsRenamed({"node": "a", "to": "ra"})
        right = points.withColumnsRenamed({"node": "b", "to": "rb"})
        edges = cut_lineage(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.withColumnRenamed("to", "component")
