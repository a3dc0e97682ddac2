"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a stream of its documents in a shuffled order, cut into blocks of equally many
words. A golden-ratio sequence on a power-of-two lattice gives each slot of the mix a point in
[0, 1); the cumulative shares of the sources turn the point into a source. The slots of a source
are ranked, and the rank names the block, starting over after the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlens.llm.common import clear_of, groups_for, join_same, small_or_shuffled, text_of, words
from gridlens.session import cut_lineage

#: Points are multiples of 2**-31; the odd step is the golden ratio's fraction of 2**31.
LATTICE = 2**31
STEP = 1_327_217_885
#: Cells of the unit interval that slots and sources are matched by.
CELLS = 2**16
#: Slots in a chunk that is ranked on its own.
CHUNK = 2**15
OUTPUTS = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], share_percent: int, most: int) -> DataFrame:
    """Per source: sid, source_size, target.

    Sources in code point order, null last, get ``weights`` in turn. ``share_percent`` of all
    sizes is dealt out by weight; nothing gets more than ``most`` times its size, and what is
    over goes to the others by weight. With sources ordered by cap over weight, one is capped
    as long as its cap is no more than its share of what the ones before it left.
    """
    # One row a source from here on.
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    sources = (
        sized.groupBy("source").agg(F.sum("words").alias("source_size"))
        .withColumn("sid", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("weight", F.element_at(F.lit(list(weights)), F.col("sid") % len(weights) + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * most)
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    shared = (
        sources.withColumn("pool", F.sum("source_size").over(everything) * share_percent / 100)
        .withColumn("left", F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(after))
        .withColumn("capped", F.col("cap") * F.col("rest_weight") <= F.col("weight") * F.col("left"))
    )
    first_open = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "sid", "left", "rest_weight"))).over(everything)
    return shared.withColumn("open", first_open).select(
        "source", "sid", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("open.left") / F.col("open.rest_weight"))
        .alias("target"),
    )


def block_plan(targets: DataFrame, block: int) -> DataFrame:
    """Per source with something to take: blocks in its stream and slots it is due."""
    whole = F.floor("target")
    due = targets.withColumn("goal", whole).where("goal > 0")
    return due.withColumns({
        "n_blocks": F.ceil(F.col("source_size") / block),
        "slots": F.floor(F.col("goal") / F.col("source_size")) * F.ceil(F.col("source_size") / block)
        + F.ceil(F.col("goal") % F.col("source_size") / block),
    })


def schedule(spark, plan: DataFrame, block: int) -> DataFrame:
    """One row a slot of the mix: slot, sid, rank, block_no and how many of its words to take.

    A source whose points ran ahead of its share stops at the slots it is due; one that is a few
    slots short gets them at the end, so the totals are exact.
    """
    ordered = Window.orderBy("sid")  # one row a source
    bounded = plan.withColumns({
        "upto": F.sum("slots").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("slots").over(Window.partitionBy()),
    }).withColumns({
        "low": F.floor((F.col("upto") - F.col("slots")) / F.col("total") * LATTICE),
        "high": F.floor(F.col("upto") / F.col("total") * LATTICE),
    })
    n_slots = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    width = LATTICE // CELLS
    cells = bounded.where("high > low").select(
        "sid", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"),
    )
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % LATTICE) * STEP % LATTICE).alias("point")
    ).withColumn("cell", F.floor(F.col("point") / width))
    hits = (
        points.join(small_or_shuffled(cells), "cell")
        .where("point >= low and point < high")
        .select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    per_chunk = hits.groupBy("sid", "chunk").count().withColumn(
        "ahead",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    ranked = hits.withColumn(
        "here", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))
    ).join(per_chunk.select("sid", "chunk", "ahead"), ["sid", "chunk"]).select(
        "slot", "sid", (F.col("ahead") + F.col("here") - 1).alias("rank")
    )
    found = per_chunk.groupBy("sid").agg(F.sum("count").alias("found"))
    short = (
        plan.join(found, "sid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
        .where("found < slots")
        .select("sid", F.explode(F.sequence("found", F.col("slots") - 1)).alias("rank"))
        .select((F.lit(n_slots) + F.col("rank")).alias("slot"), "sid", "rank")
    )
    columns = plan.select("sid", "source_size", "n_blocks", "slots", "goal")
    start = F.col("block_no") * block
    covered = F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + start
    return (
        ranked.unionByName(short).join(small_or_shuffled(columns), "sid").where("rank < slots")
        .withColumn("block_no", F.col("rank") % F.col("n_blocks"))
        .withColumn("use", F.least(F.lit(block), F.col("source_size") - start, F.col("goal") - covered))
        .select("slot", "sid", "rank", "block_no", "use")
    )


def streams(sized: DataFrame, targets: DataFrame, n_groups: int, seed: int) -> DataFrame:
    """Each document with the offset of its first word in the shuffled stream of its source."""
    key = F.xxhash64(F.lit(seed), "doc_id", "crc")
    placed = (
        join_same(sized, small_or_shuffled(targets.select("source", "sid")), ["source"])
        .withColumn("key", key).withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(n_groups)))
    )
    sums = placed.groupBy("sid", "bucket").agg(F.sum("words").alias("in_bucket")).withColumn(
        "ahead",
        F.coalesce(
            F.sum("in_bucket").over(
                Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "crc", "size")
    running = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    return (
        placed.withColumn("inside", running)
        .join(sums.select("sid", "bucket", "ahead"), ["sid", "bucket"])
        .withColumn("offset", F.col("ahead") + F.col("inside"))
        .select("doc_id", "source", "crc", "size", "copies", "words", "sid", "offset")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share_percent: int = 150,
    most: int = 2,
    block: int = 128,
    seed: int = 23,
) -> DataFrame:
    """All columns and rows of ``docs`` with size, source_size, target and taken.

    ``size`` counts words; ``taken`` is how many words of the document the mix uses, repeats
    counted, at most ``most`` times its size. The taken words of a source add up to its target,
    rounded down. The same rows give the same result.

    * A null text or one without words has size 0 and is never taken; a null source is a
      source of its own, after all others.
    * Rows that agree in id, source and text share one place in the stream and get equal parts of
      what is taken there, rounded down.
    * No rows give no rows. Columns of ``docs`` named like an output are replaced.
    """
    spark = docs.sparkSession
    key = ["doc_id", "source", "crc", "size"]
    base = clear_of(docs, [*OUTPUTS, "crc", "words", "copies"])
    rows = base.withColumns({"size": word_count(text_of()), "crc": F.crc32(text_of().cast("binary"))})
    sized = cut_lineage(
        rows.groupBy(*key).agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    )
    targets = cut_lineage(source_targets(sized, weights, share_percent, most))
    plan = block_plan(targets, block)
    slots = schedule(spark, plan, block)
    stream = streams(sized, targets, groups_for(sized.count()), seed)
    parts = stream.where("words > 0").select(
        *key, "sid", "offset", "words",
        F.explode(F.sequence(F.floor(F.col("offset") / block),
                             F.floor((F.col("offset") + F.col("words") - 1) / block))).alias("block_no"),
    )
    overlap = F.least(F.col("offset") + F.col("words"), F.col("block_no") * block + F.col("use")) - F.greatest(
        F.col("offset"), F.col("block_no") * block
    )
    used = (
        parts.join(slots.select("sid", "block_no", "use"), ["sid", "block_no"])
        .groupBy(*key).agg(F.sum(F.greatest(overlap, F.lit(0))).alias("used"))
    )
    shares = join_same(sized, used, key, "left").withColumn(
        "taken", F.floor(F.coalesce("used", F.lit(0)) / F.col("copies"))
    )
    shares = join_same(shares, small_or_shuffled(targets.drop("sid")), ["source"])
    return join_same(rows, shares.select(*key, "source_size", "target", "taken"), key).select(*base.columns, *OUTPUTS)
