"""Totals over the prefix trie of conversations by time-forward processing.

Every conversation is rebuilt from the first turns of a base conversation and its own later ones. A
node of the trie is a distinct sequence of first turns, known by its depth and a running hash of its
turns. The trie is cut into shards, connected parts between two depths below one node. Inside a shard
the nodes are sorted by reverse level order and each sends its subtree totals to its parent through a
priority queue that spills; then the roots of the shards send theirs, added up, to the shards above.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlens.llm.arrow import sorted_runs
from gridlens.session import cut_lineage, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation that are numbered together.
CHUNK_TURNS = 16_384
#: Shards with more nodes are cut at half their depths, as long as they have more than one level.
SHARD_NODES = 50_000
#: Messages that a priority queue holds in memory.
QUEUED = 200_000
#: Every conversation takes first turns from the one whose id is the multiple of this below it.
FAMILY = 20
MOST_TAKEN = 3
KEY = ["depth", "k1", "k2"]
OUTPUTS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def taken_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("long")


def _digested(turns: DataFrame, kept: list[str]) -> DataFrame:
    """conv, turn, digest of role and text, and words of the text: what the shuffles need of a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.unhex(F.sha2(marked.cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        *[c.alias(n) for n, c in (("role", role), ("text", text)) if n in kept],
    )


def _rebuilt(turns: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members (conv, length after rebuilding), and their turns: conv, depth from 1, digest, words.

    Turns are numbered within chunks of turn numbers, so that a very long conversation is sorted in
    parts. A turn goes to its own conversation and, if it is one of the first of a base, to those that
    take it.
    """
    rows = _digested(turns, kept).withColumn(
        "chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 62)))  # a null turn is first
    )
    chunks = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"))
    members = chunks.groupBy("conv").agg(F.sum("n").alias("n"))
    members = members.select("conv", "n", taken_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    # At most 2 * FAMILY - 1 conversations have the same base.
    families = members.groupBy("base").agg(
        F.max(F.when(F.col("conv") == F.col("base"), F.col("n"))).alias("base_n"),
        F.collect_list(F.struct("conv", "h")).alias("takers"),
    )
    members = members.join(families, "base").select(
        "conv", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("took"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"),
        F.when(F.col("conv") == F.col("base"), F.col("takers")).otherwise(F.array()).alias("takers"),
    )
    members = cut_lineage(members.withColumn("length", F.col("took") + F.col("rest")))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    context = chunks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(members, "conv")
    place = F.row_number().over(Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    placed = rows.join(context, ["conv", "chunk"]).withColumn("place", F.col("before") + place)
    none = F.array().cast("array<struct<conv:bigint,depth:bigint>>")
    own = F.when(
        F.col("place") > F.col("h"),
        F.array(F.struct("conv", (F.col("place") - F.col("h") + F.col("took")).alias("depth"))),
    )
    given = F.when(F.col("place") <= MOST_TAKEN, F.transform(
        F.filter("takers", lambda t: t["h"] >= F.col("place")),
        lambda t: F.struct(t["conv"].alias("conv"), F.col("place").alias("depth")),
    ))
    goes = F.explode(F.concat(F.coalesce(own, none), F.coalesce(given, none))).alias("to")
    rebuilt = placed.select(goes, "digest", "words", *kept).select("to.*", "digest", "words", *kept)
    return members.select("conv", "length"), rebuilt


def _top(depth: Column) -> Column:
    """The first depth of the band that a depth lies in: 0, 1 to 3, 4 to 7, 8 to 15 and so on, later even ones."""
    doubling = F.pow(F.lit(2.0), F.floor(F.log2(depth + 0.5)))
    return F.when(depth < 4, F.least(depth, F.lit(1))).when(
        depth < CHUNK_TURNS, doubling
    ).otherwise(F.floor(depth / CHUNK_TURNS) * CHUNK_TURNS).cast("long")


def _paths(rebuilt: DataFrame, members: DataFrame, kept: list[str]) -> DataFrame:
    """For each turn of each conversation its node (depth, k1, k2), the parent (p1, p2) and the node
    at the first depth of its band (s1, s2).

    The hash of a sequence is the exclusive or of the hashes of (place, turn), so it runs along a
    conversation band by band, and the parent's is had by taking one turn out again.
    """
    rows = rebuilt.select(
        "conv", "depth", _top(F.col("depth")).alias("top"), "words", *kept,
        F.xxhash64(F.lit(1), "depth", "digest").alias("g1"), F.xxhash64("digest", "depth", F.lit(2)).alias("g2"),
    )
    bands = rows.groupBy("conv", "top").agg(F.bit_xor("g1").alias("b1"), F.bit_xor("g2").alias("b2"))
    earlier = Window.partitionBy("conv").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)]
    context = bands.select("conv", "top", *before).join(members, "conv")
    band = Window.partitionBy("conv", "top").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(context, ["conv", "top"]).select(
        "conv", "depth", "top", "words", "length", *kept,
        *[F.col(f"b{i}").bitwiseXOR(F.bit_xor(f"g{i}").over(band)).alias(f"k{i}") for i in (1, 2)],
        *[F.col(f"b{i}").bitwiseXOR(F.first(f"g{i}").over(band)).alias(f"s{i}") for i in (1, 2)],
        "g1", "g2",
    )
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)]
    last = (F.col("depth") == F.col("length")).alias("last")
    return joined.select("conv", *KEY, *parents, "top", "s1", "s2", "words", last, *kept)


def _nodes(paths: DataFrame, members: DataFrame, kept: list[str]) -> DataFrame:
    """One row a node: its key, parent and shard, smallest member, members, and what it saves itself."""
    found = paths.groupBy(*KEY, "p1", "p2", "top", "s1", "s2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        *[F.max(c).alias(c) for c in kept],
    )
    zero = [F.lit(0).cast("long").alias(n) for n in (*KEY, "p1", "p2", "top", "s1", "s2")]
    root = members.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*zero, "conv", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("string").alias(c) for c in kept])
    return found.unionByName(root).withColumn("saves", (F.col("n_convs") - 1) * F.col("words")).drop("words")


def _split_shards(nodes: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """Cut shards of more than ``most`` nodes at half their depths until none is left or it has one level.

    The lower half falls apart into the shards below each node of its first level. Each round halves
    the depths, so there are few.
    """
    shard = ["top", "s1", "s2"]
    while True:
        nodes = cut_lineage(nodes)
        sizes = nodes.groupBy(*shard).agg(F.count(F.lit(1)).alias("_n"), F.max("depth").alias("_deepest"))
        hot = sizes.where((F.col("_n") > most) & (F.col("_deepest") > F.col("top")))
        if hot.isEmpty():
            return nodes
        cut = F.col("top") + F.floor((F.col("_deepest") - F.col("top") + 1) / 2)
        marked = nodes.join(hot.select(*shard, cut.alias("_cut")), shard, "left")
        lower = F.col("_cut").isNotNull() & (F.col("depth") >= F.col("_cut"))
        at = paths.select(F.col("conv"), F.col("depth").alias("_cut"), F.col("k1").alias("_s1"), F.col("k2").alias("_s2"))
        moved = marked.where(lower).join(at, ["conv", "_cut"]).withColumns(
            {"top": F.col("_cut"), "s1": F.col("_s1"), "s2": F.col("_s2")}
        )
        nodes = marked.where(~lower).select(*nodes.columns).unionByName(moved.select(*nodes.columns))


class SpillingQueue:
    """A priority queue of messages (order, k1, k2, leaves, saved), smallest first.

    Beyond ``most`` messages in memory, all of them go sorted to a file without a name in Spark's
    scratch folder of this executor, from which they are read in blocks when their turn comes. The file
    belongs to the running task alone: a task that is run again starts with an empty queue.
    """

    BLOCK = 4_096

    def __init__(self, most: int) -> None:
        self.most, self.spills = most, 0
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []

    def push(self, message: tuple[int, ...]) -> None:
        heappush(self.heap, message)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)
        np.array(self.heap, np.int64).tofile(file)
        file.seek(0)
        self.heap = []
        self.spills += 1
        run = self._read(file)
        heappush(self.runs, (next(run), self.spills, run))

    def _read(self, file) -> Iterator[tuple[int, ...]]:
        with file:
            while len(block := np.fromfile(file, np.int64, 5 * self.BLOCK)):
                yield from map(tuple, block.reshape(-1, 5).tolist())

    def take(self, key: tuple[int, int, int]) -> tuple[int, int, int]:
        """Remove all messages with this key, the smallest there is: their number, leaves and saved words."""
        n = leaves = saved = 0
        while self.heap and self.heap[0][:3] == key:
            message = heappop(self.heap)
            n, leaves, saved = n + 1, leaves + message[3], saved + message[4]
        while self.runs and self.runs[0][0][:3] == key:
            message, number, run = self.runs[0]
            n, leaves, saved = n + 1, leaves + message[3], saved + message[4]
            if (following := next(run, None)) is None:
                heappop(self.runs)
            else:
                heapreplace(self.runs, (following, number, run))
        return n, leaves, saved

    def clear(self) -> None:
        self.heap, self.runs = [], []


def time_forward(most: int):
    """A function over Arrow batches of nodes sorted by shard, deepest first: adds the totals of their subtrees.

    ``in_children``, ``in_leaves`` and ``in_saved`` are what other shards have sent to a node.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(most)
        shard = None
        for batch in batches:
            names = ["s1", "s2", "depth", "k1", "k2", "p1", "p2", "saves", "in_children", "in_leaves", "in_saved"]
            rows = zip(*(batch.column(n).to_pylist() for n in names))
            totals: list[tuple[int, int, int]] = []
            for s1, s2, depth, k1, k2, p1, p2, saves, in_children, in_leaves, in_saved in rows:
                if (s1, s2) != shard:
                    queue.clear()  # what is left is the root's message, which the plan sends on
                    shard = (s1, s2)
                n, leaves, saved = queue.take((-depth, k1, k2))
                n += in_children
                leaves = leaves + in_leaves if n else 1
                saved += in_saved + saves
                totals.append((n, leaves, saved))
                queue.push((1 - depth, p1, p2, leaves, saved))
            columns = [pa.array(c, pa.int64()) for c in zip(*totals)] if totals else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, "n_children", "n_leaves", "saved_tokens"]
            )

    return run


def _totals(nodes: DataFrame, queued: int) -> DataFrame:
    """All nodes with the totals of their subtrees, the shards of the deepest first depths first."""
    spark = nodes.sparkSession
    path = shared_dir(spark)
    nodes.write.partitionBy("top").parquet(path)
    stored = spark.read.schema(nodes.schema).parquet(path)
    levels = {r["top"]: r["deepest"] for r in nodes.groupBy("top").agg(F.max("depth").alias("deepest")).collect()}
    if not levels:
        return nodes.withColumns({n: F.lit(0).cast("long") for n in ("n_children", "n_leaves", "saved_tokens")})
    sums = {"in_children": "n", "in_leaves": "leaves", "in_saved": "saved"}
    done: list[DataFrame] = []
    sent: dict[int, DataFrame] = {}  # by the depth of the parents that messages go to
    for top in sorted(levels, reverse=True):
        part = stored.where(F.col("top") == top)
        waiting = [m for depth, m in sent.items() if top <= depth <= levels[top]]
        if waiting:
            messages = waiting[0]
            for m in waiting[1:]:
                messages = messages.unionByName(m)
            messages = messages.groupBy(*KEY).agg(*[F.sum(n).alias(name) for name, n in sums.items()])
            part = part.join(messages, KEY, "left").fillna(0, list(sums))
        else:
            part = part.withColumns({name: F.lit(0).cast("long") for name in sums})
        part = part.repartition("s1", "s2").sortWithinPartitions("s1", "s2", F.desc("depth"), "k1", "k2")
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema)
        added = "n_children bigint, n_leaves bigint, saved_tokens bigint"
        part = cut_lineage(part.mapInArrow(time_forward(queued), f"{fields}, {added}").drop(*sums))
        done.append(part)
        roots = part.where(F.col("depth") == top)
        sent[top - 1] = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _ends(paths: DataFrame, members: DataFrame) -> DataFrame:
    """For each node at which conversations end: the digest of their ids in order, taken as a stream.

    A digest is made of its ids one after the other, so the ids of one node pass through one task, in
    batches, whatever their number.
    """
    zero = [F.lit(0).cast("long").alias(n) for n in KEY]
    ended = paths.where("last").select(*KEY, "conv").unionByName(members.where("length = 0").select(*zero, "conv"))
    ordered = ended.repartition(*KEY).sortWithinPartitions(*KEY, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, found = sha256(), None, []
        for new, rows in sorted_runs(batches, KEY):
            if new != key:
                if key is not None:
                    found.append((*key, state.hexdigest()))
                state, key = sha256(), new
            else:
                state.update(b",")
            state.update(",".join(map(str, rows.column("conv").to_pylist())).encode())
            if len(found) >= 10_000:
                yield _ended(found)
                found = []
        if key is not None:
            found.append((*key, state.hexdigest()))
        yield _ended(found)

    return ordered.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _ended(found: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "ends_sha256"])


def conversation_trie(
    turns: DataFrame, keep_text: bool = False, shard_nodes: int = SHARD_NODES, queued: int = QUEUED
) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Turns are ordered by turn,
    null first, those of one turn number by a hash of role and text; a null role or text counts as
    empty. Turns of a null conv_id belong to no conversation. A conversation c starts with the first
    crc32(c) % 4 turns of the one numbered c - c % 20 (fewer if that has fewer, none if there is none)
    and goes on with its own turns behind its first crc32(c) % 4. The root, depth 0, is there unless
    there is no conversation at all; no rows give no rows.

    Returns OUTPUTS, with ``keep_text`` also role and text of the node's last turn (null for the root).
    ``saved_tokens`` adds up, over the subtree, (members - 1) times the words of the node's last text.
    Nodes are told apart by their depth and two 64-bit hashes of their turns.
    """
    kept = ["role", "text"] if keep_text else []
    members, rebuilt = _rebuilt(turns, kept)
    paths = cut_lineage(_paths(rebuilt, members, kept))
    nodes = _split_shards(_nodes(paths, members, kept), paths, shard_nodes)
    totals = _totals(nodes, queued)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    # Every conversation is below the root: its smallest id is looked up, not joined.
    first = nodes.where("depth = 0").select("conv").first()
    deeper = totals.where("depth > 1").join(parents.where("depth > 1"), ["depth", "p1", "p2"])
    upper = totals.where("depth <= 1").withColumn(
        "parent", F.when(F.col("depth") == 1, F.lit(first and first["conv"]).cast("long"))
    )
    whole = upper.unionByName(deeper).join(_ends(paths, members), KEY, "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"), *kept,
    )


#: The same rows over the table ``conversations`` as one query: sequences are lists of turn digests.
SQL = """
WITH turns AS (
  SELECT conv_id AS conv, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS seq FROM turns GROUP BY conv
),
bits AS (
  SELECT *, flatten(list_transform(range(length(conv::VARCHAR)),
    lambda i: list_transform(range(8), lambda j: (ascii(substr(conv::VARCHAR, (i + 1)::BIGINT, 1)) >> j::INT) & 1))) AS bits
  FROM own
),
taken AS (
  SELECT conv, seq, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bits, lambda b: b::BIGINT)),
    lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 4 AS h
  FROM bits
),
rebuilt AS (
  SELECT t.conv, list_concat(coalesce(b.seq, [])[1:t.h], t.seq[t.h + 1:]) AS seq
  FROM taken t LEFT JOIN own b ON b.conv = t.conv - t.conv % 20
),
members AS (
  SELECT conv, len(seq) AS n, unnest(range(len(seq) + 1)) AS depth, list_transform(seq, lambda x: x.d) AS path,
         list_transform(seq, lambda x: x.w) AS words
  FROM rebuilt
),
nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * coalesce(max(words[depth]), 0) AS saves, bool_and(n = depth) AS leaf,
         sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth
),
above AS (
  SELECT node[1:up] AS top, up, depth, saves, leaf
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM nodes)
),
sums AS (
  SELECT top, up, count(*) FILTER (depth = up + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves,
         sum(saves)::BIGINT AS saved_tokens
  FROM above GROUP BY top, up
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n
JOIN sums s ON s.top = n.node AND s.up = n.depth
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""
