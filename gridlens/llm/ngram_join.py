"""Join of documents by the Jaccard similarity of their shingle sets, exact.

Two sets can only reach the threshold if they share a token in their prefixes, the first so many
tokens under an order that is the same for all sets. This holds for every order, so a pair has to
share a prefix token under each of several: by rarity and then by three different hash orders.
Rare tokens come first, so passages that many documents share fall outside the prefixes.

Rarity is counted for the tokens in a fixed part of the hash range, and those come before all
others in every order. Only they, and what is missing to a full prefix, are ever shuffled.

The more documents there are, the more of them share some prefix token by chance, until chains of
such tokens hold most of them together. So the sets that share a token are linked only where sizes
and sketches leave the threshold open, and whole sets meet only inside the groups left then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridlens.llm.arrow import list_array, lists, sorted_groups
from gridlens.llm.common import clear_of, join_same, small_or_shuffled
from gridlens.llm.components import components
from gridlens.llm.shingles import fingerprint, shingle_sets
from gridlens.session import cut_lineage

#: Part of the hash range whose tokens are counted.
COUNTED = 0.3
#: Counts are told apart up to this; commoner tokens rank equal.
COMMON = 64
#: Sketches that meet at once are two blocks of about so many, made of so many tokens, at most.
SKETCHES = 4_096
SKETCH_TOKENS = 32_000_000
#: Rows of a result that are sent together.
ROWS = 10_000
#: Documents that meet at once are two blocks of about so many documents and tokens at most.
BLOCK = 1_024
BLOCK_TOKENS = 1_000_000
_EDGE = int(-(2**63) + COUNTED * 2**64)
OUTPUTS = ["n_shingles", "n_links", "component_id"]


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which two sets of ``n`` and more that reach ``percent`` share at least one."""
    return n - -(-percent * n // 100) + 1


def sketch(tokens: np.ndarray) -> bytes:
    """One bit a place, of a power of two of places: whether an odd number of tokens falls there."""
    places = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount(tokens & (places - 1), minlength=places) & 1, bitorder="little").tobytes()


def _digest(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, fp, how many tokens the document sends (low ones, and in all) and the set's sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, low, sent, sketches = [], [], [], [], []
            for tokens in shingle_sets(batch.column("text")):
                n.append(len(tokens))
                fp.append(fingerprint(tokens) if len(tokens) else None)
                low.append(int(np.searchsorted(tokens, _EDGE)))
                sent.append(max(low[-1], prefix_length(len(tokens), percent)) if len(tokens) else 0)
                sketches.append(sketch(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(low, pa.int32()),
                 pa.array(sent, pa.int32()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n", "fp", "low", "sent", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, fp long, low int, sent int, sketch binary"
    )


def _tokens(docs: DataFrame, percent: int) -> DataFrame:
    """(token, fp) for the tokens that each different set sends; a task sends a set once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # one number for each text of this task
        for batch in batches:
            token, owner = [], []
            for tokens in shingle_sets(batch.column("text")):
                if not len(tokens) or (fp := fingerprint(tokens)) in done:
                    continue
                done.add(fp)
                sent = max(int(np.searchsorted(tokens, _EDGE)), prefix_length(len(tokens), percent))
                token.append(tokens[:sent])
                owner.append(np.full(sent, fp, np.int64))
            if token:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token)), pa.array(np.concatenate(owner))], names=["token", "fp"]
                )

    return docs.select("text").mapInArrow(run, "token long, fp long")


def _shared(tokens: DataFrame) -> DataFrame:
    """(fp, token, df) for tokens of two sets or more; df counts sets, up to COMMON.

    Rows of a token come sorted; a group is held until it is complete or has COMMON sets,
    from where its rows pass through.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        passing = None  # a token known to be common

        def result(t: np.ndarray, f: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(t), pa.array(df.astype(np.int32))],
                                              names=["fp", "token", "df"])

        def done(t: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.empty(0, np.int64)
            size = np.diff(np.append(starts, len(t)))
            df = np.repeat(np.minimum(size, COMMON), size)
            if passing is not None:
                df[t == passing] = COMMON
            keep = df > 1
            return result(t[keep], f[keep], df[keep])

        last = None
        for batch in batches:
            t = batch.column("token").to_numpy()
            f = batch.column("fp").to_numpy()
            if not len(t):
                continue
            new = np.append(last != (t[0], f[0]), (t[1:] != t[:-1]) | (f[1:] != f[:-1]))
            last = (t[-1], f[-1])
            t, f = np.concatenate([held_t, t[new]]), np.concatenate([held_f, f[new]])
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1]))
            yield done(t[:cut], f[:cut])
            held_t, held_f = t[cut:], f[cut:]
            if passing != held_t[0]:
                passing = None
            if len(held_t) >= COMMON or passing is not None:
                passing = held_t[0]
                yield done(held_t, held_f)
                held_t, held_f = held_t[:0], held_f[:0]
        if len(held_t):
            yield done(held_t, held_f)

    return (
        tokens.repartition("token").sortWithinPartitions("token", "fp")
        .mapInArrow(run, "fp long, token long, df int")
    )


def _scramble(tokens: np.ndarray) -> np.ndarray:
    x = tokens.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _prefixes(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(fp, n, first, second, third): shared tokens in the prefix under three orders, where there are any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"fp": [], "n": [], "first": [], "second": [], "third": []}
            items = batch.column("items")
            values, bounds = items.values, items.offsets.to_numpy()
            all_df = values.field("df").to_numpy()
            all_token = values.field("token").to_numpy()
            rows = zip(*(batch.column(c).to_pylist() for c in ("fp", "n", "low", "sent")), bounds[:-1], bounds[1:])
            for fp, n, low, sent, a, b in rows:
                df, token = all_df[a:b], all_token[a:b]
                want = prefix_length(n, percent)
                if low < want:
                    orders = [token] * 3
                else:
                    inside = token < _EDGE
                    df, token = df[inside], token[inside]
                    room = want - (low - len(token))
                    if room <= 0 or not len(token):
                        continue
                    orders = [token[np.lexsort((k, df))[:room]] for k in (token, ~token, _scramble(token))]
                out["fp"].append(fp)
                out["n"].append(n)
                for name, order in zip(("first", "second", "third"), orders):
                    out[name].append(order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["fp"], pa.int64()), pa.array(out["n"], pa.int64()),
                 *(list_array(out[k], pa.int64()) for k in ("first", "second", "third"))],
                names=list(out),
            )

    gathered = shared.groupBy("fp").agg(F.collect_list(F.struct("df", "token")).alias("items"))  # one set's own tokens
    return gathered.join(classes.select("fp", "n", "low", "sent"), "fp").mapInArrow(
        run, "fp long, n long, first array<long>, second array<long>, third array<long>"
    )


class Sketches:
    """Sketches of sets that come by size, held against each other at the smaller one's width."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.width = np.array([len(s) // 8 for s in sketches])
        self.level: dict[int, tuple[int, np.ndarray]] = {}  # of a width, and of twice that folded to it
        for w in np.unique(self.width).tolist():
            a, b, c = np.searchsorted(self.width, [w, w + 1, 2 * w + 1])
            own, double = (np.frombuffer(b"".join(sketches[x:y]), np.uint64) for x, y in ((a, b), (b, c)))
            double = double.reshape(-1, 2 * w)
            self.level[w] = int(a), np.concatenate([own.reshape(-1, w), double[:, :w] ^ double[:, w:]])

    def apart(self, one: int, others: np.ndarray) -> np.ndarray:
        """In how many places ``others`` (rising) differ from ``one``, which is never more than in tokens.

        Zero for those more than twice as wide, or less than half.
        """
        w = int(self.width[one])
        out = np.zeros(len(others), np.int64)
        start, words = self.level[w]
        for wide, end in ((w // 2, start), (w, start + len(words))):
            if wide in self.level:
                first, words = self.level[wide]
                a, b = np.searchsorted(others, [first, end])
                if a < b:
                    out[a:b] = np.bitwise_count(words[others[a:b] - first] ^ words[one - first]).sum(axis=1)
        return out


def open_groups(n: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """For each of the sets, which come by size, the first of its group.

    Groups hold together by pairs of sets of which sizes and sketches do not rule out ``percent``.
    Sets with so much in common differ in (100 - percent) / (100 + percent) of their tokens at most.
    """
    held = Sketches(sketches)
    first = np.arange(len(n))
    left = np.arange(len(n))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        top = reached[0]
        while reached and len(left):
            one = reached.pop()
            size = n[left]
            fits = np.flatnonzero((100 * size >= percent * n[one]) & (percent * size <= 100 * n[one]))
            if not len(fits):
                continue
            near = (100 + percent) * held.apart(one, left[fits]) <= (100 - percent) * (n[one] + size[fits])
            found = left[fits[near]]
            first[found] = top
            reached.extend(found.tolist())
            left = np.delete(left, fits[near])
    return first


def _open_links(prefixes: DataFrame, digests: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of sets that may reach ``percent``, so that all such pairs are connected.

    Sets that share a token meet with their sketches, where several tokens have the same sets only
    once. Many sets meet two blocks at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, rows = [], [], 0
        for group in sorted_groups(batches, ["hub", "mark", "i", "j"]):
            if group.num_rows < 2:
                continue
            n = group.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            sketches = group.column("sketch").to_pylist()
            first = open_groups(n[order], [sketches[k] for k in order], percent)
            fp = group.column("fp").to_numpy()[order]
            linked = np.flatnonzero(first != np.arange(len(first)))
            a.append(fp[linked])
            b.append(fp[first[linked]])
            rows += len(linked)
            if rows >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])
                a, b, rows = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    on = prefixes.select("fp", "n", F.explode("first").alias("token"))
    holders = Window.partitionBy("token")
    groups = cut_lineage(
        on.select(
            F.min("fp").over(holders).alias("hub"), F.bit_xor(F.xxhash64("fp")).over(holders).alias("mark"),
            F.count("*").over(holders).alias("size"), F.sum("n").over(holders).alias("all_n"), "fp",
        ).where("size > 1")
        .withColumn("n_blocks", F.ceil(F.greatest(F.col("size") / SKETCHES, F.col("all_n") / SKETCH_TOKENS)).cast("int"))
        .select("hub", "mark", "n_blocks", "fp").distinct()
    )
    sketches = digests.join(groups.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    block = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    return (
        groups.join(sketches, "fp").select("*", block, other)
        .select("hub", "mark", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "n", "sketch")
        .repartition("hub", "mark", "i", "j").sortWithinPartitions("hub", "mark", "i", "j")
        .mapInArrow(run, "a long, b long")
    )


def common_counts(sets: list[np.ndarray], at_once: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    group = np.cumsum(np.append(0, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    size = np.bincount(group) if len(group) else np.empty(0, np.int64)
    keep = size[group] > 1
    owner = owner[keep]
    _, group = np.unique(group[keep], return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(group[-1]) + 1 if len(group) else 0, at_once):
        a, b = np.searchsorted(group, [low, low + at_once])
        part = np.zeros((len(sets), int(group[b - 1]) - low + 1), np.float32)
        part[owner[a:b], group[a:b] - low] = 1
        total += part @ part.T
    return total


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row that it reaches."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verified(met: DataFrame, percent: int) -> DataFrame:
    """(fp, root, links) for each document of each pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cluster", "i", "j"]):
            if group.num_rows < 2:
                continue
            fp = group.column("fp").to_numpy()
            n = group.column("n").to_numpy()
            weight = group.column("copies").to_numpy()
            block = group.column("block").to_numpy()
            pairs = ~np.eye(len(fp), dtype=bool)
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                pairs &= block[:, None] != block[None, :]
            pairs &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
            for order in ("first", "second", "third"):
                if pairs.any():
                    pairs &= common_counts(lists(group.column(order))) > 0
            some = np.flatnonzero(pairs.any(axis=1))
            if not len(some):
                continue
            tokens = lists(group.column("tokens"))
            both = common_counts([tokens[i] for i in some]).astype(np.int64)
            n, fp = n[some], fp[some]
            union = n[:, None] + n - both
            linked = pairs[np.ix_(some, some)] & (100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp), pa.array(fp[smallest_reachable(linked)]), pa.array(linked @ weight[some])],
                names=["fp", "root", "links"],
            )

    return (
        met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(run, "fp long, root long, links long")
    )


def _sets_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(s) for s in sets], pa.int64()), list_array(sets, pa.int64())], names=["fp", "tokens"]
            )

    return docs.select("text").mapInArrow(run, "fp long, tokens array<long>")


def join_by_ngrams(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_links and component_id for every row of ``docs`` (long doc_id, text).

    Two documents link when 100 * common shingles >= ``percent`` * shingles of either. Equal sets
    are one class, so copies are never paired; ``n_links`` counts the linked documents, copies
    included. ``component_id`` is the smallest doc_id reachable by links.

    * A null text, or one without words, has no shingles and links with nothing; a text with one to
      four words has one shingle.
    * Rows that repeat a doc_id are documents of their own; if they link, that id is their
      component's. A null doc_id takes part, with null as the component of a document alone.
    * Extra columns are not looked at; no rows give no rows.

    Sets are compared by 64-bit hashes of their shingles, classes and the sets that share a token
    by 64-bit digests.
    """
    digests = cut_lineage(_digest(docs, percent))
    classes = digests.where("fp is not null").groupBy("fp").agg(
        F.first("n").alias("n"), F.first("low").alias("low"), F.first("sent").alias("sent"),
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"),
    )
    prefixes = cut_lineage(_prefixes(_shared(_tokens(docs, percent)), classes, percent))

    clusters = components(_open_links(prefixes, digests, percent))
    clusters = clusters.withColumnsRenamed({"node": "fp", "component": "cluster"})

    sizes = clusters.join(prefixes.select("fp", "n"), "fp").groupBy("cluster").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("n_blocks")
    )
    block = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
    members = cut_lineage(
        clusters.join(sizes, "cluster").withColumn("block", block)
        .join(prefixes, "fp").join(classes.select("fp", "copies", "first_id"), "fp")
    )
    ids = members.select(F.col("first_id").alias("doc_id")).distinct()
    candidates = join_same(docs.select("doc_id", "text"), small_or_shuffled(ids, 1_000_000), ["doc_id"], "left_semi")
    sets = _sets_of(candidates).dropDuplicates(["fp"])
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    met = (
        members.join(sets, "fp").select("*", other)
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("cluster", "i", "j", "block", "fp", "n", "copies", "first", "second", "third", "tokens")
    )
    found = cut_lineage(_verified(met, percent))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    roots = roots.withColumnsRenamed({"node": "fp", "component": "root"})
    by_class = cut_lineage(
        classes.select("fp", "copies", "first_id").join(roots, "fp", "left").join(links, "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    smallest = by_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = by_class.join(smallest, "root").select("fp", "n_links", "component_id")
    return digests.join(by_class, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each group of linked documents keeps its smallest doc_id.

    Rows that repeat a kept doc_id all stay.
    """
    plain = clear_of(docs, ["_keep"])
    groups = join_by_ngrams(plain, percent)
    keep = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return plain.join(keep, plain["doc_id"].eqNullSafe(F.col("_keep")), "left_semi")
