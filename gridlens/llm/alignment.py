"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both token sequences of a text cover the same bytes, so each is its array of end offsets. Where token
i of A and token j of B start at the same byte, the arrays are compared at the index shift j - i with
probes that double in length: a probe that agrees jumps a whole stretch of one-to-one tokens, one that
does not gives the first difference. There the two ends are stepped until they meet; that irregular
group sets the next shift. Many places of the texts, where both end a token, go on side by side.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridlens.llm.bpe import Coder
from gridlens.llm.common import clear_of, small_or_shuffled
from gridlens.llm.vocabulary import Vocabulary, gather, in_chunks
from gridlens.session import cut_lineage

OUTPUTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: Id pairs up to which their counts are broadcast (about 40 bytes each); beyond, the join is shuffled.
BROADCAST_PAIRS = 1_000_000


#: Tokens of A after which a place is sought at which a further walk can start.
LANE = 64
FIRST_PROBE = 4


def stretches(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each walk, how many tokens from i and j on, before ``stop``, end at the same bytes one to one."""
    run, open_, step = np.zeros(len(i), np.int64), np.arange(len(i)), FIRST_PROBE
    while len(open_):
        k = np.arange(step)
        at_a, at_b = i[open_] + run[open_], j[open_] + run[open_]
        same = a[np.minimum(at_a[:, None] + k, len(a) - 1)] == b[np.minimum(at_b[:, None] + k, len(b) - 1)]
        same &= k < (stop[open_] - at_a)[:, None]
        agreed = same.all(axis=1)
        run[open_] += np.where(agreed, step, same.argmin(axis=1))
        open_, step = open_[agreed], 2 * step
    return run


@dataclass
class Aligned:
    """Groups in order (first token and number of tokens of A and of B), and the indices of linked tokens."""

    first_a: np.ndarray
    size_a: np.ndarray
    first_b: np.ndarray
    size_b: np.ndarray
    left: np.ndarray
    right: np.ndarray


def align_ends(a: np.ndarray, b: np.ndarray) -> Aligned:
    """Align two increasing arrays of ends with the same last one."""
    none = np.empty(0, np.int64)
    if not len(a):
        return Aligned(none, none, none, none, none, none)
    marks = np.arange(LANE - 1, len(a) - 1, LANE)
    place = np.searchsorted(b, a[marks])
    common = b[place] == a[marks]
    i, j = np.append(0, marks[common] + 1), np.append(0, place[common] + 1)
    stop = np.append(i[1:], len(a))
    even, odd, left, right = [], [], [], []
    while len(i):
        run = stretches(a, b, i, j, stop)
        even.append((i, run, j))
        i, j = i + run, j + run
        i, j, stop = i[i < stop], j[i < stop], stop[i < stop]
        p, q, apart = i.copy(), j.copy(), np.arange(len(i))
        while len(apart):
            left.append(p[apart])
            right.append(q[apart])
            x, y = a[left[-1]], b[right[-1]]
            p[apart[x < y]] += 1
            q[apart[y < x]] += 1
            apart = apart[x != y]
        odd.append((i, p + 1 - i, j, q + 1 - j))
        i, j = p + 1, q + 1
        i, j, stop = i[i < stop], j[i < stop], stop[i < stop]
    first, run, other = (np.concatenate(c) for c in zip(*even))
    within = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    first, other = np.repeat(first, run) + within, np.repeat(other, run) + within
    odd_a, size_a, odd_b, size_b = (np.concatenate(c) for c in zip(*odd))
    order = np.argsort(np.concatenate([first, odd_a]), kind="stable")
    ones = np.ones(len(first), np.int64)
    groups = ((first, odd_a), (ones, size_a), (other, odd_b), (ones, size_b))
    return Aligned(
        *(np.concatenate(c)[order] for c in groups), np.concatenate([first, *left]), np.concatenate([other, *right])
    )


class Pieces:
    """The subword model in one worker, and the bytes that each of its pieces stands for."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        raw = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i in range(self.size)
            for piece in [self.model.id_to_piece(i)]
        ]
        self.lengths = np.fromiter(map(len, raw), np.int64, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end."""
        ids = self.model.encode(texts, num_threads=1)
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(ends[-1]) if len(ends) else 0), ends


class WordCoder(Coder):
    """Encodes new words by the tokenizer library; known ones are looked up."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary, special=False)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.json)
        self.library.encode_special_tokens = True

    def guess(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]


class Aligner:
    """Encodes texts both ways and aligns them, in one worker."""

    def __init__(self, vocabulary: Vocabulary, model: bytes) -> None:
        self.a, self.b = WordCoder(vocabulary), Pieces(model)
        self.size = max(self.a.size, self.b.size)
        #: An id followed by a comma, a bar, a semicolon or nothing; as bytes of one width, filled up with zeros.
        self.written = np.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.size)], "S")
        self.widths = np.char.str_len(self.written).astype(np.int64)

    def align_many(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """For each text: tokens of A, of B, groups, the groups written, and a key for each link."""
        spaced = [" " + t for t in texts]
        flat_a, ends_a = self.a.encode_flat(spaced)
        flat_b, ends_b = self.b.encode_flat(texts)
        bytes_a = self.a.token_lengths[flat_a]
        bytes_b = self.b.lengths[flat_b]
        raw_a = gather(self.a.token_bytes, self.a.token_starts[flat_a], bytes_a)
        raw_b = gather(self.b.bytes, self.b.starts[flat_b], bytes_b)
        # Texts whose tokens stand for other bytes, and empty ones, take no part.
        till_a, till_b = (np.append(0, np.cumsum(x))[e] for x, e in ((bytes_a, ends_a), (bytes_b, ends_b)))
        raw = [text.encode() for text in spaced]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.frombuffer(b"".join(raw), np.uint8)
        till = np.cumsum(sizes)
        if all(np.array_equal(till, t) and np.array_equal(whole, r) for t, r in ((till_a, raw_a), (till_b, raw_b))):
            kept = sizes > 1
        else:
            kept = np.zeros(len(texts), bool)
            from_a = from_b = 0
            for n, (one, to_a, to_b) in enumerate(zip(raw, till_a.tolist(), till_b.tolist())):
                kept[n] = len(one) > 1 and one == raw_a[from_a:to_a].tobytes() == raw_b[from_b:to_b].tobytes()
                from_a, from_b = to_a, to_b
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        in_a, in_b = np.repeat(kept, sizes_a), np.repeat(kept, sizes_b)
        a, b = flat_a[in_a].astype(np.int64), flat_b[in_b]
        # Ends count on from text to text, so that all are aligned at once: a text's end is common.
        found = align_ends(np.cumsum(bytes_a[in_a]), np.cumsum(bytes_b[in_b]))
        links = a[found.left] * self.b.size + b[found.right]
        order = np.argsort(found.left, kind="stable")
        links, left = links[order], found.left[order]

        counts_a, counts_b = np.where(kept, sizes_a, 0), np.where(kept, sizes_b, 0)
        until_a, until_b = np.cumsum(counts_a), np.cumsum(counts_b)
        until_group = np.searchsorted(found.first_a, until_a)
        until_link = np.searchsorted(left, until_a)
        written = self._written(a, b, found, until_group)
        until_letter = np.append(0, np.cumsum(self.widths[written]))[until_a + until_b]
        letters = self.written[written].view(np.uint8)
        letters = letters[letters != 0].tobytes().decode()
        done = (0, 0, 0, 0, 0)
        ends = (until_a, until_b, until_group, until_link, until_letter)
        for to in zip(*(x.tolist() for x in ends)):
            yield to[0] - done[0], to[1] - done[1], to[2] - done[2], letters[done[4]:to[4]], links[done[3]:to[3]]
            done = to

    def _written(self, a: np.ndarray, b: np.ndarray, found: Aligned, until_group: np.ndarray) -> np.ndarray:
        """All tokens in the order in which groups are written, as places in ``written``."""
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = found.first_a + found.size_a - 1, found.first_b + found.size_b - 1
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        mark_b[last_b[until_group[until_group > 0] - 1]] = 3
        out[np.arange(len(a)) + np.repeat(found.first_b, found.size_a)] = a + self.size * mark_a
        out[np.arange(len(b)) + np.repeat(last_a + 1, found.size_b)] = b + self.size * mark_b
        return out


#: The aligner of the last pair of files lives on in a worker.
_ALIGNERS: dict[str, Aligner] = {}


def _aligned(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool) -> tuple[DataFrame, int]:
    """Each row without its text, with its counts, its groups, and its distinct id pairs with their numbers of links."""
    vocabulary = Vocabulary(path_a)
    with open(path_b, "rb") as file:
        model = file.read()
    pieces = Pieces(model).size
    digest = vocabulary.digest + hashlib.sha256(model).hexdigest()
    others = [c for c in docs.columns if c != "text"]
    kinds = {
        "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    } | ({"groups": pa.string()} if keep_groups else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[digest] = Aligner(vocabulary, model)
        aligner = _ALIGNERS[digest]
        space = aligner.a.size * pieces
        for batch in batches:
            found: dict[str, list] = {name: [] for name in kinds}
            keys, times, sizes = [], [], []
            for chunk in in_chunks([t or "" for t in batch.column("text").to_pylist()]):
                links = []
                for n_a, n_b, n_groups, written, pairs in aligner.align_many(chunk):
                    found["n_a"].append(n_a)
                    found["n_b"].append(n_b)
                    found["n_groups"].append(n_groups)
                    found["n_links"].append(len(pairs))
                    found["groups_sha256"].append(hashlib.sha256(written.encode()).hexdigest() if n_a else "")
                    if keep_groups:
                        found["groups"].append(written)
                    links.append(pairs)
                owner = np.repeat(np.arange(len(links)), [len(x) for x in links])
                distinct, number = np.unique(owner * space + np.concatenate(links), return_counts=True)
                sizes.append(np.bincount(distinct // space, minlength=len(links)))
                keys.append(distinct % space)
                times.append(number.astype(np.int32))
            offsets = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1)
            offsets = pa.array(offsets.astype(np.int32))
            pairs = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            repeats = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *times])))
            columns = [batch.column(c) for c in others] + [pa.array(found[n], kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*columns, pairs, repeats], names=[*others, *kinds, "_pairs", "_times"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    fields += [f"{n} {'string' if pa.types.is_string(kind) else 'bigint'}" for n, kind in kinds.items()]
    return docs.mapInArrow(run, ", ".join([*fields, "_pairs array<bigint>", "_times array<int>"])), pieces


@dataclass
class Alignment:
    """``documents`` with their counts, and ``pairs``: a_id, b_id, n_links over all documents, and
    whether no other A id has more links with this B id (``best``; ties all are)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> Alignment:
    """Align the tokens that a byte-level BPE file (A) and a piece model (B) give each ``text``.

    A encodes a space and the text, B the text, to which it adds that space; strings of special tokens
    are plain text. ``documents`` has all columns of ``docs`` but the text, and n_a, n_b (tokens),
    n_groups (groups of tokens between bytes where both end), n_links (pairs of tokens that share a
    byte), n_best (links whose id pair is a best one of its B id), count_sum (over links, the links of
    their id pair in all documents), groups_sha256 and, if asked for, groups: ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or whose tokens do not stand for exactly these bytes, have no tokens:
    all counts 0 and both texts ''. Repeated rows each count. Columns named like an output are replaced;
    no rows give no rows and no pairs.

    Each row sends its distinct id pairs, not its links. Corpus counts are one row a pair; they are
    broadcast up to a million pairs, beyond that the join is shuffled.
    """
    base = clear_of(docs, [*OUTPUTS, "groups", "_row", "_pairs", "_times"])
    numbered = base.withColumn("_row", F.monotonically_increasing_id())
    stored, pieces = _aligned(numbered, path_a, path_b, keep_groups)
    stored = cut_lineage(stored)
    linked = stored.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("x"))
    linked = linked.select("_row", F.col("x._pairs").alias("pair"), F.col("x._times").alias("times"))
    counts = linked.groupBy("pair").agg(F.sum("times").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % pieces)
    counts = cut_lineage(counts.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best")))
    joined = linked.join(small_or_shuffled(counts, BROADCAST_PAIRS), "pair")
    sums = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
        F.sum(F.col("times") * F.col("n")).alias("_sum"),
    )
    whole = stored.drop("_pairs", "_times").join(sums, "_row", "left")
    documents = whole.select(
        *[F.col(f"`{c}`") for c in base.columns if c != "text"], "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256", *(["groups"] if keep_groups else []),
    )
    pairs = counts.select(
        F.floor(F.col("pair") / pieces).cast("int").alias("a_id"), (F.col("pair") % pieces).cast("int").alias("b_id"),
        F.col("n").alias("n_links"), "best",
    )
    return Alignment(documents, pairs)
