"""Byte-pair encoding and decoding: speculate by longest match, verify adjacent pairs.

A token sequence is the one that merging would give exactly if every two neighbours, merged on
their own, stay the two tokens they are. So each new word is cut greedily into longest tokens, all
neighbour pairs of all new words are looked up at once in a table of known pairs, and only words
with a failing pair are merged step by step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlens.llm.common import clear_of
from gridlens.llm.vocabulary import Cutter, Merger, Vocabulary, gather, in_chunks

#: Words whose tokens are remembered in a worker.
CACHED_WORDS = 400_000
OUTPUTS = ["ids", "decoded"]


class Coder:
    """Encodes and decodes texts in one worker.

    Known words are numbered; the tokens of word w are ``flat[starts[w] : starts[w] + lengths[w]]``.
    """

    def __init__(self, vocabulary: Vocabulary, special: bool = True) -> None:
        self.v = vocabulary
        self.cut, self.merge = Cutter(vocabulary, special), Merger(vocabulary)
        #: The length of the longest token that starts with these one or two bytes.
        self.reach: dict[bytes, int] = {}
        for token in vocabulary.ids:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 0), len(token))
        self.bytes_of = vocabulary.token_bytes()
        self.size = max(self.bytes_of, default=0) + 1
        self.known = np.empty(0, np.int64)  # sorted pair keys
        self.sound = np.empty(0, bool)
        every = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.token_lengths = np.fromiter(map(len, every), np.int64, self.size)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(every), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str | tuple[str], int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def longest_match(self, word: bytes) -> list[int]:
        ids, reach, out, i, n = self.v.ids, self.reach, [], 0, len(word)
        while i < n:
            end = min(n, i + reach.get(word[i:i + 2], 1))
            while (token := ids.get(word[i:end])) is None:
                end -= 1
            out.append(token)
            i = end
        return out

    def pairs_sound(self, keys: np.ndarray) -> np.ndarray:
        """For each pair key (left * size + right; a lone token is its own right): does merging leave it as it is?"""
        new = np.setdiff1d(keys, self.known)
        if len(new):
            verdicts = []
            for key in new.tolist():
                a, b = divmod(key, self.size + 1)
                ids = [a] if b == self.size else [a, b]
                verdicts.append(self.merge(b"".join(self.bytes_of[i] for i in ids)) == ids)
            order = np.argsort(merged := np.concatenate([self.known, new]))
            self.known, self.sound = merged[order], np.concatenate([self.sound, np.array(verdicts, bool)])[order]
        return self.sound[np.searchsorted(self.known, keys)]

    def guess(self, words: list[str]) -> list[list[int]]:
        """Speculate on all words, verify all their pairs at once, merge those that fail."""
        raw = [w.encode() for w in words]
        guesses = [self.longest_match(w) for w in raw]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(guesses)), lengths)
        right = np.append(flat[1:], 0)
        last = np.append(owner[1:] != owner[:-1], True)[:len(owner)]
        tested = ~last | (lengths[owner] == 1)
        keys = np.where(last, flat * (self.size + 1) + self.size, flat * (self.size + 1) + right[:len(flat)])[tested]
        failing = np.zeros(len(guesses), bool)
        failing[owner[tested][~self.pairs_sound(keys)]] = True
        for i in np.flatnonzero(failing).tolist():
            guesses[i] = self.merge(raw[i])
        return guesses

    def learn(self, new: list[str | tuple[str]]) -> None:
        """Number new words and append their tokens."""
        if not new:
            return
        words = [w for w in new if isinstance(w, str)]
        guesses = self.guess(words)
        special = [w for w in new if isinstance(w, tuple)]
        words += special
        guesses += [[self.v.special[s]] for s, in special]
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end."""
        cuts = list(map(self.cut, texts))
        if len(self.number) > CACHED_WORDS:
            self.forget()
        if len(self.known) > 20 * CACHED_WORDS:
            self.known, self.sound = np.empty(0, np.int64), np.empty(0, bool)
        per_text = np.fromiter(map(len, cuts), np.int64, len(cuts))
        words = list(chain.from_iterable(cuts))
        places = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self.learn(list(set(new)))
            places[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        lengths = self.lengths[places]
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(per_text)]
        return gather(self.flat, self.starts[places], lengths), ends

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [part.tolist() for part in np.split(ids, ends[:-1])]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become the replacement character."""
        ids = np.asarray(ids, np.int64)
        raw = gather(self.token_bytes, self.token_starts[ids], self.token_lengths[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode()


#: One coder for each vocabulary lives on in a worker, so that its tables stay warm between tasks.
_CODERS: dict[str, Coder] = {}


def coder_for(vocabulary: Vocabulary) -> Coder:
    if vocabulary.digest not in _CODERS:
        _CODERS.clear()
        _CODERS[vocabulary.digest] = Coder(vocabulary)
    return _CODERS[vocabulary.digest]


def coded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """All rows of ``docs`` without ``text``, with n_tokens and either the results or digests of them.

    Without ``digests``: ids (array<int>) and decoded (string). With: ids_sha256 over the ids as
    little-endian 32-bit integers and decoded_sha256 over the decoded text in UTF-8.

    Encodes as the tokenizer file at ``path`` (read by the driver) says, special tokens in a text
    included, none added, no truncation or padding. A null text counts as empty and has no tokens.
    Repeated rows are encoded alike; columns named like an output are replaced; no rows give no rows.
    """
    results = ["n_tokens", *(("ids_sha256", "decoded_sha256") if digests else OUTPUTS)]
    base = clear_of(docs, results)
    others = [c for c in base.columns if c != "text"]
    vocabulary = Vocabulary(path)
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found: dict[str, list] = {name: [] for name in results}
            for chunk in in_chunks(texts):
                flat, ends = coder.encode_flat(chunk)
                for ids in np.split(flat, ends[:-1]):
                    decoded = coder.decode(ids)
                    found["n_tokens"].append(len(ids))
                    if digests:
                        found["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                        found["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    else:
                        found["ids"].append(ids.tolist())
                        found["decoded"].append(decoded.decode())
            columns = [batch.column(c) for c in others]
            columns += [pa.array(found[n], kinds.get(n, pa.string())) for n in results]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *results])

    types = {"n_tokens": "bigint", "ids": "array<int>"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text"]
    fields += [f"{n} {types.get(n, 'string')}" for n in results]
    return base.mapInArrow(run, ", ".join(fields))
