"""Byte-level vocabulary files: their tables, cutting texts into pre-tokens, and exact merging."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import regex

#: Fixed: the public pattern that cuts text before the merges of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of characters that both libraries class alike; about twice as fast.
QUICK = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters handled at a time in a worker.
CHARS_AT_ONCE = 1_000_000
#: A merge is one number, rank * RANK + id of the merged token, so that numbers sort by rank.
RANK = 1 << 32
NO_MERGE = 1 << 62
#: Bytes of a word from which pairs wait in a heap; shorter words are searched anew for each merge.
HEAP_FROM = 48


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def _characters() -> tuple[frozenset[str], frozenset[str]]:
    """Characters that QUICK classes unlike PATTERN, and those that the tokenizer library may class unlike both.

    The latter are newer than this Python's Unicode tables but known to the pattern's: texts that
    hold one are cut by the tokenizer library.
    """
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    fine, unsure = set(), set()
    for exact, quick in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        held = set(regex.findall(exact, every))
        fine |= held ^ set(re.findall(quick, every))
        unsure |= {c for c in held if unicodedata.category(c) == "Cn"}
    return frozenset(fine | unsure), frozenset(unsure)


def _require(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(f"unsupported tokenizer file: {what}")


class Vocabulary:
    """What a tokenizer file holds, as plain tables that go to the executors once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        cutter, model = data.get("pre_tokenizer") or {}, data["model"]
        _require(data.get("normalizer") is None, "it has a normalizer")
        _require(cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True), "no byte-level pre-tokenizer")
        _require(not cutter.get("add_prefix_space"), "it adds a space")
        _require((data.get("decoder") or {}).get("type") == "ByteLevel", "no byte-level decoder")
        _require(not (model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")), "merge options")
        letters = byte_letters()
        added = data.get("added_tokens", [])
        plain = [t["content"] for t in added if not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        _require(len(plain) == len(added), "added tokens with options")
        self.special = {t["content"]: t["id"] for t in added}
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        _require(all(bytes([b]) in self.ids for b in range(256)), "bytes without a token")
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        as_bytes = ([bytes(letters[c] for c in part) for part in m] for m in merges)
        #: (left id, right id) -> rank * RANK + id of the merged token
        self.merges = {
            (self.ids[a], self.ids[b]): rank * RANK + self.ids[a + b] for rank, (a, b) in enumerate(as_bytes)
        }
        self.fine, self.unsure = _characters()
        self.json = json.dumps(data)
        self.digest = hashlib.sha256(self.json.encode()).hexdigest()

    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of every token, special ones included."""
        return {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}


class Merger:
    """Exact merging of one word: always the pair of the lowest rank, the leftmost of equals."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.known = vocabulary.merges
        self.single = [vocabulary.ids[bytes([b])] for b in range(256)]

    def __call__(self, word: bytes) -> list[int]:
        parts = list(map(self.single.__getitem__, word))
        if len(parts) >= HEAP_FROM:
            return self._long(parts)
        known = self.known.get
        ranks = [known(pair, NO_MERGE) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NO_MERGE:
            i = ranks.index(best)
            parts[i] = token = best % RANK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = known((parts[i - 1], token), NO_MERGE)
            if i < len(ranks):
                ranks[i] = known((token, parts[i + 1]), NO_MERGE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same over linked places, with all mergeable pairs waiting in a heap."""
        known, n = self.known.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = (known(pair, NO_MERGE) for pair in zip(parts, parts[1:]))
        waiting = [(r, i) for i, r in enumerate(ranks) if r < NO_MERGE]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            # A pair that an earlier merge has changed waits anew under its new rank.
            if parts[i] < 0 or j >= n or known((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = rank % RANK, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := known((parts[i], parts[k]))) is not None:
                    heapq.heappush(waiting, (r, i))
            if (h := before[i]) >= 0 and (r := known((parts[h], parts[i]))) is not None:
                heapq.heappush(waiting, (r, h))
        return [p for p in parts if p >= 0]


class Cutter:
    """Cuts texts into pre-tokens; strings of special tokens stand for themselves if asked to."""

    def __init__(self, vocabulary: Vocabulary, special: bool = True) -> None:
        self.json, self.fine, self.unsure = vocabulary.json, vocabulary.fine, vocabulary.unsure
        self.pattern, self.quick = regex.compile(PATTERN), re.compile(QUICK)
        self.ascii_quick = self.fine.isdisjoint(map(chr, range(128)))
        self._library = None
        names = sorted(vocabulary.special, key=len, reverse=True) if special else []
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def _plain(self, text: str) -> list[str]:
        if text.isascii() and self.ascii_quick or self.fine.isdisjoint(text):
            return self.quick.findall(text)
        if self.unsure.isdisjoint(text):
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.json).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str | tuple[str]]:
        """The pre-tokens; a special token is a tuple of its string."""
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        out: list[str | tuple[str]] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append((part,))
            else:
                out.extend(self._plain(part))
        return out


def in_chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, about a million characters at a time."""
    chunk, held = [], 0
    for t in texts:
        chunk.append(t)
        held += len(t)
        if held >= CHARS_AT_ONCE:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + lengths[i]]`` of every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
