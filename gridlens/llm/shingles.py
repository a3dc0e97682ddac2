"""Sets of five-word shingles as sorted 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes hashed at a time; longer texts are cut at white space.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
                   np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingled(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words."""
    n = max(0, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(WORDS):
        out += words[i:i + n] * _PLACES[i]
    return _mix(out)


def short_shingle(words: np.ndarray) -> np.ndarray:
    """The one hash of a text of fewer words."""
    total = (words * _PLACES[:len(words)]).sum(dtype=np.uint64)
    return _mix(np.array([total], np.uint64) + np.uint64(len(words)))


class Hasher:
    """Word hashes: sums of byte values times powers of a base, taken from running sums."""

    def __init__(self) -> None:
        self.up, self.down = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up = _powers(_BASE, n)
            self.down = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), n)

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of every word. ``starts``: where texts begin, which ends a word too."""
        hashes, places, at = [], [], 0
        while at < len(data):
            end = min(at + SLICE, len(data))
            while end < len(data):
                gap = np.flatnonzero(_WHITE[data[end:end + SLICE]])
                following = np.searchsorted(starts, end)
                stop = int(starts[following]) if following < len(starts) else len(data)
                if len(gap):
                    end = min(end + int(gap[0]), stop)
                    break
                if stop <= end + SLICE:
                    end = stop
                    break
                end += SLICE
            part = _LOWER[data[at:end]]
            white = _WHITE[part]
            first = np.append(True, white[:-1])
            lo, hi = np.searchsorted(starts, [at, end])
            first[starts[lo:hi] - at] = True
            begin = np.flatnonzero(first & ~white)
            # A word ends where the next one begins or white space follows.
            last = np.append(first[1:], True) | np.append(white[1:], True)
            finish = np.flatnonzero(last & ~white) + 1
            self._grow(len(part) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * self.up[:len(part)], dtype=np.uint64)])
            value = (sums[finish] - sums[begin]) * self.down[begin]
            hashes.append(_mix(value + (finish - begin).astype(np.uint64) * _PLACES[0]))
            places.append(begin + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(hashes), np.concatenate(places)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text the sorted distinct shingle hashes, as signed 64-bit numbers."""
        words, places = self.words(data, np.unique(offsets[:-1][offsets[:-1] < offsets[-1]]))
        upto = np.searchsorted(places, offsets)
        out = []
        rolled = shingled(words).view(np.int64)
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            if b - a >= WORDS:
                own = np.sort(rolled[a:b - WORDS + 1])
                out.append(own[np.append(True, own[1:] != own[:-1])])
            elif b > a:
                out.append(short_shingle(words[a:b]).view(np.int64))
            else:
                out.append(np.empty(0, np.int64))
        return out


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a string column, in order; a null text has none. A few megabytes at a time."""
    hasher = Hasher()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    missing = np.asarray(column.is_null())
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 4 * SLICE, side="right")) - 1)
        end = min(end, len(column))
        part = offsets[at:end + 1]
        sets = hasher.sets(data[part[0]:part[-1]], part - part[0])
        for i, s in enumerate(sets):
            yield s[:0] if missing[at + i] else s
        at = end


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
