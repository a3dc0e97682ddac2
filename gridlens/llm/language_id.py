"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product of its letters'
vectors, each rotated by its place. Bundling (adding) the n-gram vectors of a text gives its
profile; bundling those of all training texts of a language gives the language's prototype. A text
gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridlens.llm.common import clear_of

#: Letters are told apart by this many codes: 0 for anything else, one each for a to z, and the
#: rest shared by all other letters.
CODES = 64
DIMENSIONS = 1024
SEED = 5
DOCS_AT_ONCE = 64
OUTPUTS = ["lang_pred", "score"]


def letter_codes() -> np.ndarray:
    points = np.arange(0x110000)
    is_letter = np.fromiter((chr(i).isalpha() for i in points), bool, len(points))
    codes = 27 + (points * 40503 >> 3) % (CODES - 27)
    codes[97:123] = np.arange(1, 27)
    return np.where(is_letter, codes, 0).astype(np.uint8)


def letter_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 2, (CODES, DIMENSIONS), np.int8) * 2 - 1).astype(np.int8)


class Profiler:
    """Turns texts into n-gram counts and counts into profiles, in one worker."""

    def __init__(self) -> None:
        self.codes = letter_codes()
        first = letter_vectors()
        self.rotated = [first, np.roll(first, 1, axis=1), np.roll(first, 2, axis=1)]

    def ngrams(self, text: str) -> np.ndarray | None:
        """Keys of all letter trigrams; runs of other characters count as one space. None: no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([[0], self.codes[points], [0]]).astype(np.int32)
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
        if not codes.any():
            return None
        if codes[-1] == 0 and len(codes) > 3 and codes[-2] == 0:
            codes = codes[:-1]
        return (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = self.rotated
        return a[keys // CODES**2] * b[keys // CODES % CODES] * c[keys % CODES]

    def bundle(self, counts: np.ndarray) -> np.ndarray:
        """Profile of one dense count vector."""
        total = np.zeros(DIMENSIONS)
        keys = np.flatnonzero(counts)
        for i in range(0, len(keys), 4096):
            part = keys[i:i + 4096]
            total += counts[part].astype(np.float64) @ self.vectors(part).astype(np.float64)
        return total

    def bundle_many(self, keys: list[np.ndarray]) -> np.ndarray:
        """One profile a row."""
        flat = np.concatenate(keys)
        seen, at = np.unique(flat, return_inverse=True)
        rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        counts = np.bincount(rows * len(seen) + at, minlength=len(keys) * len(seen)).reshape(len(keys), len(seen))
        counts = counts.astype(np.float32)
        total = np.zeros((len(keys), DIMENSIONS), np.float32)
        for i in range(0, len(seen), 8192):
            total += counts[:, i:i + 8192] @ self.vectors(seen[i:i + 8192]).astype(np.float32)
        return total


def held_out(doc_id: Column) -> Column:
    """Is this document kept out of training? (crc32 of the id's digits, modulo 4, is 2)"""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order, and one prototype each.

    Takes rows with a text and a ``lang``. Each task bundles what it reads; what travels is one
    vector for each task and language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, counts = Profiler(), {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                keys = profiler.ngrams(text)
                if keys is not None:
                    mine = counts.setdefault(lang, np.zeros(CODES**3, np.int64))
                    seen, n = np.unique(keys, return_counts=True)
                    mine[seen] += n
        for lang, mine in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "profile": [profiler.bundle(mine).tolist()]})

    parts = (
        docs.where("text is not null and lang is not null").select("text", "lang")
        .mapInArrow(run, "lang string, profile array<double>")
    )
    summed = (
        parts.select("lang", F.posexplode("profile").alias("place", "value"))
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("profile"))
    )
    # One row a language, of DIMENSIONS numbers.
    rows = sorted(summed.collect(), key=lambda r: r["lang"].encode())
    prototypes = np.array([[p["value"] for p in r["profile"]] for r in rows], np.float64).reshape(len(rows), DIMENSIONS)
    return [r["lang"] for r in rows], prototypes


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """All columns and rows of ``docs`` but its text, with lang_pred and score.

    ``score`` is the cosine, 0 if it is negative. A null text, one without a letter and every text
    when no language was learned are ``und`` with score 0. Equal cosines go to the first language
    in code point order. Repeated rows are judged alike; columns named like an output are replaced.
    """
    base = clear_of(docs, OUTPUTS)
    others = [c for c in base.columns if c != "text"]
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for start in range(0, len(texts) if languages else 0, DOCS_AT_ONCE):
                keys = [(i, k) for i in range(start, min(start + DOCS_AT_ONCE, len(texts)))
                        if texts[i] and (k := profiler.ngrams(texts[i])) is not None]
                if not keys:
                    continue
                profiles = profiler.bundle_many([k for _, k in keys])
                norms = np.maximum(np.linalg.norm(profiles, axis=1), 1e-30)
                cosines = (profiles @ unit.T) / norms[:, None]
                best = cosines.argmax(axis=1)
                for row, (i, _) in enumerate(keys):
                    names[i] = languages[best[row]]
                    scores[i] = min(1.0, max(0.0, float(cosines[row, best[row]])))
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names), pa.array(scores)], names=[*others, *OUTPUTS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text"]
    return base.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
