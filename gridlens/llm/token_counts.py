"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are strings of the vocabulary. The driver proves once, by merging each
such string alone, which of them encode as exactly one token. A worker then counts the pre-tokens of
a text that are in the proven set, one each, without encoding them, and merges only the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from gridlens.llm.common import clear_of, text_of
from gridlens.llm.vocabulary import Cutter, Merger, Vocabulary, in_chunks

#: Counts of merged words that a worker remembers.
REMEMBERED = 400_000
OUTPUTS = ["n_bytes", "n_tokens", "over_limit"]


def proven_whole(vocabulary: Vocabulary) -> frozenset[str]:
    """Strings of the vocabulary that, as a pre-token of their own, encode as one token.

    Tokens that are not whole characters are no string and cannot be a pre-token; strings that
    merging does not put together again are left out.
    """
    merge = Merger(vocabulary)
    proven = []
    for raw, token in vocabulary.ids.items():
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if merge(raw) == [token]:
            proven.append(text)
    return frozenset(proven)


class Counter:
    """Counts tokens of texts in one worker."""

    def __init__(self, vocabulary: Vocabulary, whole: frozenset[str]) -> None:
        self.cut, self.merge, self.whole = Cutter(vocabulary), Merger(vocabulary), whole
        self.merged: dict[str, int] = {}

    def count_many(self, texts: list[str]) -> list[int]:
        cuts = list(map(self.cut, texts))
        rests = [list(filterfalse(self.whole.__contains__, words)) for words in cuts]
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        for word in set(chain.from_iterable(rests)).difference(self.merged):
            # A special token is given as a tuple.
            self.merged[word] = 1 if isinstance(word, tuple) else len(self.merge(word.encode()))
        number = self.merged.__getitem__
        return [len(words) - len(rest) + sum(map(number, rest)) for words, rest in zip(cuts, rests)]


#: The counter of the last vocabulary lives on in a worker, so that its counts stay known between tasks.
_COUNTERS: dict[str, Counter] = {}


def token_counter(path: str) -> Callable[[Column], Column]:
    """A column function: the number of tokens of a text column under the tokenizer file at ``path``.

    The file is read, and the proof made, on the driver. Null counts as empty.
    """
    vocabulary = Vocabulary(path)
    whole = proven_whole(vocabulary)

    @arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if vocabulary.digest not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[vocabulary.digest] = Counter(vocabulary, whole)
        counter = _COUNTERS[vocabulary.digest]
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            counts = chain.from_iterable(map(counter.count_many, in_chunks(texts)))
            yield pa.array(counts, pa.int64())

    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """All rows and columns of ``docs`` with n_bytes (of the text in UTF-8), n_tokens and over_limit.

    Counts what the tokenizer file at ``path`` gives: special tokens in a text count as one, none is
    added, no truncation or padding. ``over_limit`` says whether a text has more than ``limit``
    tokens. Null and empty texts have no bytes and no tokens. Texts of any length are read whole.
    Repeated rows count alike; columns named like an output (without regard to case) are replaced;
    no rows give no rows.
    """
    base = clear_of(docs, OUTPUTS)
    counted = base.withColumn("n_bytes", F.octet_length(text_of()).cast("long"))
    counted = counted.withColumn("n_tokens", token_counter(path)(text_of()))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
