"""Quality rules as a learned decision list.

Text statistics of labelled documents are cut at quantiles. Sequential covering then learns one
rule after another: a conjunction of threshold tests is grown on two thirds of the labelled
rows, pruned on the rest, and the rows it covers are set aside. The list becomes one ordered
Spark conditional expression: the first rule that holds rejects, no rule keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gridlens.llm.common import clear_of, let, pieces, text_of

SYMBOLS = "[#*$%&|<>]"
#: Labelled rows that rules are learned from, taken in the order of a hash of their id.
LABELLED_ROWS = 20_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Statistics that rules may test.
FEATURES = [
    "n_words", "mean_word", "symbol_rate", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share",
]


def _times(text: Column, pattern: str) -> Column:
    """How often a one-character pattern occurs."""
    return F.size(F.split(text, pattern, -1)) - 1


def text_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` with the columns of BASE and FEATURES.

    ``n_repeat_words`` counts words that lie in some run of ``window`` words found twice or more
    in the text. Texts without such a run, most of them, are told by a count of distinct
    window hashes; only the others look for the places. A null text has no words.
    """
    base = clear_of(docs, [*BASE, *FEATURES, "_pieces", "_words", "_lines", "_runs", "_upper", "_digits", "_marks"])
    text = text_of()
    n = F.size("_words")

    def hashes(all_words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(all_words) - window + 1), lambda i: F.xxhash64(F.slice(all_words, i, window))
        )

    def covered(runs: Column) -> Column:
        """Words in repeated runs: places with a neighbour of equal hash, then gaps up to ``window``."""
        by_hash = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(by_hash, lambda at: F.sort_array(F.transform(
            F.filter(at, lambda x, k: F.coalesce(F.get(at, k - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(at, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )))
        return let(twice, lambda places: F.aggregate(
            F.transform(
                places, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - i, F.lit(window)))
            ),
            F.lit(0), lambda total, gap: total + gap,
        ))

    step1 = base.withColumns({
        "_pieces": pieces(text),
        "_lines": F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    }).withColumn("_words", F.array_remove("_pieces", ""))
    step2 = step1.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length(text) - F.size("_pieces") + 1).cast("long"),
        "n_symbols": _times(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_runs": F.when(n > window, let(F.col("_words"), hashes)),
        "_upper": _times(text, "[A-Z]"),
        "_digits": _times(text, "[0-9]"),
        "_marks": _times(text, r"[!-/:-@\[-`{-~]"),
    })
    repeated = F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), let(F.col("_runs"), covered))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    some_words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        step2.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumns({
            "mean_word": F.col("word_chars") / some_words,
            "symbol_rate": F.col("n_symbols") / some_words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / some_words,
            "upper_share": F.col("_upper") / chars,
            "digit_share": F.col("_digits") / chars,
            "mark_share": F.col("_marks") / chars,
        })
        .select(*base.columns, *dict.fromkeys([*BASE, *FEATURES]))
    )


@dataclass(frozen=True)
class Test:
    """``feature <= value`` if ``below``, else ``feature > value``."""

    feature: str
    below: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) <= self.value if self.below else F.col(self.feature) > self.value

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.value if self.below else x[self.feature] > self.value

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.below else '>'} {self.value:g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for test in rule:
        hit &= test.holds(x)
    return hit


def between(values: np.ndarray) -> np.ndarray:
    """Half way between neighbouring values."""
    distinct = np.unique(values)
    return (distinct[:-1] + distinct[1:]) / 2


def _cut(x: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in x.items()}


def grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    """Add the test with the largest information gain until only bad rows are covered."""
    rule: list[Test] = []
    while len(rule) < longest and len(bad) and not bad.all():
        p, n = bad.sum(), len(bad)
        before, best, best_gain = np.log2(max(p, 1e-9) / n), None, 1e-9
        for f, values in cuts.items():
            for below in (True, False):
                for v in values:
                    hit = x[f] <= v if below else x[f] > v
                    hp, hn = (bad & hit).sum(), hit.sum()
                    if hp and (gain := hp * (np.log2(hp / hn) - before)) > best_gain:
                        best, best_gain = Test(f, below, float(v)), gain
        if best is None:
            break
        rule.append(best)
        keep = best.holds(x)
        x, bad = _cut(x, keep), bad[keep]
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best (covered bad - covered good) share."""
    def worth(r: Rule) -> float:
        hit = covers(r, x, len(bad))
        p = (bad & hit).sum()
        return (2 * p - hit.sum()) / hit.sum() if hit.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5,
    longest: int = 3, n_cuts: int = 32, most_rules: int = 12,
) -> list[Rule]:
    """Sequential covering. A rule enters the list if, over all rows not yet covered, at least
    ``least`` are covered and the share of bad ones is ``precision`` or more on both parts."""
    n = len(bad)
    rules: list[Rule] = []
    left = np.ones(n, bool)
    for_growth = np.arange(n) % 3 != 0
    cuts = {f: between(np.quantile(x[f], np.linspace(0, 1, n_cuts + 1))) for f in x} if n else {}
    while len(rules) < most_rules and (bad & left).sum() >= least:
        g, h = left & for_growth, left & ~for_growth
        rule = grow(_cut(x, g), bad[g], cuts, longest)
        if not rule:
            break
        if (bad & h).any():
            rule = prune(rule, _cut(x, h), bad[h])
        shares = []
        for part in (g, h, left):
            hit = covers(rule, x, n) & part
            shares.append((bad & hit).sum() / hit.sum() if hit.any() else 1.0)
        hit = covers(rule, x, n) & left
        if hit.sum() < least or min(shares) < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, quality, base_failed and FEATURES of at most ``most_rows`` labelled ids.

    Rows that fail the base rules are in it: Spark would push a test for them below the join, and
    so take the statistics of every document.
    """
    one_label = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
        .where("quality = _other").select("doc_id", "quality")
    )
    chosen = one_label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most most_rows ids
    return text_statistics(texts).select("doc_id", "quality", "base_failed", *FEATURES)


def learn_from_labels(docs: DataFrame, labels: DataFrame, most_rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules that reject what ``labels`` calls quality 0.

    Learns from at most ``most_rows`` labelled rows that pass the base rules. Ids with a null
    label, without a document or with both labels are left out; no rows give no rules.
    """
    judged = labelled_statistics(docs, labels, most_rows).collect()  # at most one row for each labelled document
    rows = [r for r in judged if not r["base_failed"]]
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], tuple(r[f] for f in FEATURES)))
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn_rules(x, np.array([r["quality"] == 0 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, else null."""
    answer = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        condition = F.lit(True)
        for test in rule:
            condition = condition & test.column()
        answer = F.when(condition, F.lit(number)).otherwise(answer)
    return answer


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns and rows of ``docs`` with BASE, FEATURES, rule and kept.

    ``rule`` is the number of the rule that rejects, null if none does. Null and empty texts
    fail the base rules. Repeated rows are judged each alike; columns named like an output are
    replaced; no rows give no rows.
    """
    stats = text_statistics(clear_of(docs, ["rule", "kept"]))
    return stats.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
