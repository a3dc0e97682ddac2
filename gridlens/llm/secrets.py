"""Secrets in text: fixed patterns, and a battery of randomness tests for other tokens.

Long tokens are read in the encoding that their characters suggest. Three tests ask whether the
symbols could be drawn at random from its alphabet: chi-squared for uniform use, runs above and
below the middle of the alphabet, and correlation of neighbours. Fisher's rule joins the three.
Over all tokens of the corpus a step-up rule decides which are shown not to be random, with the
share of false decisions under control; short tokens, which tests can say less about, weigh
more. What is left looks random, and so like a key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridlens.llm.common import clear_of, let, text_of
from gridlens.session import cut_lineage

ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
SIGN = r"[\"']?\x20*[:=]\x20*[\"']?"
VALUE = "[A-Za-z0-9+/_.=-]"
#: Fixed patterns in the order of their kinds, and what a match must also be.
KINDS = {
    "assign": (rf"{ASSIGN}{SIGN}{VALUE}+", rf"^{ASSIGN}{SIGN}{VALUE}{{6,}}$"),
    "access": ("AKIA[A-Z0-9]{16,}", None),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}", None),
}
TOKEN = "[A-Za-z0-9+/_-]"
LEAST_TOKEN = 24
#: Encodings from the narrowest: alphabet in the order of its values.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
FALSE_SHARE = 0.05
#: Steps of log10 p in which p-values are counted, and the last one.
GRID, LAST = 0.05, 40.0
OUTPUTS = ["spans", "n_assign", "n_access", "n_hex", "n_random"]


def _spans(text: Column, kind: str, pattern: str, also: str | None) -> Column:
    """Leftmost matches without overlap as array<struct<start, kind_no, end, kind>>.

    Lengths of what is found and of what lies between give the places.
    """
    number = [*KINDS, "random"].index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))

    def places(m: Column) -> Column:
        return let(gaps, lambda g: F.aggregate(
            F.transform(m, lambda s, i: F.struct(s.alias("s"), F.get(g, i).alias("gap"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,no:int,end:int,kind:string,token:string>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.length(x["s"])).alias("at"),
                F.array_append(acc["out"], F.struct(
                    (acc["at"] + x["gap"]).alias("start"), F.lit(number).alias("no"),
                    (acc["at"] + x["gap"] + F.length(x["s"])).alias("end"), F.lit(kind).alias("kind"), x["s"].alias("token"),
                )).alias("out"),
            ),
        )["out"])

    spans = F.when(text.rlike(pattern), let(found, places)).otherwise(
        F.array().cast("array<struct<start:int,no:int,end:int,kind:string,token:string>>")
    )
    return F.filter(spans, lambda x: x["token"].rlike(also)) if also else spans


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), by the rational approximation with error below 7.5e-8 and the usual bound far out."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-F.least(a * a / 2, F.lit(700.0))) / math.sqrt(2 * math.pi)
    tail = F.when(a > 6, density / F.greatest(a, F.lit(1.0))).otherwise(density * poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """p-value that the token's symbols were drawn at random in its encoding; null if it has none.

    Tokens of one character class only (words, numbers) are not tested: they are no keys.
    """
    plain = F.regexp_replace(token, "=+$", "")
    fits = [F.when(plain.rlike(f"^[{_class(name)}]+$"), F.lit(alphabet))
            for name, alphabet in ENCODINGS.items()]
    alphabet = reduce(lambda a, b: F.coalesce(a, b), fits)
    mixed = plain.rlike("[0-9]") & plain.rlike("[A-Za-z]")
    symbols = F.array_remove(F.split(plain, "", -1), "")

    def tested(args: Column) -> Column:
        letters, values, k = args["letters"], args["values"], args["k"]
        n = F.size(values).cast("double")
        mean = (k - 1) / 2
        counts = F.transform(F.array_distinct(letters), lambda d: F.size(F.filter(letters, lambda c: c == d)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * k / n - n
        df = k - 1
        uniform = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        high = F.transform(values, lambda v: v > mean)
        turns = F.size(F.filter(F.transform(high, lambda h, i: (i > 0) & (h != F.get(high, i - 1))), lambda x: x)) + 1
        n1 = F.size(F.filter(high, lambda h: h)).cast("double")
        n2 = n - n1
        expected = 2 * n1 * n2 / n + 1
        variance = F.greatest(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)), F.lit(1e-9))
        runs = F.least(F.lit(1.0), 2 * upper_tail(F.abs(turns - expected) / F.sqrt(variance)))
        own = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
        spread = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - own) * (v - own))
        shift = F.aggregate(
            F.transform(values, lambda v, i: F.when(i > 0, (v - own) * (F.get(values, i - 1) - own)).otherwise(0.0)),
            F.lit(0.0), lambda s, v: s + v,
        )
        serial = F.least(F.lit(1.0), 2 * upper_tail(F.abs(shift / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n))))
        half = -sum((F.log(F.greatest(p, F.lit(1e-250))) for p in (uniform, runs, serial)), F.lit(0.0))
        # Fisher: twice this is chi-squared with six degrees of freedom, whose tail is a short sum.
        return F.exp(-half) * (1 + half + half * half / 2)

    def with_values(args: Column) -> Column:
        return let(F.struct(
            args["letters"].alias("letters"), F.length(args["alphabet"]).cast("double").alias("k"),
            F.transform(args["letters"], lambda c: (F.instr(args["alphabet"], c) - 1).cast("double")).alias("values"),
        ), tested)

    return F.when(mixed & alphabet.isNotNull(), let(F.struct(symbols.alias("letters"), alphabet.alias("alphabet")), with_values))


def _class(name: str) -> str:
    return {"hex": "0-9a-f", "HEX": "0-9A-F", "base32": "A-Z2-7", "base64": "A-Za-z0-9+/", "base64url": "A-Za-z0-9_-"}[name]


def weight(length: Column) -> Column:
    """Weight of a token in the step-up rule: the shorter, the more."""
    return F.greatest(F.lit(0.25), F.least(F.lit(4.0), 40 / length))


def step_up_limit(found: DataFrame, share: float = FALSE_SHARE) -> float:
    """Largest weighted p-value that is still decided as not random (Benjamini and Hochberg).

    ``found`` has one row a token with ``q``, its p-value over its weight. Values are counted on a
    fixed grid of log10 q, each by the upper end of its step, which is the careful side.
    """
    step = F.least(F.floor(-F.log10(F.greatest("q", F.lit(1e-300))) / GRID), F.lit(int(LAST / GRID)))
    counts = {r["step"]: r["n"] for r in found.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    total, below, limit = sum(counts.values()), 0, 0.0
    for s in sorted(counts, reverse=True):  # from the smallest values up, at most LAST / GRID steps
        below += counts[s]
        edge = 10 ** (-s * GRID)
        if edge <= share * below / total:
            limit = edge
    return limit


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE, keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` (without text unless ``keep_text``) with spans, n_assign, n_access, n_hex and n_random.

    ``spans`` is an array of (start, end, kind) in code points, end exclusive, by start and then
    kind: assign, access, hex, random. Fixed patterns always stay; a random-looking token is added
    where it touches none of them. A null or empty text has no spans. Repeated rows are judged
    alike. Columns named like an output are replaced; no rows give no rows.

    The limit between random and not is one number for the whole corpus.
    """
    base = clear_of(docs, [*OUTPUTS, "_base", "_other"])
    text = text_of()
    tokens = _spans(text, "random", f"(?<!{TOKEN}){TOKEN}{{{LEAST_TOKEN},}}={{0,2}}", None)
    judged = F.transform(tokens, lambda x: F.struct(
        x["start"], x["no"], x["end"], x["kind"], (battery(x["token"]) / weight(F.length(x["token"]))).alias("q")
    ))
    scanned = base.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.concat(*[_spans(text, kind, *rule) for kind, rule in KINDS.items()]).alias("_base"),
        judged.alias("_other"),
    )
    columns = [c for c in base.columns if keep_text or c.lower() != "text"]
    return _decided(cut_lineage(scanned.select(*[F.col(f"`{c}`") for c in columns], "_base", "_other")), columns, share)


def _decided(scanned: DataFrame, columns: list[str], share: float) -> DataFrame:
    limit = step_up_limit(scanned.select(F.explode("_other").alias("x")).select("x.q").where("q is not null"), share)
    plain = F.transform("_base", lambda x: F.struct(x["start"], x["no"], x["end"], x["kind"]))
    added = F.transform(
        F.filter("_other", lambda x: x["q"].isNotNull() & (x["q"] > limit) & ~F.exists(
            "_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
        )),
        lambda x: F.struct(x["start"], x["no"], x["end"], x["kind"]),
    )
    spans = F.transform(F.array_sort(F.concat(plain, added)), lambda x: F.struct(x["start"], x["end"], x["kind"]))
    found = scanned.withColumn("spans", spans)
    kinds = F.transform("spans", lambda x: x["kind"])
    return found.select(*[F.col(f"`{c}`") for c in columns], "spans", *[
        (F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in [*KINDS, "random"]
    ])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
