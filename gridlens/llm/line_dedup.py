"""Removal of lines that repeat or nearly repeat an earlier line, by an exact set-similarity join.

A line is the set of its five-word shingles. Tokens are ordered by rarity, and lines that reach
the threshold share a token in their prefixes under that order. Length and positional filters
thin the pairs, and the rest is compared set by set. A line goes if any earlier line matches it.

Equal lines are one line from the start: only their earliest place goes on. A token is as rare as its first word
is in all texts (words are counted in classes of their hash); equally rare tokens are ordered by their hash.

Pairs are first formed with the earliest line of each shared token only. That settles nearly all lines of
a large group; only those it does not settle are paired with the others of their tokens that the filters allow.
There a pair is formed at its first shared token only, or nearly so: no more tokens than follow can be common, and
tokens with the same one before them on both sides are left to that one. So lines that share a whole run of rare tokens
meet once and not at each. Both kinds of pairs know how many tokens a line has, and its marks, one bit for the hash class
of each token, of which too many differ between lines that cannot match. So variants of one line that share much, but not enough, are not compared set by set.

All steps are DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridlens.llm.common import clear_of, join_same, let, small_or_shuffled, text_of
from gridlens.session import cut_lineage

WORDS = 5
OUTPUTS = ["n_lines", "removed"]
PLACE = ["doc_id", "crc", "pos"]
#: Bits of a word's hash that name the class in which it is counted.
CLASS_BITS = 14
#: A token's upper bits hold the rarity of its first word, the next ones that word's hash, the lowest the whole run's.
LEVEL_BITS, RUN_BITS = 6, 37
#: Bits for a word's place in its line; below RUN_BITS.
PLACE_BITS = 31
#: Longs of 64 bits that mark the tokens of a line.
MARKS = 4


def _plain(text: Column) -> Column:
    """A to Z as a to z, and spaces for other white space inside lines; other letters stay apart, though not as they are.

    Text with other letters is read as one letter a byte. ``lower`` then changes first bytes of two-byte letters too,
    to first bytes of longer ones; as the number of bytes that follow stays, no two texts become one.
    """
    bytewise = F.decode(text.cast("binary"), "ISO-8859-1")
    plain = F.lower(F.when(F.length(text) == F.octet_length(text), text).otherwise(bytewise))
    for white in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(white), F.lit(" "))
    return plain


def _all_lines(docs: DataFrame) -> DataFrame:
    """doc_id, crc, pos and comparable text of each line."""
    texts = docs.select("doc_id", F.crc32(text_of().cast("binary")).alias("crc"), _plain(F.col("text")).alias("plain"))
    return texts.select("doc_id", "crc", F.posexplode(F.split("plain", "\n", -1)).alias("pos", "line"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, crc, pos, key and comparable text of each line with words."""
    worded = _all_lines(docs).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return worded.select(*PLACE, F.xxhash64("line").alias("key"), "line")


def _hashes(line: Column) -> Column:
    """The hashes of the words; two spaces, or one at an end, have an empty word between them."""
    return F.array_remove(F.transform(F.split(line, " "), lambda word: F.xxhash64(word)), F.xxhash64(F.lit("")))


def _class_of(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - CLASS_BITS)


def rarity_levels(docs: DataFrame) -> list[int]:
    """For each hash class how common its words are, over all texts (as cut at spaces and line ends)."""
    lines = docs.select(F.explode(F.split(_plain(F.col("text")), "\n", -1)).alias("line"))
    words = lines.select(F.explode(F.split("line", " ")).alias("word"))
    levels = [1] * 2**CLASS_BITS
    counted = words.groupBy(_class_of(F.xxhash64("word")).alias("class")).count()
    for row in counted.collect():  # 2**CLASS_BITS rows at most
        levels[row["class"]] = min(2**LEVEL_BITS - 1, 1 + int(2 * math.log2(row["count"])))
    return levels


def _tokens(hashes: str) -> Column:
    """Distinct hashes of the runs of WORDS words, a shorter line being one run."""
    h, size = F.col(hashes), F.size(hashes)

    def with_later(a: Column, b: Column, k: int) -> Column:
        """Each hash of ``a`` with the one of ``b`` k places on, shifted so that the order of words counts."""
        return F.zip_with(a, F.slice(b, F.lit(k + 1), size), lambda x, y: x.bitwiseXOR(F.shiftleft(y, k)))

    fours = let(with_later(h, h, 1), lambda twos: with_later(twos, twos, 2))
    fives = with_later(fours, h, 4)
    return F.array_distinct(F.when(size >= WORDS, F.slice(fives, F.lit(1), size - (WORDS - 1))).otherwise(F.array(F.xxhash64(h))))


def _prefixes(lines: DataFrame, levels: list[int], percent: int) -> DataFrame:
    """key, place, n, least and prefix of lines.

    A line has ``n`` runs of words, which are between ``least`` and ``n`` different tokens. The prefix holds its rarest tokens
    in their order, as many as ``n`` different ones ask for. The first word decides which runs are in it, so
    that the others need no hash.
    """
    # One literal, made before the job starts.
    table = F.split(F.lit(",".join(str(level << 63 - LEVEL_BITS) for level in levels)), ",").cast("array<long>")
    run_mask, place_mask = (1 << RUN_BITS) - 1, (1 << PLACE_BITS) - 1
    word_bits = (1 << 63 - LEVEL_BITS) - 1 - place_mask

    def rank(x: Column, i: Column) -> Column:
        """Rarity and hash of a run's first word, and below them the run's place."""
        level = F.coalesce(F.get(table, _class_of(x)), F.lit(0))  # never null, so that plain numbers are sorted
        return level.bitwiseOR(x.bitwiseAND(F.lit(word_bits))).bitwiseOR(i.cast("long"))

    def run(x: Column) -> Column:
        hashed = F.xxhash64(F.slice("h", x.bitwiseAND(F.lit(place_mask)).cast("int") + 1, F.lit(WORDS)))
        return x.bitwiseAND(F.lit(~run_mask)).bitwiseOR(hashed.bitwiseAND(F.lit(run_mask)))

    held = [*PLACE, "key", "h", "n"]
    hashed = lines.select(*PLACE, "key", _hashes(F.col("line")).alias("h"))
    runs = hashed.select(*held[:-1], F.greatest(F.size("h") - (WORDS - 1), F.lit(1)).alias("n"))
    # Equal runs begin with equal words, so there are no fewer different runs than first words.
    ranked = runs.select(
        *held, F.size(F.array_distinct(F.slice("h", F.lit(1), F.col("n")))).alias("least"),
        F.sort_array(F.slice(F.transform("h", rank), F.lit(1), F.col("n"))).alias("ranks"),
    )
    held.append("least")
    wanted = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    last = F.get("ranks", wanted - 1)
    # A word as rare as the last one wanted may follow; its runs count too, wherever they stand.
    tied = F.shiftright(last, RUN_BITS) == F.shiftright(F.get("ranks", wanted), RUN_BITS)
    with_ties = let(last.bitwiseOR(F.lit(run_mask)), lambda most: F.filter("ranks", lambda x: x <= most))
    chosen = ranked.select(*held, "ranks", F.when(tied, with_ties).otherwise(F.slice("ranks", F.lit(1), wanted)).alias("chosen"))
    tokens = chosen.select(*held, "ranks", F.size("chosen").alias("taken"), F.array_distinct(F.transform("chosen", run)).alias("tokens"))
    # Where runs come again, the chosen ones may be too few tokens: then all are looked at.
    enough = (F.size("tokens") >= wanted) | (F.col("taken") == F.col("n"))
    prefix = F.when(enough, F.col("tokens")).otherwise(F.array_distinct(F.transform("ranks", run)))
    return tokens.select(*PLACE, "key", "n", "least", F.slice(F.sort_array(prefix), F.lit(1), wanted).alias("prefix"))


def _first_places(docs: DataFrame, percent: int) -> DataFrame:
    """key, place of its earliest line, its numbers n and least of tokens, and its prefix, the rarest tokens first."""
    lines = _prefixes(_lines(docs), rarity_levels(docs), percent)
    least = lines.groupBy("key").agg(F.min(F.struct(*PLACE, "n", "least", "prefix")).alias("at"))
    return cut_lineage(least.select("key", F.struct(*[f"at.{c}" for c in PLACE]).alias("place"), "at.n", "at.least", "at.prefix"))


def _shared_tokens(firsts: DataFrame) -> DataFrame:
    """(token, at) for each token in the prefixes of two lines or more; at: place, key, n, least, place i of the token, and
    the token before it in the prefix (null for the first)."""
    sent = firsts.select(F.posexplode("prefix").alias("i", "token"), "place", "key", "n", "least", "prefix")
    sent = sent.select("i", "token", "place", "key", "n", "least", F.get("prefix", F.col("i") - 1).alias("before"))
    shared = sent.groupBy("token").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("token")
    some = sent.join(small_or_shuffled(cut_lineage(shared), 1_000_000), "token", "left_semi")
    return cut_lineage(some.select("token", F.struct("place", "key", "n", "least", "i", "before").alias("at")))


def _sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key and all tokens of the lines with these keys and places."""
    places = small_or_shuffled(keys.select(*[F.col(f"place.{c}").alias(c) for c in PLACE]), 1_000_000)
    texts = docs.select("doc_id", F.crc32(text_of().cast("binary")).alias("crc"), F.split("text", "\n", -1).alias("cut"))
    raw = texts.select("doc_id", "crc", F.posexplode("cut").alias("pos", "line"))
    # Only lines that are asked for are made comparable.
    found = join_same(raw, places, PLACE, "left_semi").select(_plain(F.col("line")).alias("line"))
    found = found.select(F.xxhash64("line").alias("key"), "line")
    hashed = found.dropDuplicates(["key"]).select("key", _hashes(F.col("line")).alias("h"))
    return cut_lineage(hashed.select("key", _tokens("h").alias("tokens")))


def _marks(sets: DataFrame) -> DataFrame:
    """key, number of tokens and marks of each set."""
    each = sets.select("key", F.explode("tokens").alias("t"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("t", 8).bitwiseAND(63).cast("int"))
    marks = [F.coalesce(F.bit_or(F.when(F.pmod("t", F.lit(MARKS)) == m, bit)), F.lit(0)).alias(f"marks{m}") for m in range(MARKS)]
    return each.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("size"), *marks)


def _needed(x: str, y: str, percent: int) -> Column:
    """Common tokens of two lines that reach the threshold."""
    return F.ceil((F.col(f"{x}.least") + F.col(f"{y}.least")) * percent / (100 + percent) - 1e-6)


def _close(x: str, y: str, percent: int) -> Column:
    """Length and positional filters for lines that share the token at places ``i`` (from 0) of both."""
    nx, ny, ix, iy, lx, ly = (F.col(f"{s}.{c}") for c in ("n", "i", "least") for s in (x, y))
    return (100 * nx >= percent * ly) & (100 * ny >= percent * lx) & (
        F.least(nx - ix, ny - iy) + F.least(ix, iy) >= _needed(x, y, percent)
    )


def _first_shared(x: str, y: str, percent: int) -> Column:
    """False for tokens at places ``i`` that are not the first shared one of two lines that reach the threshold.

    At their first shared token, no more than the tokens from there on can be common, and the tokens before it differ.
    """
    nx, ny, ix, iy = (F.col(f"{s}.{c}") for c in ("n", "i") for s in (x, y))
    earlier = F.coalesce(F.col(f"{x}.before") == F.col(f"{y}.before"), F.lit(False))
    return (F.least(nx - ix, ny - iy) >= _needed(x, y, percent)) & ~earlier


def _alike(x: str, y: str, percent: int) -> Column:
    """Marks differ in no more places than sets that reach the threshold can."""
    unlike = sum((F.bit_count(F.col(f"{x}.marks{m}").bitwiseXOR(F.col(f"{y}.marks{m}"))) for m in range(MARKS)), F.lit(0))
    return unlike <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * _needed(x, y, percent)


def _matched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later lines (x) of pairs whose sets reach the threshold."""
    later = small_or_shuffled(pairs, 1_000_000).join(sets.withColumnsRenamed({"key": "x", "tokens": "tx"}), "x")
    # Only sets that are asked for are sent.
    asked = small_or_shuffled(pairs.select("y").distinct(), 1_000_000)
    both = later.join(sets.withColumnsRenamed({"key": "y", "tokens": "ty"}).join(asked, "y", "left_semi"), "y")
    common = F.size(F.array_intersect("tx", "ty"))
    return both.where(100 * common >= percent * (F.size("tx") + F.size("ty") - common)).select(F.col("x").alias("key")).distinct()


def _near_copies(docs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Keys of lines that an earlier, different line matches."""
    keys = cut_lineage(shared.select("at.key", "at.place").distinct())
    sets = _sets(docs, keys)
    exact = [F.col("size").alias("n"), F.col("size").alias("least")]
    marked = shared.withColumn("key", F.col("at.key")).join(_marks(sets), "key")
    marked = cut_lineage(marked.select("token", F.struct(
        "at.place", "at.key", *exact, "at.i", "at.before", *[f"marks{m}" for m in range(MARKS)]
    ).alias("at")))
    ends = cut_lineage(marked.groupBy("token").agg(F.min("at").alias("to"), F.count(F.lit(1)).alias("lines")))
    near = _close("at", "to", percent) & _alike("at", "to", percent)
    met = marked.join(ends, "token").where(F.col("at.key") != F.col("to.key"))
    pairs = cut_lineage(met.where(near).select(F.col("at.key").alias("x"), F.col("to.key").alias("y")).distinct())
    settled = cut_lineage(_matched(pairs, sets, percent))

    # A token of two lines has no further pair.
    more = marked.join(ends.where("lines > 2").select("token"), "token", "left_semi")
    open_ones = more.join(settled, F.col("at.key") == settled["key"], "left_anti")
    others = marked.withColumnRenamed("at", "to")
    near = (F.col("to.place") < F.col("at.place")) & near & _first_shared("at", "to", percent)
    rest = cut_lineage(
        open_ones.join(others, "token").where(near)
        .select(F.col("at.key").alias("x"), F.col("to.key").alias("y")).distinct()
        .join(pairs, ["x", "y"], "left_anti")
    )
    return settled.union(_matched(rest, sets, percent))


def kept_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, crc, pos) of every line with words that no earlier line matches; crc is of the whole text."""
    firsts = _first_places(docs, percent)
    gone = _near_copies(docs, _shared_tokens(firsts), percent)
    return firsts.select("key", "place").join(gone, "key", "left_anti").select(*[F.col(f"place.{c}").alias(c) for c in PLACE])


def drop_repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """All rows and columns of ``docs``, the text without removed lines, with n_lines and removed.

    A line matches an earlier one when 100 * common shingles >= ``percent`` * shingles of either;
    lines of one to four words are one shingle, and A to Z count as a to z. Earlier means a smaller doc_id (null first), or
    further up in the text. Every match counts, also by a line that is itself removed. ``removed``
    holds the places of removed lines, counted from 0; ``n_lines`` counts all.

    * Lines without words stay. A null text stays null and has no removed lines.
    * Rows that agree in doc_id and text are one document, and are treated alike.
    * Columns named like an output are replaced; no rows give no rows.

    Lines and shingles are compared by 64-bit hashes (in the prefixes 57 bits beside the rarity).
    """
    base = clear_of(docs, [*OUTPUTS, "crc"])
    kept = kept_lines(base, percent).groupBy("doc_id", "crc").agg(F.collect_list("pos").alias("_kept"))  # places in one text
    cut = F.split("text", "\n", -1)
    worded = F.filter(F.transform(cut, lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    rows = base.withColumns({
        "crc": F.crc32(text_of().cast("binary")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(cut)).cast("long"),
        "_worded": F.coalesce(worded, F.array().cast("array<int>")),
    })
    kept_here = F.coalesce("_kept", F.array().cast("array<int>"))
    joined = join_same(rows, kept, ["doc_id", "crc"], "left").withColumn("removed", F.array_except("_worded", kept_here))
    # One mark a line, so that a text of many lines is gone through once.
    gaps = F.zip_with("removed", F.concat(F.array(F.lit(-1)), "removed"), lambda r, before: r - before - 1)
    marks = F.array_join(F.transform(F.filter(gaps, lambda g: g.isNotNull()), lambda g: F.concat(F.repeat(F.lit("0"), g), F.lit("1"))), "")
    left = F.array_join(F.zip_with(cut, F.split(marks, ""), lambda line, m: F.when(~m.eqNullSafe("1"), line)), "\n")
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(left)
    out = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in base.columns]
    return joined.select(*out, "n_lines", "removed")


def without_repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with removed lines taken out; documents of which no word is left, but was, go."""
    out = drop_repeated_lines(docs, percent)
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(F.coalesce(left, F.lit(False)) | (F.size("removed") == 0)).select(*docs.columns)
