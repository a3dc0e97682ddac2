"""Operators on documents against plain Python, on the smallest tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import bpe, language_id, line_dedup, mixing, ngram_join, quality_rules, queries, secrets, sharding
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b):
    return a and b and 100 * len(a & b) >= 80 * len(a | b)


def test_shards_are_exact_and_repeatable(documents, odd_documents):
    for docs in (documents, odd_documents):
        rows = sharding.shuffle_to_shards(docs).select("doc_id", "text", "size", "text_crc32", "shard", "slot").collect()
        assert len(rows) == docs.count()
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
            raw = (r.text or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[j]) for j in range(40)]
        assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffle_to_shards(odd_documents.repartition(3)).select("doc_id", "shard", "slot").collect()
    assert sorted(map(str, again)) == sorted(map(str, [r for r in sharding.shuffle_to_shards(odd_documents).select("doc_id", "shard", "slot").collect()]))


def test_matrix_has_given_margins():
    matrix = sharding.communication_matrix([5, 0, 17, 8], [10, 10, 10], 1)
    assert [sum(r) for r in matrix] == [5, 0, 17, 8] and [sum(c) for c in zip(*matrix)] == [10, 10, 10]


def test_mix_meets_targets(documents, odd_documents):
    for docs in (documents, odd_documents):
        rows = mixing.mix_sources(docs).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
        total = defaultdict(lambda: [0, 0])
        for r in rows:
            assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
            total[r.source][0] += r.size
            total[r.source][1] += r.taken
        for r in rows:
            assert total[r.source][0] == r.source_size and r.target <= 2 * r.source_size + 1e-6
            assert abs(total[r.source][1] - r.target) <= 2
        assert sum(t[1] for t in total.values()) == pytest.approx(1.5 * sum(t[0] for t in total.values()), abs=30)


def repeats(text):
    w, places, covered = words(text), defaultdict(list), set()
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    for at in places.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 8))
    return len(covered)


def test_text_statistics(documents, odd_documents):
    for docs in (documents, odd_documents):
        for r in quality_rules.apply_rules(docs, []).collect():
            text, w = r.text or "", words(r.text)
            lines = [line for line in text.split("\n") if WORD.search(line)]
            assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
            assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_repeat_words == repeats(text)
            assert r.base_failed == (len(w) < 20 or 100 * repeats(text) > 30 * len(w)) and r.kept == (not r.base_failed)


def test_rules_find_planted_quality(spark):
    clean, bad = "plain words make a line of text that reads well and goes on for quite a while as it should here now", None
    bad = clean.replace(" ", "### ")
    docs = spark.createDataFrame([(i, f"{bad if i % 3 == 0 else clean} {i}") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    rules = quality_rules.learn_from_labels(docs, labels)
    kept = {r.doc_id for r in quality_rules.apply_rules(docs, rules).where("kept").collect()}
    assert kept == {i for i in range(300) if i % 3}
    assert quality_rules.learn_from_labels(docs, labels.limit(0)) == []


def test_statistics_are_taken_of_labelled_documents_alone(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "labels"))
    some = quality_rules.labelled_statistics(docs, labels)
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner")
    assert "lambda" in above and "lambda" not in below and some.count() == 2


def classes(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}
    ids = sorted(sets)
    links = Counter()
    for a in ids:
        for b in ids:
            if a < b and linked(sets[a], sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return sets, root, links


def test_ngram_join_is_exact(documents):
    sets, root, links = classes(documents.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in ngram_join.join_by_ngrams(documents).collect()}
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == {
        i: (len(s), root[i], links[i]) for i, s in sets.items()
    }


def test_ngram_join_on_odd_rows(spark, odd_documents):
    got = Counter(map(tuple, ngram_join.join_by_ngrams(odd_documents).collect()))
    assert got[(6, 1, 2, 5)] == 2 and got[(5, 1, 2, 5)] == 1 and got[(3, 0, 0, 3)] == 1 and got[(2, 2, 1, 1)] == 1
    assert got[(None, 1, 0, None)] == 1 and sum(got.values()) == 10
    assert ngram_join.join_by_ngrams(odd_documents.limit(0)).count() == 0


def test_ngram_join_links_documents_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, text + " x"), (3, text + " y")], "doc_id long, text string")
    for some, links, smallest in ((docs.where("doc_id is null"), 1, None), (docs, 2, 3)):
        assert {(r.n_links, r.component_id) for r in ngram_join.join_by_ngrams(some).collect()} == {(links, smallest)}


def test_sketches_rule_out_no_pair_that_links():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 2, 9, 60, 64, 65, 130, 500):
        base = rng.integers(-2**63, 2**63 - 1, n)
        for gone in (0, 0.04, 0.1, 0.3):
            own = base[rng.random(n) >= gone]
            sets.append(np.unique(np.append(own, rng.integers(-2**63, 2**63 - 1, max(1, int(gone * n))))))
    sets.sort(key=len)
    held = ngram_join.Sketches([ngram_join.sketch(s) for s in sets])
    n = np.array([len(s) for s in sets])
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    union = n[:, None] + n - common
    every = np.arange(len(sets))
    for i in every:
        assert (held.apart(i, every) <= (union - common)[i]).all()
    for percent in (20, 50, 80, 95, 100):
        first = ngram_join.open_groups(n, [ngram_join.sketch(s) for s in sets], percent)
        linked = 100 * common >= percent * union
        assert (first[:, None] == first)[linked].all()
    assert len(set(ngram_join.open_groups(n, [ngram_join.sketch(s) for s in sets], 80).tolist())) > 8


def test_chains_of_shared_passages_do_not_meet(spark, monkeypatch):
    """Each document shares half of its words with the next one; without sketches all were one cluster."""
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(25)) for _ in range(121)]
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(passages, passages[1:]))]
    rows += [(1_000 + i, f"{rows[i][1]} x{i}") for i in range(0, 120, 10)]
    rows += [(2_000 + i, " ".join([*passages[50].split(), "y", passages[60], f"z{i}"])) for i in range(40)]
    met, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SKETCHES", 16)
    monkeypatch.setattr(ngram_join, "_verified", lambda rows, percent: met.append(rows.count()) or verified(rows, percent))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root, links = classes(docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join_by_ngrams(docs).collect()}
    assert got == {i: (len(s), root[i], links[i]) for i, s in sets.items()}
    assert links[2_000] == 39 and links[1_000] == 1
    assert met[0] <= 40 * 10 + 2 * 12


def test_line_dedup_is_exact(documents, odd_documents):
    for docs in (documents, odd_documents.where("doc_id is not null and doc_id <> 6")):
        seen, gone = [], defaultdict(list)
        for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
            for pos, line in enumerate((r.text or "").split("\n")):
                s = shingles(line)
                if s:
                    if any(linked(s, t) for t in seen):
                        gone[r.doc_id].append(pos)
                    seen.append(s)
        for r in line_dedup.drop_repeated_lines(docs).collect():
            assert r.removed == gone[r.doc_id]
            if r.text is not None:
                assert r.text.count("\n") + 1 == max(1, r.n_lines - len(r.removed))


def test_lines_of_a_long_text_are_cut_out_in_order(spark):
    lines = [f"line {i % 700}" if i % 3 else "" for i in range(3_000)]
    family = [" ".join(f"{'x' if k == j else 'w'}{k}" for k in range(60)) for j in range(0, 60, 6)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "\n".join(family)), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    seen, left = set(), []
    for line in lines:
        if not line or line not in seen:
            left.append(line)
        seen.add(line)
    assert got[1].text == "\n".join(left) and got[1].n_lines == 3_000
    assert (got[2].text, got[2].removed, got[4].text, got[4].removed) == (None, [], "", [])
    sets = [shingles(line) for line in family]
    assert got[3].removed == [j for j in range(len(sets)) if any(linked(sets[j], s) for s in sets[:j])]
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_variants_of_a_line_meet_at_their_first_shared_token(spark):
    lines = [" ".join(f"{'x' * (1 + j // 20) if k == 3 * (j % 20) else 'w'}{k}" for k in range(60)) for j in range(40)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    shared = line_dedup._shared_tokens(line_dedup._first_places(docs, 80))
    both = shared.join(shared.withColumnRenamed("at", "to"), "token").where(F.col("to.place") < F.col("at.place"))
    close = both.where(line_dedup._close("at", "to", 80))
    met = close.where(line_dedup._first_shared("at", "to", 80)).select("at.place.doc_id", F.col("to.place.doc_id").alias("other"))
    sets = [shingles(line) for line in lines]
    found = Counter(map(tuple, met.collect()))
    wanted = {(x, y) for x in range(len(sets)) for y in range(x) if sets[x] != sets[y] and linked(sets[x], sets[y])}
    assert wanted and wanted <= set(found)
    assert 3 * sum(found.values()) < close.count()


def test_prefixes_hold_what_the_runs_of_a_line_ask_for(spark):
    chorus = " ".join(f"la{i % 3} der{i % 5}" for i in range(40))  # 15 of its runs come again and again
    long = " ".join(f"wort{i}" for i in range(60))
    odd = [" \u00c9t\u00e9 \u00e0  la\tplage \u01c4 \u0130s ", "\u00e9t\u00e9 \u00e0 la plage \u01c4 \u0130s", "\u00c9T\u00e9 \u00e0 LA plage \u01c4 \u0130S", "\u00c9t\u00e9 \u00e0 la plage \u01c6 \u0130s"]
    lines = [chorus, chorus + " end", chorus + " other words that go on and on and on until it is no copy", long, long + " x y", "z " + long.upper(),
             *odd, "the the the the the the", "the the the the the", "a b", "A\x0bb", "b a"]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    sets = [shingles(line) for line in lines]
    wanted = {j: [0] if any(linked(sets[j], s) for s in sets[:j]) else [] for j in range(len(sets))}
    assert {r.doc_id: r.removed for r in line_dedup.drop_repeated_lines(docs).collect()} == wanted
    assert wanted[2] == wanted[7] == wanted[9] == [] and wanted[1] == wanted[5] == wanted[8] == wanted[13] == [0]
    firsts = line_dedup._first_places(docs, 80)
    for r in firsts.collect():
        s = sets[r.place.doc_id]
        assert r.least <= len(s) <= r.n and len(s) - -(-80 * len(s) // 100) + 1 <= len(r.prefix) <= len(s)
    plan = line_dedup._lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("crc32")  # below it: once a text, not once a line


def test_prefixes_are_the_first_tokens_of_one_order(spark):
    lines = [" ".join(f"w{(i * i) % m}" for i in range(n)) for m in (2, 3, 5, 40) for n in (3, 5, 6, 25, 60)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    rows = line_dedup._lines(docs)
    levels = line_dedup.rarity_levels(docs)
    whole = {r.doc_id: r.prefix for r in line_dedup._prefixes(rows, levels, 1).collect()}
    found = line_dedup._prefixes(rows, levels, 80)
    for r in found.collect():  # also where runs come again, or first words tie at the prefix's end
        s = shingles(lines[r.doc_id])
        assert len(whole[r.doc_id]) == len(s) and r.least <= len(s) <= r.n
        assert r.prefix == sorted(whole[r.doc_id])[:r.n - -(-80 * r.n // 100) + 1]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan  # a place is sorted beside its rank, so that runs left out are not gone through


def test_secrets_keep_fixed_spans(documents, odd_documents):
    assign = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for docs in (documents, odd_documents):
        for r in secrets.find_secrets(docs).collect():
            t = r.text or ""
            found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
            found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
            found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
            assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "random"] == [(a, b, k) for a, _, b, k in sorted(found)]


def test_short_values_are_no_secrets(spark):
    texts = ["token=abc", "password=ab", "token==abcd", "secret='abcde'", "api_key:a=b=c", "token=abcdef", "token==abcde", "Passwd: 'a.b-c/d'"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_assign for r in secrets.find_secrets(df).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, 0, 0, 0, 1, 1, 1]


def test_battery_tells_keys_from_names(spark):
    keys = ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "Xk3vQ9zLm2PqR8sTuV5wYbCdEf7GhJ1K"]
    names = ["this-is-a-long-name-of-some-file-2024", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789"]
    df = spark.createDataFrame([(t,) for t in keys + names], "t string").select("t", secrets.battery(F.col("t")).alias("p"))
    p = {r.t: r.p for r in df.collect()}
    assert min(p[k] for k in keys) > 0.01 and max(p[n] for n in names) < 1e-6


def test_bpe_equals_the_library(documents, odd_documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    coder = bpe.Coder(bpe.Vocabulary(queries.tokenizer_path()))
    texts = [r.text or "" for r in documents.select("text").union(odd_documents.select("text")).collect()]
    texts += ["a<|endoftext|>b <|endoftext|> c", "日本語 🎉🎉 a b\x1c\x1d", "don't we'LL I'm", "\u0000\x85  x", "aaaa" * 200, "՘ a₏1 \U00010940"]
    for text, ids in zip(texts, coder.encode_many(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids == wanted and coder.decode(ids).decode() == library.decode(wanted, skip_special_tokens=False)
    for r in bpe.coded(odd_documents, queries.tokenizer_path(), digests=True).where("doc_id = 3 or doc_id = 4").collect():
        assert (r.n_tokens, r.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_language_of_held_out_texts(spark, odd_documents):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    hits = rows.where("held_out").join(truth, "doc_id").select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert sum(r.ok for r in hits) / len(hits) > 0.97
    languages, prototypes = language_id.train(odd_documents.withColumn("lang", F.lit("xx")))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(odd_documents, languages, prototypes).collect()}
    assert got[3] == got[4] == got[7] == "und" and got[1] == "xx"


def test_queries_read_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_secrets", "op7_quality_rules", "op8_mixing"):
        assert queries.QUERIES[name](spark, SF).count() == n
