"""Token counts and alignments against the tokenizer libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, strategies as st
from tokenizers import Tokenizer

from gridlens.llm import alignment, queries, token_counts
from gridlens.llm.vocabulary import Merger, Vocabulary, byte_letters
from tests.llm.conftest import SF

ODD = [
    "", "a<|endoftext|>b <|endoftext|> c<|endoftext", "日本語 🎉🎉 a b\x1c\x1d", "don't we'LL I'm", "\u0000\x85  x", "aaaa" * 200,
    "՘ a₏1 \U00010940", "¼ ⅷ x²_y__ ​́e", "tab\t\n\n  end  ", "x" * 20_000, "abcdefghij" * 2_000,
]


def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_counts_equal_the_library(spark, documents, odd_documents):
    wanted = library()
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, N_Tokens int")
    for docs in (documents, odd_documents, odd):
        rows = token_counts.count_tokens(docs, queries.tokenizer_path(), limit=100).select("text", "n_bytes", "n_tokens", "over_limit").collect()
        assert len(rows) == docs.count()
        ids = wanted.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
        for r, e in zip(rows, ids):
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), len(e.ids), len(e.ids) > 100)
    assert token_counts.count_tokens(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_proven_strings_are_single_tokens_of_the_library():
    vocabulary = Vocabulary(queries.tokenizer_path())
    proven = sorted(token_counts.proven_whole(vocabulary))
    assert len(proven) > 0.9 * len(vocabulary.ids)
    cutter = library().pre_tokenizer
    alone = [w for w in proven if len(cutter.pre_tokenize_str(w)) == 1]
    assert all(len(e.ids) == 1 for e in library().encode_batch(alone, add_special_tokens=False))


def test_heap_merges_like_the_search():
    merge = Merger(Vocabulary(queries.tokenizer_path()))
    for text in ("repeated" * 5, "aaaaaaaaaaab" * 3, "the quick brown"):
        raw = text.encode()
        assert len(raw) < 48 and merge._long([merge.single[b] for b in raw]) == merge(raw)


def test_op11_reads_all_documents(spark):
    assert queries.op11_token_counts(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def brute_groups(a, b):
    """Groups and links of two lists of (id, bytes) over the same bytes."""
    ends_a, ends_b = ends(a), ends(b)
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(str(t) for t, _ in a[i:p]) + "|" + ",".join(str(t) for t, _ in b[j:q]))
        for x in range(i, p):
            for y in range(j, q):
                if max(ends_a[x] - len(a[x][1]), ends_b[y] - len(b[y][1])) < min(ends_a[x], ends_b[y]):
                    links.append((a[x][0], b[y][0]))
        i, j = p, q
    return groups, links


def ends(tokens):
    out, at = [], 0
    for _, raw in tokens:
        at += len(raw)
        out.append(at)
    return out


def brute_alignment(texts):
    """Per text: tokens of A and B, groups and links; None where the text has no tokens."""
    a_lib = library()
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    letters = byte_letters()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        e = a_lib.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in a_lib.id_to_token(i))) for i in e.ids]
        b = []
        for i in b_lib.encode(text):
            piece = b_lib.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("\u2581", " ").encode()))
        raw = (" " + text).encode()
        if b"".join(r for _, r in a) != raw or b"".join(r for _, r in b) != raw:
            out.append(None)
        else:
            out.append((a, b, *brute_groups(a, b)))
    return out


def check_alignment(docs):
    aligned = alignment.align(docs, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"), keep_groups=True)
    texts = {}
    for i, t in docs.select("key", "text").collect():
        texts[i] = t
    keys = list(texts)
    wanted = dict(zip(keys, brute_alignment([texts[k] for k in keys])))
    count = Counter(pair for w in wanted.values() if w for pair in w[3])
    most = defaultdict(int)
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    rows = aligned.documents.collect()
    assert len(rows) == len(keys)
    for r in rows:
        got = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups)
        if (w := wanted[r.key]) is None:
            assert got == (0, 0, 0, 0, 0, 0, "", "")
            continue
        a, b, groups, links = w
        text = ";".join(groups)
        assert got == (
            len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest(), text,
        )
    pairs = {(r.a_id, r.b_id): (r.n_links, r.best) for r in aligned.pairs.collect()}
    assert pairs == {x: (n, n == most[x[1]]) for x, n in count.items()}


def test_alignment_equals_brute_force(spark):
    odd = [*ODD[:9], None, "a ▁ b", "word", "word", " lead  two", "<s>x</s><unk><0x41>", "café ñandú 北京 🎉\n\n\tend", "<unk>"]
    odd += ["xy" * 300, "Überraschung der Woche, mit Anblewh!"]
    check_alignment(spark.createDataFrame([(i, t, 7) for i, t in enumerate(odd)], "key int, text string, N_Links int"))


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 10])
def test_alignment_of_documents_with_and_without_broadcast(documents, monkeypatch, bound):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", bound)
    check_alignment(documents.where("doc_id < 60 and length(text) < 4000").withColumnRenamed("doc_id", "key"))


def test_alignment_does_not_depend_on_the_other_texts():
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    aligner = alignment.Aligner(alignment.Vocabulary(queries.tokenizer_path()), model)
    texts = ["word after word", "café ñandú 🎉 word", "", "two  spaces\t", "word after word", "unseen zyxwvutsrq"]
    alone = [(*r[:4], r[4].tolist()) for t in texts for r in aligner.align_many([t])]
    for some in (list(range(6)), [0, 1, 4, 5]):
        got = [(*r[:4], r[4].tolist()) for r in aligner.align_many([texts[i] for i in some])]
        assert got == [alone[i] for i in some]
        # Each id is written once, followed by its mark.
        assert all(r[0] + r[1] == len(r[3].replace("|", ",").replace(";", ",").split(",")) for r in got if r[0])


def test_alignment_of_no_rows(spark):
    nothing = alignment.align(
        spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"),
    )
    assert nothing.documents.count() == 0 and nothing.pairs.count() == 0


@given(st.lists(st.integers(1, 400), max_size=300), st.lists(st.integers(1, 400), max_size=300))
def test_skipping_runs_equals_common_ends(a, b):
    last = max([0, *a, *b]) + 1
    a, b = sorted({*a, last}), sorted({*b, last})
    found = alignment.align_ends(np.array(a), np.array(b))
    cuts = sorted(set(a) & set(b))
    assert [a[i] for i in found.first_a + found.size_a - 1] == [b[j] for j in found.first_b + found.size_b - 1] == cuts
    assert found.size_a.sum() == len(a) and found.size_b.sum() == len(b)
    overlaps = [
        (i, j) for i in range(len(a)) for j in range(len(b))
        if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])
    ]
    assert sorted(zip(found.left.tolist(), found.right.tolist())) == overlaps


def test_op12_reads_all_documents(spark):
    assert queries.op12_token_alignment(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
