"""Embeddings against brute force, pages against what they were made of."""

import time

import numpy as np

from gridlens.llm import embedding_dedup, html_extract, queries
from gridlens.llm.dom import NUMBERS, describe, parse
from tests.llm.conftest import SF


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 32))
    near = [base[i % 20] + rng.normal(scale=0.05, size=32) for i in range(200)]
    rows = [(i, list(map(float, v))) for i, v in enumerate([*base, *near, *base[:5]])]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [1.0] * 7), (905, [None] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.link_embeddings(df).collect()}
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(got[i].n_links for i in range(len(rows))) >= 0.9 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(rows)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def test_no_link_is_missed_with_many_lists(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9_000, 16))
    x[6_000:] = x[rng.integers(0, 6_000, 3_000)] + rng.normal(scale=0.35, size=(3_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert len(x) * embedding_dedup.LISTS_PER_VECTOR > 32
    links = np.concatenate([(x[i:i + 2_048] @ x.T >= 0.9).sum(1) - 1 for i in range(0, len(x), 2_048)])
    got = embedding_dedup.link_embeddings(df).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == links.tolist()


def test_no_link_is_missed_at_the_borders_of_lists(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3_000, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    rows = np.concatenate([base, 0.92 * base + np.sqrt(1 - 0.92**2) * aside])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    links = (rows @ rows.T >= 0.9).sum(1) - 1
    got = embedding_dedup.link_embeddings(df).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == links.tolist()


def test_article_is_all_that_is_left(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    right = 0
    rows = queries.op4_html_extract(spark, SF).join(pages.select("page_id", "html"), "page_id").collect()
    for r in rows:
        nodes, blocks = parse(r.html)
        inside = {i for i, n in enumerate(nodes) if n.tag == "article"}
        for i, n in enumerate(nodes):
            if n.parent in inside:
                inside.add(i)
        right += r.text == "\n".join(t for i, t in blocks if i in inside)
        assert r.n_chars == len(r.text)
    assert right >= 0.95 * len(rows)


def test_sibling_features_of_long_lists():
    nodes, _ = parse("<div>" + "".join(f"<p>{'x' * (i + 1)}</p>" for i in range(100)) + "</div>")
    rows = [dict(zip(NUMBERS, r)) for r in describe(nodes, {})][2:]
    page = sum(range(1, 101))
    assert [r["place"] for r in rows] == [i / 100 for i in range(100)]
    assert [r["previous_share"] for r in rows] == [i / page for i in range(100)]
    assert [r["next_share"] for r in rows] == [(i + 2) / page if i < 99 else 0.0 for i in range(100)]


def test_made_pages_and_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "<p>a &amp; b</p>"), (2, None), (3, ""), (4, "plain text only"), (5, "<div><div><p>x"), (6, "</p></div>")],
        "page_id long, html string",
    )
    made = html_extract.train(pages)
    assert [r.text for r in html_extract.extract(pages, made).orderBy("page_id").collect()][1:3] == ["", ""]
    kept = html_extract.decode(parse("<div><p>a</p></div>")[0], np.array([0.0, -9.0, 9.0]))
    assert kept in ([True, False, False], [True, True, True])


def test_cut_tags_are_read_in_one_pass():
    attributes = " ".join(f'a{i}="v{i}" b{i}=\'w{i}\'' for i in range(200))
    json = "{'a':\"b\"}" * 2_000
    pages = [
        f"<p>kept</p><div {attributes}", f'<p>kept</p><div {attributes} x="', f"<p>kept</p><div {attributes} x='>more",
        f"<p>kept</p><div data-x={json}", "<p>kept</p>" + "<a " * 100_000, "<p>kept</p>" + '<a "' * 20_000 + ">",
    ]
    start = time.perf_counter()
    for page in pages:
        assert parse(page)[1][0][1] == "kept"
    assert time.perf_counter() - start < 5


def test_unclosed_parts_hold_no_text():
    for page in ("<p>a</p><!-- b <i>c</i> d", "<p>a</p><!-- b", "<p>a</p><script>b", "<p>a</p><script>if (x > 1) b", "<p>a</p><style>"):
        assert [t for _, t in parse(page)[1]] == ["a"]
    assert [t for _, t in parse('<p title="x > y">a</p><p title="b>c</p>')[1]] == ["a", "c"]
    assert [t for _, t in parse("<p>a</p><script>b</script>c")[1]] == ["a", "c"]
