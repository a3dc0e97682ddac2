"""Main text of web pages: boosted trees over elements, decoded along the page's tree.

The trees give each block element the odds that it belongs to the article or holds it. Decoding
picks the likeliest choice for the whole page in which everything below a dropped element is
dropped too, so no element contradicts those above or below it.

Pages come without labels. The trees learn from pages that are put together here: known kinds of
page parts, with many ways to mark them up, filled with text taken from a bounded sample of the
pages themselves.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlens.llm.boosting import BoostedTrees, fit
from gridlens.llm.common import clear_of
from gridlens.llm.dom import Node, describe, parse

#: Pages whose text fills the training pages, in the order of a hash of their id.
SAMPLE_PAGES = 200
TRAINING_PAGES = 800
#: Tokens of tags, classes, ids and roles that are told apart.
TOKENS = 128
PAGES_AT_ONCE = 100
OUTPUTS = ["text", "n_chars"]

#: Ways to mark up the parts of a page: elements, and class or id names.
MAIN = (("article", "main", "div", "section", "div"),
        ("", "content", "main", "post", "entry-content", "article-body", "story", "text", "post-body", "page"))
SIDE = {
    "menu": (("nav", "ul", "div", "nav"), ("", "menu", "nav", "navbar", "navigation", "breadcrumbs", "topnav")),
    "header": (("header", "div", "header"), ("", "header", "site-header", "masthead", "banner", "top")),
    "footer": (("footer", "div", "footer"), ("", "footer", "site-footer", "copyright", "legal", "bottom")),
    "sidebar": (("aside", "div", "aside"), ("", "sidebar", "side", "widget", "related", "recommended", "rail")),
    "notice": (("div", "section"), ("notice", "cookie-notice", "consent", "alert", "banner", "gdpr", "popup")),
    "advert": (("div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad")),
    "form": (("form",), ("", "login", "search", "newsletter", "subscribe", "signup")),
    "share": (("div", "ul"), ("share", "social", "tags", "buttons", "toolbar")),
    "comments": (("section", "div", "ol"), ("comments", "comment-list", "replies", "responses", "discussion", "comment")),
}
INSIDE = ("advert", "share", "form", "sidebar", "notice")


def _open(rng: np.random.Generator, ways: tuple, keep: int) -> tuple[str, str]:
    tag = ways[0][rng.integers(len(ways[0]))]
    name = ways[1][rng.integers(len(ways[1]))]
    attribute = f' {"class" if rng.random() < 0.7 else "id"}="{name}"' if name else ""
    return f'<{tag}{attribute} data-k="{keep}">', f"</{tag}>"


def training_page(rng: np.random.Generator, texts: list[str]) -> str:
    """A page with marked parts: data-k is 1 on the article, 0 on everything else."""
    def text(low: int, high: int) -> str:
        words = texts[rng.integers(len(texts))].split()
        size = int(rng.integers(low, high))
        at = int(rng.integers(max(1, len(words) - size)))
        return html.escape(" ".join(words[at:at + size]))

    def part(kind: str) -> str:
        a, b = _open(rng, SIDE[kind], 0)
        if kind in ("menu", "share"):
            items = "".join(f'<li><a href="#">{text(1, 4)}</a></li>' for _ in range(rng.integers(2, 9)))
            body = items if a.startswith(("<ul", "<ol")) else f"<ul>{items}</ul>"
        elif kind == "comments":
            body = "".join(f'<div class="comment"><b>{text(1, 3)}</b><p>{text(4, 60)}</p></div>' for _ in range(rng.integers(1, 6)))
        elif kind == "form":
            body = f'<label>{text(1, 6)}</label><input name="q"><button>{text(1, 3)}</button>'
        elif kind == "sidebar":
            body = f"<h3>{text(1, 5)}</h3>" + "".join(f'<p><a href="#">{text(3, 12)}</a> {text(0, 25)}</p>' for _ in range(rng.integers(1, 6)))
        else:
            inner = "".join(f"<p>{text(2, 30)}</p>" for _ in range(rng.integers(1, 3)))
            body = inner if rng.random() < 0.4 else text(2, 30)
        return a + body + b

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.75:
            body = text(1, 120)
            style = rng.random()
            if style < 0.2:
                return f"<p><b>{body}</b></p>"
            if style < 0.35:
                return f"<p><b>{body}<br>"  # left open, as careless pages do
            return f"<p>{body}" + ("</p>" if style < 0.85 else "")
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{text(2, 20)}</li>" for _ in range(rng.integers(1, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{text(5, 60)}</blockquote>"
        if kind < 0.95:
            return f"<h2>{text(1, 8)}</h2>"
        return f"<div>{text(5, 80)}</div>"

    a, b = _open(rng, MAIN, 1)
    pieces = [f"<h1>{text(2, 12)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(int(rng.choice([0, 0, 0, 1, 2, 4, 8, 16] * 3 + [96]))):
        pieces.append(paragraph())
        if rng.random() < 0.08:
            pieces.append(part(INSIDE[rng.integers(len(INSIDE))]))
    pieces.append(paragraph())
    main = a + "".join(pieces) + b
    if rng.random() < 0.3:
        main = f'<div class="{("wrap", "container", "row", "layout")[rng.integers(4)]}">{main}' + (
            part("sidebar") if rng.random() < 0.5 else "") + "</div>"
    before = [part(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [part(k) for k in ("share", "comments", "advert", "sidebar", "form", "menu", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    return f"<html><head><title>{text(2, 8)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for elements of the article and those that hold it."""
    keep = np.zeros(len(nodes), np.int64)
    for i, n in enumerate(nodes):
        keep[i] = n.label if n.label is not None else (keep[n.parent] if i and keep[n.parent] < 2 else 0)
    for i in range(len(nodes) - 1, 0, -1):
        if keep[i] == 1:
            keep[nodes[i].parent] = 1
    keep[0] = 1
    return keep


@dataclass
class Extractor:
    vocabulary: dict[str, int]
    trees: BoostedTrees

    def texts(self, pages: list[str]) -> list[str]:
        """Main text of each page."""
        parsed = [parse(p) for p in pages]
        rows = [describe(nodes, self.vocabulary) for nodes, _ in parsed]
        odds = self.trees.log_odds(np.array([r for page in rows for r in page]))
        out, at = [], 0
        for (nodes, blocks), page in zip(parsed, rows):
            kept = decode(nodes, odds[at:at + len(page)])
            at += len(page)
            out.append("\n".join(text for node, text in blocks if kept[node]))
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Likeliest choice of kept elements in which a kept one has only kept ones above it.

    ``odds`` are the log odds of keeping an element whose parent is kept. Keeping it is worth its
    own log probability and the best choice for each child; dropping it settles all below.
    """
    keep = -np.logaddexp(0, -odds)
    drop = (-np.logaddexp(0, odds)).tolist()
    worth = keep.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        worth[nodes[i].parent] += max(worth[i], drop[i])
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and worth[i] >= drop[i]
    return kept


def examples(made: list[list[Node]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and labels of the elements whose parent is kept."""
    x, y = [], []
    for nodes in made:
        label = labels(nodes)
        for i, row in enumerate(describe(nodes, vocabulary)):
            if i and label[nodes[i].parent]:
                x.append(row)
                y.append(label[i])
    return np.array(x), np.array(y)


def common_tokens(made: list[list[Node]]) -> dict[str, int]:
    """The TOKENS commonest tokens, those of the element above included, numbered."""
    seen = Counter(t for nodes in made for n in nodes for t in n.tokens)
    seen.update("^" + t for nodes in made for n in nodes[1:] for t in nodes[n.parent].tokens)
    order = sorted(seen, key=lambda t: (-seen[t], t))
    return {t: i for i, t in enumerate(order[:TOKENS])}


def train(pages: DataFrame, seed: int = 11) -> Extractor:
    """Fits the trees to pages put together here, filled with the text of at most SAMPLE_PAGES."""
    sample = (
        pages.where("html is not null").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id")
        .limit(SAMPLE_PAGES).collect()
    )
    texts = sorted({text for row in sample for _, text in parse(row["html"])[1]}) or ["word, word word."]
    rng = np.random.default_rng(seed)
    made = [parse(training_page(rng, texts))[0] for _ in range(TRAINING_PAGES)]
    vocabulary = common_tokens(made)
    return Extractor(vocabulary, fit(*examples(made, vocabulary)))


def extract(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """All columns and rows of ``pages`` but html, with text and n_chars.

    Character references are decoded, white space within a block becomes one space, and blocks are
    joined by line ends in page order. A null or empty page, or one without an article, has an empty
    text. Repeated rows get the same text; columns named like an output are replaced.
    """
    base = clear_of(pages, OUTPUTS)
    others = [c for c in base.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.column("html").slice(at, PAGES_AT_ONCE).to_pylist()
                texts += extractor.texts([p or "" for p in some])
            columns = [batch.column(c) for c in others]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *OUTPUTS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "html"]
    return base.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
