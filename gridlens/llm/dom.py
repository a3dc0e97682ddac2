"""A small reader for web pages: elements, blocks of text and numbers that describe elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from math import log1p

# Quotes are taken in pairs, never given back: a tag is read in one way and in one pass. The last form
# reads a tag whose quotes do not pair up before its end.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:(</\1\s*>)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"\bdata-k=\"([01])\"")
_PART = re.compile(r"[a-z]+")
#: Fixed: elements without content, and those that run within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Fixed: what an open element of this kind is closed by, beside its own end.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
        "section table ul li".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}


@dataclass
class Node:
    """A block-level element."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    label: int | None = None
    children: list[int] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    marks: int = 0
    tags: int = 1
    blocks: int = 0
    paragraphs: int = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and blocks of text as (element, text)."""
    nodes = [Node("root", -1, 0)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("root", 0)]  # open elements and the block element they are in
    held: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                at = stack[-1][1]
                blocks.append((at, text))
                node = nodes[at]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.marks += sum(map(text.count, ".,;:!?"))
                node.blocks += 1
            held.clear()
        linked = 0

    def leave(upto: int) -> None:
        """Close the open elements from this depth on."""
        nonlocal links
        if any(name not in INLINE for name, _ in stack[upto:]):
            flush()
        links -= sum(name == "a" for name, _ in stack[upto:])
        del stack[upto:]

    at = 0
    end = page.rfind(">") + 1  # no tag ends behind this place
    for m in _TAG.finditer(page, 0, end):
        if m.start() > at:
            piece = page[at:m.start()]
            held.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        if at == end and (m[1] and not m[2] or m[0].startswith("<!--") and not m[0].endswith("-->")):
            at = len(page)  # a comment or script that nothing closes
        name = m[4] or m[7]
        if name is None:
            continue
        name, attributes = name.lower(), m[5] if m[4] else m[8]
        if m[3] or m[6]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name == "br":
            held.append(" ")
        if name in INLINE:
            nodes[stack[-1][1]].tags += 1
            if name not in VOID and not attributes.endswith("/"):
                stack.append((name, stack[-1][1]))
                links += name == "a"
            continue
        for depth in range(len(stack) - 1, 0, -1):
            open_name = stack[depth][0]
            if name in CLOSED_BY.get(open_name, ()):
                leave(depth)
                break
            if open_name not in INLINE and open_name not in CLOSED_BY:
                break
        flush()
        parent = stack[-1][1]
        found: tuple[str, ...] = ()
        if attributes:
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
            found = tuple(dict.fromkeys(_PART.findall(names)))
        label = _LABEL.search(attributes) if attributes and "data-k" in attributes else None
        nodes[parent].children.append(len(nodes))
        nodes.append(Node(name, parent, nodes[parent].depth + 1, (f"<{name}>", *found), int(label[1]) if label else None))
        if name == "p":
            nodes[-1].paragraphs = 1
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, len(nodes) - 1))
    if at < len(page):
        held.append(page[at:].partition("<!--")[0])
    flush()
    return nodes, blocks


#: Names of the numbers that describe an element, before its tokens.
NUMBERS = [
    "depth", "chars", "share_of_page", "share_of_parent", "chars_per_tag", "chars_per_block", "link_share", "mark_share",
    "paragraphs", "children", "siblings", "place", "before_share", "parent_link_share", "previous_share", "next_share",
]


def describe(nodes: list[Node], vocabulary: dict[str, int]) -> list[list[float]]:
    """For each element the NUMBERS over its subtree, then 1 for each token of the vocabulary that it
    or (marked ^) the element above it has."""
    total = [[n.chars, n.linked, n.marks, n.tags, n.blocks, n.paragraphs] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        up, own = total[nodes[i].parent], total[i]
        for k in range(6):
            up[k] += own[k]
    page = total[0][0] or 1
    before = [0] * len(nodes)  # characters of the page ahead of the element
    places = [0] * len(nodes)  # of the element among its siblings
    rows = []
    for i, n in enumerate(nodes):
        chars, linked, marks, tags, blocks, paragraphs = total[i]
        up = nodes[n.parent] if i else n
        up_total = total[n.parent] if i else total[0]
        siblings = up.children if i else [0]
        place = places[i]
        ahead = before[i]
        for k, c in enumerate(n.children):
            places[c] = k
            before[c] = ahead
            ahead += total[c][0]
        row = [
            float(n.depth), log1p(chars), chars / page, chars / (up_total[0] or 1), log1p(chars / tags),
            log1p(chars / blocks) if blocks else 0.0, linked / (chars or 1), marks / (chars or 1), float(paragraphs),
            float(len(n.children)), float(len(siblings)), place / len(siblings), before[i] / page,
            up_total[1] / (up_total[0] or 1),
            total[siblings[place - 1]][0] / page if place else 0.0,
            total[siblings[place + 1]][0] / page if place + 1 < len(siblings) else 0.0,
        ]
        row += [0.0] * len(vocabulary)
        for t in n.tokens + tuple("^" + t for t in up.tokens):
            if (k := vocabulary.get(t)) is not None:
                row[len(NUMBERS) + k] = 1.0
        rows.append(row)
    return rows
