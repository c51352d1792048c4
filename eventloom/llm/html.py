"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier gives each block a score, from what it says
(length, links, punctuation), the kind of element it stands in, and what the tags, classes and ids of
its ancestors tell. The weights start at ``PRIOR`` and are fitted on blocks whose tags tell content
from boilerplate; what the page's words do not tell stays at the prior. The score becomes a capacity
to the content terminal or to the boilerplate terminal; neighbours in page order and blocks under one
parent are tied by smoothness edges, weaker the farther apart they stand in the tree. The minimum
cut, by max-flow, is the labelling of least total cost: a short heading between long paragraphs goes
with them although it looks like a menu's entry.

Before the flow, blocks whose terminal outweighs all their edges are labelled, as every minimum cut
labels them, and hand their edges to their neighbours; so the flow is small even on long pages.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from math import log1p
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, hashed_sample, table, texts_of

#: Pages that the weights are trained on, and blocks of one page, at most.
TRAIN_PAGES, TRAIN_BLOCKS = 300, 64
#: Smoothness between neighbours in page order and between blocks of one parent, if their elements are
#: siblings; half as much for each step that they stand farther apart.
NEXT, SIBLING = 0.8, 0.5
#: Steps in the tree that a place told as boilerplate adds between what is in it and what is not.
BORDER = 8
#: Prior weights of what ancestors tell, each once a block: a content tag, a content word, a boilerplate
#: tag, a word that names boilerplate, one that may, a form, and being outside of the page's content tags.
#: The first and the third and the last come from tags, which give the labels; they are not fitted.
PLACES = {"content": 3.0, "content_word": 2.5, "boilerplate": -7.0, "named": -7.0, "perhaps": -3.5, "form": -3.0, "outside": -3.0}
#: Prior weights of a block's own features, and the bound on their sum: what a block says is never
#: enough against a boilerplate tag.
OWN = {"heading": 0.5, "paragraph": 0.5, "item": -0.5, "length": 0.5, "linked": -2.0, "ended": 0.5, "points": 0.0, "words": 1.0, "marks": -2.0, "constant": -0.5}
OWN_BOUND = 3.0
#: How many of them come from the kind of element.
KINDS = 3
PRIOR = [*PLACES.values(), *OWN.values()]
#: Least share of a page's text that its content tags must have for the rest to count as outside of them.
SHARE = 0.2

_LEX = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|select|math|object|canvas|audio|video)\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Signs that lines of menus and footers have.
_MARKS = re.compile("[©®|·»«›]")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends open elements of these kinds, up to the nearest of the others.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BOILERPLATE_TAGS = frozenset("nav footer aside button dialog menu head".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_CONTENT_TAGS = frozenset(["article", "main"])
#: Words in a class or id that name boilerplate, that may name it or a part of an article, and that name content.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos cookie cookies consent gdpr notice notices notification notifications popup modal newsletter subscribe subscription signup signin login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer copyright sidebar comment comments commentlist disqus respond replies".split()
)
_PERHAPS = frozenset("adv alert alerts aside banner banners disclaimer discussion follow foot form header legal overlay popular promoted promotion rail recommendations recommended register related reply search share sharing skip social trending widget widgets".split())
_CONTENT_WORDS = frozenset("article content entry story post main body text prose".split())
#: Words that say of the word after them only whether the page has such a part.
_HAVING = frozenset("no has have with without hide show".split())
_NOT_ARTICLE = re.compile(r"(?:^|\s)(?:comment|reply|related|promo|ad\b|ads\b|advert|sponsored|teaser)", re.I)

#: Bits of what the ancestors of a block tell; the first six in the order of PLACES.
CONTENT, CONTENT_WORD, BOILERPLATE, NAMED, PERHAPS, FORM, HEADING, PARAGRAPH, ITEM = (1 << i for i in range(9))
BITS = 9


@lru_cache(1 << 14)
def _told(tag: str, attributes: str) -> int:
    """Bits that a start tag tells."""
    own = HEADING if tag in _HEADINGS else PARAGRAPH if tag == "p" else ITEM if tag == "li" else FORM if tag in ("form", "fieldset") else 0
    if tag in _BOILERPLATE_TAGS:
        return own | BOILERPLATE
    told = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    if tag not in ("html", "body") and ("hidden" in told or told.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", told.get("style", ""))):
        return own | BOILERPLATE
    if tag in _CONTENT_TAGS:  # comments and teasers are articles too
        return own | (NAMED if _NOT_ARTICLE.search(told.get("class", "")) else CONTENT)
    if told.get("role") == "main":
        return own | CONTENT
    if told.get("role") in _BOILERPLATE_ROLES:
        return own | BOILERPLATE
    if tag in ("html", "body") or not told:
        return own
    content = named = perhaps = False
    for name in f"{told.get('class', '')} {told.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        words = set() if words and words[0] in _HAVING else set(words)
        if words & _NAMES:
            named = True
        elif words & _PERHAPS and not (words & _CONTENT_WORDS and words & _PERHAPS == {"header"}):
            perhaps = True
        elif words & _CONTENT_WORDS:
            content = True
    if named and content:  # names that speak against each other
        named, perhaps = False, True
    return own | (CONTENT_WORD if content else 0) | (NAMED if named else 0) | (PERHAPS if perhaps and not named else 0)


class Node:
    """An open element that is no run of text: its parent, its depth, the bits of itself and its ancestors, and the inline elements that it opened."""

    __slots__ = ("tag", "parent", "depth", "bits", "inline")

    def __init__(self, tag: str, parent: Node | None, told: int, around: int) -> None:
        self.tag, self.parent, self.inline = tag, parent, {}
        self.depth = parent.depth + 1 if parent else 0
        above = around | (parent.bits if parent else 0)
        if tag == "header" and not above & CONTENT:
            told |= BOILERPLATE
        if told & FORM and above & CONTENT:  # a form of its own, in an article
            told |= BOILERPLATE
        if told & CONTENT:  # some pages are one form from end to end
            above &= ~FORM
        self.bits = above | told


class Block:
    """A run of text between tags of blocks: its text, the characters in links, and the element it stands in."""

    __slots__ = ("text", "linked", "node", "bits")

    def __init__(self, text: str, linked: int, node: Node, bits: int) -> None:
        self.text, self.linked, self.node, self.bits = text, linked, node, bits


def blocks(html: str | None) -> list[Block]:
    """Text blocks of a page in order, white space collapsed and references decoded.

    Broken markup is read as far as it goes. The work is linear in the page, however it nests: open
    elements are found by their tag, and inline elements are counted and not kept in order.
    """
    out: list[Block] = []
    stack = [Node("", None, 0, 0)]
    place: dict[str, list[int]] = {}  # of each tag the places of its open elements in the stack
    open_inline: dict[str, int] = {}  # open inline elements by tag
    told_inline = [0] * BITS  # open inline elements by bit
    parts: list[str] = []
    linked = 0

    def around() -> int:
        return sum(1 << i for i, n in enumerate(told_inline) if n)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, stack[-1], stack[-1].bits | around()))
        parts.clear()
        linked = 0

    def count(tag: str, told: int, by: int) -> None:
        open_inline[tag] = open_inline.get(tag, 0) + by
        while told:
            low = told & -told
            told_inline[low.bit_length() - 1] += by
            told ^= low

    def pop(to: int) -> None:
        for node in stack[to:]:
            place[node.tag].pop()
            for tag, told in node.inline.items():
                for x in told:
                    count(tag, x, -1)
        del stack[to:]

    def nearest(tags: Iterable[str]) -> int:
        return max((place[t][-1] for t in tags if place.get(t)), default=0)

    for m in _LEX.finditer(html or ""):
        close, tag, attributes, broken, text = m.group(2, 3, 4, 5, 6)
        if text is not None:
            decoded = unescape(text) if "&" in text else text
            parts.append(decoded)
            if open_inline.get("a"):
                linked += len(decoded)
            continue
        if broken is not None:
            close, tag, attributes = ("/" if m[0][1] == "/" else ""), broken, ""
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            mine = stack[-1].inline  # what this block has opened, by tag
            if tag == "br":
                parts.append(" ")
            elif close:
                if mine.get(tag):
                    count(tag, mine[tag].pop(), -1)
            elif tag not in _VOID and not attributes.endswith("/"):
                told = _told(tag, attributes) if attributes else 0
                mine.setdefault(tag, []).append(told)
                count(tag, told, 1)
            continue
        flush()
        if close:
            if place.get(tag):
                pop(place[tag][-1])
            continue
        if stack[-1].tag == "p":  # a block ends an open paragraph
            pop(len(stack) - 1)
        if tag in _ENDS:
            ends, stop = _ENDS[tag]
            while (at := nearest(ends)) > nearest(stop):
                pop(at)
                if tag != "tr":
                    break
        if tag == "body" and place.get("head"):
            pop(place["head"][-1])
        if tag not in _VOID and not attributes.endswith("/"):
            place.setdefault(tag, []).append(len(stack))
            stack.append(Node(tag, stack[-1], _told(tag, attributes), around()))
    flush()
    return out


def features(b: Block) -> tuple[float, ...]:
    """A block's own features, in the order of OWN, each from 0 to about 1; the last is constant."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    kind = (float(b.bits & HEADING > 0), float(b.bits & PARAGRAPH > 0), float(b.bits & ITEM > 0))
    return (*kind, min(log1p(n) / 6, 1.5), min(1.0, b.linked / n), 1.0 if b.text[-1] in ".!?…\"”»" else 0.0, min(1.0, 10 * sum(map(b.text.count, ",;.")) / n), min(1.0, words / 20), 1.0 if _MARKS.search(b.text) else 0.0, 1.0)


def places(found: list[Block]) -> list[tuple[float, ...]]:
    """What the ancestors of each block tell, in the order of PLACES."""
    inside = sum(len(b.text) for b in found if b.bits & CONTENT and not b.bits & (BOILERPLATE | NAMED))
    share = inside > 0 and inside >= SHARE * sum(len(b.text) for b in found)
    return [(*(float(b.bits >> i & 1) for i in range(len(PLACES) - 1)), float(share and not b.bits & CONTENT)) for b in found]


def scores(found: list[Block], weights: list[float]) -> list[float]:
    """Of each block a score, positive for content."""
    n = len(PLACES)
    told, own = weights[:n], weights[n:]
    return [sum(map(mul, told, p)) + max(-OWN_BOUND, min(OWN_BOUND, sum(map(mul, own, features(b))))) for b, p in zip(found, places(found), strict=True)]


def _apart(a: Block, b: Block) -> int:
    """Steps between the elements of two blocks in the tree, and a border that only one is behind."""
    steps = BORDER if (a.bits ^ b.bits) & (BOILERPLATE | NAMED) else 0
    a, b = a.node, b.node
    while a is not b and steps < 64:  # edges are weak long before
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next, and with the last one before under the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, NEXT / 2 ** max(0, _apart(found[i - 1], b) - 2)))
        parent = id(b.node.parent)
        if parent in last:
            a = found[last[parent]]
            out.append((last[parent], i, SIBLING / 2 ** max(0, _apart(a, b) - 2)))
        last[parent] = i
    return out


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the scores gone against plus the ties cut; of several the one with least content."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    s, label = list(scores), [None] * n
    todo = deque(range(n))
    while todo:  # a terminal that outweighs all edges decides
        a = todo.popleft()
        if label[a] is None and abs(s[a]) > sum(near[a].values()):
            label[a] = s[a] > 0
            for b, w in near[a].items():
                s[b] += w if label[a] else -w
                del near[b][a]
                todo.append(b)
            near[a] = {}
    if any(x is None for x in label):
        _flow(s, near, label)
    return label


def _flow(s: list[float], near: list[dict[int, float]], label: list) -> None:
    """Dinic's algorithm from the content terminal (scores above 0) to the other; labels what is open."""
    rest, out = [dict(x) for x in near], {i: x for i, x in enumerate(s) if label[i] is None and x > 0}
    into = {i: -x for i, x in enumerate(s) if label[i] is None and x < 0}
    tiny = 1e-12
    while True:
        level = {i: 0 for i, x in out.items() if x > tiny}
        todo, reached = deque(level), False
        while todo:
            a = todo.popleft()
            reached |= into.get(a, 0) > tiny
            for b, w in rest[a].items():
                if w > tiny and b not in level:
                    level[b] = level[a] + 1
                    todo.append(b)
        if not reached:
            for i, x in enumerate(label):
                if x is None:
                    label[i] = i in level
            return
        turn = {a: iter(list(rest[a])) for a in level}
        for start in [i for i, x in out.items() if x > tiny]:
            path = [start]
            while path and out[start] > tiny:
                a = path[-1]
                if into.get(a, 0) > tiny:
                    push = min([out[start], into[a], *(rest[x][y] for x, y in zip(path, path[1:], strict=False))])
                    out[start] -= push
                    into[a] -= push
                    for x, y in zip(path, path[1:], strict=False):
                        rest[x][y] -= push
                        rest[y][x] = rest[y].get(x, 0.0) + push
                    path = path[:1]
                    continue
                step = next((b for b in turn[a] if level.get(b) == level[a] + 1 and rest[a][b] > tiny), None)
                if step is None:
                    path.pop()
                    level[a] = -1
                else:
                    path.append(step)
                    turn[a] = iter([step, *turn[a]])


def main_text(html: str | None, weights: list[float]) -> str:
    """The blocks of content, in page order, a line each; empty for a page that is null or has none."""
    found = blocks(html)
    keep = minimum_cut(scores(found, weights), edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def labelled(found: list[Block]) -> Iterator[tuple[Block, bool]]:
    """Blocks whose tags tell what they are: content in article or main, boilerplate in nav, footer, aside and the like."""
    for b in found:
        if b.bits & BOILERPLATE:
            yield b, False
        elif b.bits & CONTENT and not b.bits & (NAMED | FORM):
            yield b, True


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> list[float]:
    """Weights by logistic regression on ``most`` pages, those whose ids hash lowest; the prior if there are not both labels.

    What tags tell is hidden while the weights are fitted, as it gives the labels, and keeps its prior.
    """
    bound_batches(pages.sparkSession)
    n = len(PLACES)
    hidden = [i for i, x in enumerate(PLACES) if x in ("content", "boilerplate", "outside")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in texts_of(batch, "html"):
                told = list(labelled(blocks(html)))
                for b, content in told[:: 1 + len(told) // TRAIN_BLOCKS]:
                    around = [float(b.bits >> i & 1) if i < n - 1 and i not in hidden else 0.0 for i in range(n)]
                    own = features(b)
                    rows.append([*around, *own, float(content)])
                    rows.append([0.0] * (n + KINDS) + [*own[KINDS:], float(content)])  # as it would look in bare markup
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64()))], ["row"])

    sample = pages.join(F.broadcast(hashed_sample(pages, "page_id", most)), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html")).select("html")
    got = sample.mapInArrow(run, "row array<double>").toArrow().column("row").to_pylist()
    return fit(np.array(got).reshape(-1, len(PRIOR) + 1))


def fit(rows: np.ndarray, steps: int = 800, rate: float = 0.5, shrink: float = 0.003) -> list[float]:
    """Weights from rows of features and a last column of labels; both labels weigh alike in all. What never occurs stays at the prior."""
    x, y = rows[:, :-1], rows[:, -1]
    w = prior = np.array(PRIOR)
    if not 0 < y.sum() < len(y):
        return prior.tolist()
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - rate * (x.T @ (each * (p - y)) + shrink * (w - prior))
    return w.tolist()


def extract(pages: DataFrame, weights: list[float], carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, text and n_chars (code points) of every page. A null html is empty; repeated rows stay repeated."""
    bound_batches(pages.sparkSession)
    rows = pages.select(*carry, "html")
    schema = pages.select(*carry).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, weights) for h in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
