"""Main text of web pages by a tree-structured graphical model over their blocks.

A page becomes the tree of its block elements.  Each block is content or not; a block's features say
how likely either is, and potentials between parent and child say how the two go together.  Sum-product
messages, up from the leaves and down from the root, give every block's exact marginal; blocks with a
marginal of a half or more are the text.  Weights are those that make the labels of the training pages
most likely (gradient: labels less marginals).

Labels come from pages that mark their article (``article`` or ``main``) and their other parts; each
training page is used twice, as it is and with those marks taken away, so that pages without them are
judged by shape, text and place.  At most ``SAMPLE`` pages of at most ``SAMPLE_BYTES`` are used.

A null page is an empty one and gives an empty text; broken markup is read as far as it goes; null and
repeated ids are kept as rows; other columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

SAMPLE, SAMPLE_BYTES, ROUNDS = 120, 100_000, 120

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg math object select canvas audio video".split())
GROUPS = (
    "html body article main section div p h1 h2 h3 ul li dl table tr td nav header footer aside form button figure blockquote pre address fieldset details other"
).split()
ALIAS = {
    "h4": "h3", "h5": "h3", "h6": "h3", "ol": "ul", "menu": "ul", "dt": "dl", "dd": "dl", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "table", "th": "td",
    "figcaption": "figure", "summary": "details", "legend": "fieldset",
}
PLACE = {g: i for i, g in enumerate(GROUPS)}
#: Words in class, id and role that hint at a part of a page.
HINTS = (
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager",
    "comment comments reply replies disqus discussion",
    "sidebar side widget related recommended aside",
    "footer foot copyright colophon contentinfo",
    "header masthead topbar branding",
    "cookie cookies notice consent gdpr popup modal newsletter subscribe alert",
    "share sharing social follow login signup search",
    "article post story entry content main body text",
)
HINT = {w: i for i, words in enumerate(HINTS) for w in words.split()}
GOOD_HINT = len(HINTS) - 1
MARKED = frozenset(PLACE[g] for g in ("article", "main"))
OTHER_PARTS = frozenset(PLACE[g] for g in ("nav", "footer", "aside", "form", "button", "fieldset"))
NEUTRAL = frozenset(PLACE[g] for g in ("article", "main", "section", "nav", "header", "footer", "aside", "form"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_MARK = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Blocks in page order; the root (0) stands for the page itself."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    group: list[int] = field(default_factory=lambda: [PLACE["html"]])
    hints: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, str]] = field(default_factory=list)  # block, text with references decoded


def _hints(attributes: str) -> int:
    found = 0
    for m in _NAMES.finditer(attributes):
        for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()):
            if w in HINT:
                found |= 1 << HINT[w]
    return found


def parse(source: str) -> Page:
    """Tree of block elements; inline elements count as text of the block that they are in."""
    page = Page()
    open_tags: list[tuple[str, int]] = [("", 0)]  # name, block
    links = 0

    def text(raw: str) -> None:
        block = open_tags[-1][1]
        plain = entities.unescape(raw) if "&" in raw else raw
        page.pieces.append((block, plain))
        n = len(plain.strip())
        if n:
            page.chars[block] += n
            page.linked[block] += n if links else 0
            page.marks[block] += len(_MARK.findall(plain))

    def close(name: str, barrier: frozenset[str]) -> None:
        nonlocal links
        for k in range(len(open_tags) - 1, 0, -1):
            if open_tags[k][0] == name:
                links -= sum(t == "a" for t, _ in open_tags[k:])
                del open_tags[k:]
                return
            if open_tags[k][0] in barrier:
                return

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if source.startswith("<![CDATA[", m.start()):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if closing:
            close(name, frozenset())
            if name not in INLINE:
                page.pieces.append((open_tags[-1][1], " "))
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
            continue
        if name in VOID:
            if name in ("br", "hr"):
                page.pieces.append((open_tags[-1][1], " "))
            continue
        if name in INLINE:
            if name == "a":
                close("a", frozenset(GROUPS))
                links += 1
            open_tags.append((name, open_tags[-1][1]))
            continue
        # a new block ends an open paragraph, and a list item or cell the one before it
        if name not in ("html", "body"):
            close("p", frozenset(GROUPS) - {"p"})
        if name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            close(name, frozenset(("ul", "ol", "table", "dl", "select", "div", "article", "section")))
        group = PLACE.get(ALIAS.get(name, name), PLACE["other"])
        parent = open_tags[-1][1]
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1)
        page.group.append(group)
        page.hints.append(_hints(attributes) if attributes else 0)
        for counter in (page.chars, page.linked, page.marks):
            counter.append(0)
        open_tags.append((name, len(page.parent) - 1))
    return page


def marked_labels(page: Page) -> list[int] | None:
    """1 for blocks of the marked article, 0 for the rest; None if the page marks none."""
    inside, bad = [False] * len(page.parent), [False] * len(page.parent)
    header, others = PLACE["header"], (1 << GOOD_HINT) - 1
    for i, p in enumerate(page.parent):
        up_in, up_bad = (inside[p], bad[p]) if p >= 0 else (False, False)
        inside[i] = up_in or page.group[i] in MARKED
        bad[i] = up_bad or page.group[i] in OTHER_PARTS or bool(page.hints[i] & others and not page.group[i] in MARKED) or (page.group[i] == header and not up_in)
    return [int(a and not b) for a, b in zip(inside, bad)] if any(inside) else None


# -- the model --------------------------------------------------------------------------------------
NUMBERS = 9
WIDTH = len(GROUPS) + len(HINTS) + NUMBERS


@dataclass
class Forest:
    """Blocks of many pages, and the levels of their trees."""

    parent: np.ndarray
    group: np.ndarray
    features: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list[Page], hidden: bool = False) -> Forest:
    """``hidden``: without the marks of an article and the hints of names."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = lambda name, kind=np.int64: np.concatenate([np.array(getattr(p, name), kind) for p in pages])
    page_of = np.repeat(np.arange(len(pages)), sizes)
    own = flat("parent")
    parent = np.where(own >= 0, own + first[page_of], -1)
    depth, group, hints = flat("depth"), flat("group"), flat("hints")
    chars, linked, marks = (flat(x, np.float64) for x in ("chars", "linked", "marks"))
    if hidden:
        group, hints = np.where(np.isin(group, list(NEUTRAL)), PLACE["div"], group), np.zeros_like(hints)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    below = np.stack([chars, linked, marks])  # with all blocks below
    for level in levels[:0:-1]:
        for row in below:
            np.add.at(row, parent[level], row[level])
    whole = np.maximum(below[0][first][page_of], 1.0)
    before = np.cumsum(chars) - chars
    before -= before[first][page_of]
    x = np.zeros((len(group), WIDTH))
    x[np.arange(len(group)), group] = 1
    for k in range(len(HINTS)):
        x[:, len(GROUPS) + k] = hints >> k & 1
    numbers = (
        np.ones(len(group)), np.log1p(chars) / 5, linked / np.maximum(chars, 1), below[1] / np.maximum(below[0], 1), np.minimum(marks / np.maximum(chars, 1) * 20, 3),
        below[0] / whole, before / whole, (chars == 0) * 1.0, np.minimum(depth, 12) / 6,
    )
    x[:, len(GROUPS) + len(HINTS) :] = np.stack(numbers, axis=1)
    return Forest(parent, group, x, levels)


@dataclass
class Model:
    unary: np.ndarray  # WIDTH: score of content
    pair: np.ndarray  # group of the child, label of the parent, label of the child

    def pack(self) -> np.ndarray:
        return np.concatenate([self.unary, self.pair.ravel()])

    @staticmethod
    def unpack(w: np.ndarray) -> Model:
        return Model(w[:WIDTH], w[WIDTH:].reshape(len(GROUPS), 2, 2))


def _normal(m: np.ndarray) -> np.ndarray:
    return m - m.max(axis=1, keepdims=True)


def marginals(model: Model, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content per block, and of (parent, child) labels per block with a parent, by sum-product."""
    n = len(trees.group)
    local = np.zeros((n, 2))
    local[:, 1] = trees.features @ model.unary
    local = _normal(local)
    pair = model.pair[trees.group]  # block, parent's label, own label
    up = np.zeros((n, 2))  # what the blocks below say about a block
    message = np.zeros((n, 2))  # what a block says about its parent
    for level in trees.levels[:0:-1]:
        own = local[level] + up[level]
        message[level] = _normal(np.logaddexp(pair[level, :, 0] + own[:, :1], pair[level, :, 1] + own[:, 1:]))
        np.add.at(up, trees.parent[level], message[level])
    down = np.zeros((n, 2))  # what all else says about a block
    joint = np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        p = trees.parent[level]
        above = local[p] + up[p] + down[p] - message[level]
        both = above[:, :, None] + pair[level] + (local[level] + up[level])[:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        both = np.exp(both)
        joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        down[level] = _normal(np.logaddexp(above[:, :1] + pair[level, 0], above[:, 1:] + pair[level, 1]))
    belief = np.exp(_normal(local + up + down))
    return belief[:, 1] / belief.sum(axis=1), joint


def gradient(model: Model, trees: Forest, labels: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Of the mean log-likelihood of the labels: features and pairs as labelled less as expected."""
    prob, joint = marginals(model, trees)
    n = len(labels)
    unary = trees.features.T @ (labels - prob) / n
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros_like(joint)
    seen[child, labels[trees.parent[child]], labels[child]] = 1
    pair = np.zeros_like(model.pair)
    np.add.at(pair, trees.group[child], seen[child] - joint[child])
    return np.concatenate([unary, pair.ravel() / n]) - l2 * model.pack() / 10


def train(sources: list[str], rounds: int = ROUNDS) -> Model:
    pages = [(p, y) for p, y in ((p, marked_labels(p)) for p in map(parse, sources)) if y is not None]
    w = np.zeros(WIDTH + 4 * len(GROUPS))
    if not pages:  # nothing to learn from: paragraphs and headings are content, hinted parts are not
        model = Model.unpack(w)
        model.unary[[PLACE[g] for g in ("p", "h1", "h2", "h3", "article", "main", "blockquote", "pre")]] = 2
        model.unary[[PLACE[g] for g in ("nav", "footer", "aside", "form", "header", "button")]] = -8
        model.unary[len(GROUPS) : len(GROUPS) + GOOD_HINT] = -8
        model.pair[:, 0, 0] = model.pair[:, 1, 1] = 1
        return model
    labels = np.concatenate([np.array(y) for _, y in pages])
    sets = [forest([p for p, _ in pages], hidden) for hidden in (False, True)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        g = sum(gradient(Model.unpack(w), trees, labels) for trees in sets)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Model.unpack(w)


def main_texts(model: Model, sources: list[str]) -> list[str]:
    if not sources:
        return []
    pages = [parse(s) for s in sources]
    content = marginals(model, forest(pages))[0] >= 0.5
    out, at = [], 0
    for p in pages:
        keep = content[at : at + len(p.parent)]
        at += len(p.parent)
        parts: list[str] = []
        last = -1
        for block, piece in p.pieces:
            if keep[block]:
                if block != last and parts:
                    parts.append(" ")
                parts.append(piece)
                last = block
        out.append(" ".join("".join(parts).split()))
    return out


# -- the jobs ---------------------------------------------------------------------------------------
def training_pages(pages: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """At most ``sample`` pages of bounded size, taken by hash."""
    fit = pages.select("page_id", text_column("html").alias("html")).where((F.octet_length("html") <= most_bytes) & F.lower("html").rlike("<(article|main)[ >]"))
    ids = fit.select("page_id", F.xxhash64("page_id", F.xxhash64("html")).alias("o")).orderBy("o").limit(sample)
    last = ids.agg(F.max("o")).first()[0]
    if last is None:
        return []
    rows = fit.where(F.xxhash64("page_id", F.xxhash64("html")) <= last).orderBy(F.xxhash64("page_id", F.xxhash64("html"))).limit(sample)
    return [r["html"] for r in rows.select("html").collect()]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Per row ``page_id, url, text, n_chars``."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_column("html").alias("html"))
    weights = model.pack()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpack(weights)
        for batch in batches:
            sources = batch.column(2).to_pylist()
            at = 0
            while at < len(sources):
                size, to = 0, at
                while to < len(sources) and (to == at or size + len(sources[to]) < 2_000_000):
                    size, to = size + len(sources[to]), to + 1
                texts = main_texts(own, sources[at:to])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )
                at = to

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
