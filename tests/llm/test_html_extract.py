"""The model's marginals against all labellings, its gradient against differences, and texts of pages."""

import itertools

import numpy as np
import pytest
from rows import LONG

from linkloom.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- x --><div class="ad">Buy now!</div>
<article><h1>Title &amp; more</h1><p><b>First   par<br>a <a href="x>y">link</a>.<p>Second&nbsp;one, with words &copy &am</p><ul><li>item one<li>item two</ul>
<div class="comments"><p>Reader says no, never.</p></div></article><aside>Side</aside><form><p>Name <input></p></form><footer>&copy; foot</footer></body></html>"""


def many(n=60):
    words = "alpha beta, gamma. delta epsilon zeta; eta theta".split()
    body = lambda i: "".join(f"<p>{' '.join(words[(i + j) % 8] for j in range(5 + (i * k) % 40))}.</p>" for k in range(1, 5))
    return [PAGE.replace("<p>Second", body(i) + "<p>Second") for i in range(n)]


@pytest.fixture(scope="module")
def model():
    return h.train(many())


def test_marginals_are_exact():
    page = h.parse("<body><div><p>a</p><p>b</p></div><ul><li>c</ul></body>")
    trees = h.forest([page, page])
    w = np.random.default_rng(1).normal(size=h.WIDTH + 4 * len(h.GROUPS))
    m = h.Model.unpack(w)
    n = len(page.parent)
    score = trees.features[:n] @ m.unary
    total, each, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(m.pair[page.group[i], y[page.parent[i]], y[i]] for i in range(1, n)))
        total += p
        each += p * np.array(y)
        for i in range(1, n):
            joint[i, y[page.parent[i]], y[i]] += p
    got, pairs = h.marginals(m, trees)
    assert np.allclose(got[:n], each / total) and np.allclose(got[n:], each / total) and np.allclose(pairs[1:n], joint[1:] / total)


def test_gradient():
    pages = [h.parse(s) for s in many(3)]
    trees, labels = h.forest(pages), np.concatenate([h.marked_labels(p) for p in pages])
    w = np.random.default_rng(2).normal(size=h.WIDTH + 4 * len(h.GROUPS)) * 0.3

    def loglik(w):
        """Log of the labels' probability: their score less the log of the sum over all labellings (message passing)."""
        m = h.Model.unpack(w)
        child = np.flatnonzero(trees.parent >= 0)
        own = (trees.features @ m.unary) @ labels + m.pair[trees.group[child], labels[trees.parent[child]], labels[child]].sum()
        up = np.stack([np.zeros(len(labels)), trees.features @ m.unary], axis=1)
        for level in trees.levels[:0:-1]:
            p = m.pair[trees.group[level]]
            np.add.at(up, trees.parent[level], np.logaddexp(p[:, :, 0] + up[level, :1], p[:, :, 1] + up[level, 1:]))
        return (own - np.logaddexp(*up[trees.levels[0]].T).sum()) / len(labels) - 1e-4 * w @ w / 2

    g = h.gradient(h.Model.unpack(w), trees, labels)
    for i in np.flatnonzero(np.abs(g) > 1e-4)[::7]:
        step = np.zeros_like(w)
        step[i] = 1e-5
        assert abs((loglik(w + step) - loglik(w - step)) / 2e-5 - g[i]) < 1e-6


WANT = "Title & more First par a link. Second one, with words © &am item one item two"


def test_text(model):
    assert h.main_texts(model, [PAGE]) == [WANT]


def test_pages_without_marks(model):
    plain = many(20)[7].replace("article", "div").replace("<header>", "<div>").replace("nav>", "div>").replace("footer>", "div>").replace('class="comments"', "")
    got = h.main_texts(model, [plain])[0]
    assert "alpha beta, gamma." in got and "Home" not in got


@pytest.mark.parametrize("source", ["", "plain words", "<", "<p", "<article><p>cut off <b", "</div></p>", "<article>" * 400 + "deep", "<article><p>" + LONG + "</p></article>", "<script>never closed <p>x", "<a href='x\">y"])
def test_odd_pages(model, source):
    assert len(h.main_texts(model, [source, PAGE])) == 2 and h.main_texts(model, [source, PAGE])[1] == WANT


def test_long_article_is_whole(model):
    assert h.main_texts(model, ["<body><article><p>" + LONG + "</p><p>x</p></article></body>"]) == [LONG + " x"]


def test_table(spark, model):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (None, "v", PAGE, None), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(h.extract(pages, model).collect(), key=str)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, "u", WANT, len(WANT)), (2, None, "", 0), (None, "v", WANT, len(WANT)), (1, "u", WANT, len(WANT))]))
    assert h.training_pages(pages.limit(0)) == [] and h.extract(pages.limit(0), h.train([])).count() == 0
    assert len(h.training_pages(pages, sample=2)) == 2
