"""The k best documents against plain Python over all documents and terms, ties, repeats and small blocks included."""

import math
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from rows import awkward, empty

from linkloom.llm import common
from linkloom.llm import ranked_search as r

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
words = lambda t: WORD.findall((t or "").translate(LOW))
last = lambda x: math.inf if x is None else x


def brute(docs, items, k):
    docs = [(i, w) for i, t in docs if (w := words(t))]
    total, length = len(docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in set(items):
        found = []
        terms = set(words(text))
        df = {t: sum(t in w for _, w in docs) for t in terms}
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in terms}
        for i, w in docs:
            m = 10 + 90 * len(w) * total // length
            score = sum(weight[t] * (10**9 * tf // (1000 * tf + 8 * m)) for t in terms if (tf := w.count(t)))
            if score > 0:
                found.append((-score, last(i), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [
    (1, "w5 x5 w6 x6 alpha beta"), (2, "Émile ÉCOLE école"), (3, None), (4, "..."), (5, "nowhere to be found"), (6, "a b c d the THE the"),
    (1, "w5 x5 w6 x6 alpha beta"), (1, "other words of one"), (None, "no id at all"), (8, "again word same"),
]
MORE = ["alpha beta " * 3, "alpha", "beta beta", "Émile école", "ÉCOLE", *["the same copy of alpha"] * 30, *["the the beta w5"] * 14, "other words of one"]


@pytest.mark.parametrize("k", [1, 10])
def test_best_documents(spark, monkeypatch, k):
    docs = awkward(spark, MORE)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id bigint, text string, doc_id string, score int")
    got = sorted((tuple(x) for x in r.ranked_search(docs, items, k).collect()), key=str)
    want = brute([(x.doc_id, x.text) for x in docs.collect()], ITEMS, k)
    assert got == want and len(got) >= 6
    monkeypatch.setattr(r, "QUERY_BYTES", 40)
    assert sorted((tuple(x) for x in r.ranked_search(docs, items, k).collect()), key=str) == want


@pytest.mark.parametrize("leaf", [0, 3, 50])
def test_intervals(leaf):
    rng = np.random.default_rng(leaf)
    for _ in range(20):
        n_docs, n_terms, k = int(rng.integers(1, 60)), int(rng.integers(1, 9)), int(rng.integers(1, 6))
        rows = [sorted(rng.choice(n_terms, int(rng.integers(0, n_terms + 1)), replace=False).tolist()) for _ in range(n_docs)]
        ids = rng.permutation(n_docs).tolist()
        ends = np.cumsum([0] + [len(x) for x in rows])
        terms = np.array([t for x in rows for t in x], np.int64)
        tfs = rng.integers(1, 4, len(terms))
        sizes = rng.integers(1, 4, n_docs) * 10
        weights = rng.integers(0, 50, n_terms)
        block = r.build_block(ids, sizes, ends, terms, tfs, weights, n_docs, int(sizes.sum()))
        scores = {i: 0 for i in ids}
        for i, a, b, n in zip(ids, ends, ends[1:], sizes):
            m = 10 + 90 * int(n) * n_docs // int(sizes.sum())
            scores[i] = sum(int(weights[t]) * (10**9 * int(tf) // (1000 * int(tf) + 8 * m)) for t, tf in zip(terms[a:b], tfs[a:b]))
        top = r.Top(k)
        r.search(block, np.arange(n_terms), top, leaf)
        assert top.rows == sorted((-s, i) for i, s in scores.items() if s > 0)[:k]


def test_range_maxima():
    rng = np.random.default_rng(1)
    impacts = rng.integers(0, 5, 70)
    block = r.build_block([0], np.array([70]), np.array([0, 0]), np.array([], int), np.array([], int), np.array([], int), 1, 70)
    assert block.lists(np.array([0]))[1][0] == 0
    docs = np.arange(70)
    block = r.build_block(docs.tolist(), np.ones(70, int), np.arange(71), np.zeros(70, int), np.ones(70, int), np.array([1]), 70, 70)
    block.impacts[:] = impacts
    for k in range(1, len(block.best)):
        half = 1 << (k - 1)
        left, right = block.best[k - 1, :-half], block.best[k - 1, half:]
        block.best[k, :-half] = np.where(impacts[left] >= impacts[right], left, right)
    lo, hi = np.array([(a, b) for a in range(70) for b in range(a + 1, 71)]).T
    assert block.tops(lo, hi).tolist() == [a + int(impacts[a:b].argmax()) for a, b in zip(lo, hi)]


def test_words_and_slices(monkeypatch):
    for t in ["", "A-b_C9é É", "x\x7fy\x00z", "日本 Go", " a b"]:
        assert [w.decode() for w in common.byte_words(t.encode())] == words(t)
    monkeypatch.setattr(r, "BLOCK_POSTINGS", 2)
    lists = pa.array([[1], [], [1, 2, 3], [2], [3]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([1] * 5), lists, lists.cast(pa.list_(pa.int64()))], ["doc", "n", "terms", "tfs"])
    parts = list(r._slices(batch))
    assert [p[0] for p in parts] == [[0, 1], [2], [3, 4]] and [p[3].tolist() for p in parts] == [[1], [1, 2, 3], [2, 3]]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert r.ranked_search(empty(spark), some).count() == 0
    assert r.ranked_search(awkward(spark), none).count() == 0
    assert r.ranked_search(awkward(spark), some).columns == ["item_id", "rank", "doc_id", "score"]
