"""The network's gradient against differences, its windows against slices, and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
from rows import TEXTS, awkward, empty

from linkloom.llm import toxicity as t


def prose(rng, n, bad=()):
    words = ["".join(rng.choices(["an", "the", "in", "or", "él", "tion", "re"], k=rng.randint(1, 3))) for _ in range(n)]
    for b in bad:
        words.insert(rng.randrange(len(words) + 1), b)
    return " ".join(words)


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = int(i % 3 == 0)
        bad = [rng.choice(["idiot", "Worthless!", "scumbag", "SCUMMY", "rotten" + rng.choice(["an", "re", "tion"])]) for _ in range(rng.randint(1, 3))] if toxic else []
        out.append((prose(rng, rng.choice([3, 20, 90, 300]), bad), toxic))
    return out


def test_words_and_windows():
    texts = ["", "One two", "été Ünd!! a1-b2", " ".join(f"w{i}" for i in range(100)), "...", " ".join(f"v{i}" for i in range(33))]
    words = t.Words(texts)
    split = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", x.lower()) for x in texts]
    assert words.counts.tolist() == [len(x) for x in split]
    windows, text = words.windows()
    flat = [w for x in split for w in x]
    name = {int(k): w for k, w in zip(words.which, flat)}
    assert len(name) == len(set(flat)) == words.distinct
    seen = {i: [] for i in range(len(texts))}
    for row, of in zip(windows, text):
        seen[int(of)].append([name[int(k)] for k in row if k != words.distinct])
    for i, own in enumerate(split):
        if not own:
            assert seen[i] == []
        elif len(own) <= t.STEPS:
            assert seen[i] == [own]
        else:
            assert all(w in [own[k : k + t.STEPS] for k in range(len(own))] for w in seen[i])
            assert {w for x in seen[i] for w in x} == set(own) and seen[i][-1] == own[-t.STEPS :]


def test_alone_or_together():
    texts = [x for x, _ in labelled(30, 3)] + ["", "x"]
    p = t.fresh()
    together = t.text_scores(p, texts)
    assert np.allclose(together, [t.text_scores(p, [x])[0] for x in texts], atol=1e-5)


def test_gradient():
    texts = [x for x, _ in labelled(6, 1)]
    words = t.Words(texts)
    windows, _ = words.windows()
    windows = windows[[0, 1, len(windows) // 2, -1]]
    p = {k: v.astype(np.float64) for k, v in t.fresh().items()}
    y, w = np.array([1.0, 0, 1, 0]), np.array([2.0, 1, 2, 1])
    loss = lambda: t.backward(p, words, t.inputs(p, words), windows, y, w)[0]
    _, g = t.backward(p, words, t.inputs(p, words), windows, y, w)
    for k, value in p.items():
        flat, grad = value.reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:6]:
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-6 + 1e-4 * abs(grad[i]), k


@pytest.fixture(scope="module")
def model():
    rows = labelled(360, 5)
    return t.train([x for x, _ in rows], [y for _, y in rows])


def test_held_out_accuracy(model):
    rows = labelled(200, 99)
    got = t.text_scores(model, [x for x, _ in rows]) >= t.THRESHOLD
    assert (got == np.array([y for _, y in rows], bool)).mean() > 0.95


def test_late_word_counts(model):
    rng = random.Random(4)
    long = prose(rng, 4000)
    low, high = t.text_scores(model, [long, long + " such a worthless idiot"])
    assert high > 0.5 > low


def test_table(spark, model):
    docs = awkward(spark, ["such a worthless idiot scumbag", "an the in or"])
    rows = t.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by = {r.doc_id: r.score for r in rows}
    assert by[100] > 0.5 and all(by[i] == 0 for i, x in enumerate(TEXTS) if not (x or "").strip())
    assert t.score(empty(spark), None).count() == 0


def test_sample(spark):
    docs = awkward(spark, [x for x, _ in labelled(40, 2)])
    labels = spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (3, 1, None), (4, 1, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    texts, toxic = t.labelled_sample(docs, labels)
    inside = [i for i in range(40) if zlib.crc32(str(100 + i).encode()) % 4 != 2]
    assert len(texts) == len(inside) and sum(toxic) == sum(i % 3 == 0 for i in inside)
    assert t.labelled_sample(docs, labels.limit(0)) == ([], []) and t.train([], []) is None
    assert len(t.labelled_sample(docs, labels, 2, 3)[0]) == 5


def test_passages_at_every_offset(model):
    rng = random.Random(8)
    long = prose(rng, 200).split()
    passage = prose(rng, 24).split()
    passage[3], passage[9] = "worthless", "idiot"
    base = t.text_scores(model, [" ".join(long)])[0]
    assert base < t.THRESHOLD
    for size in range(10, 25):
        own = [f"p{i}" for i in range(size)]
        words = t.Words([" ".join(long[:at] + own + long[at:]) for at in range(len(long) + 1)])
        windows, text = words.windows()
        first = np.cumsum(words.counts) - words.counts
        whole = (np.isin(windows, words.which[first[0] : first[0] + size])).sum(axis=1) == size
        assert set(text[whole]) == set(range(len(long) + 1)), size
    for size in (10, 17, 24):
        scores = t.text_scores(model, [" ".join(long[:at] + passage[:size] + long[at:]) for at in range(len(long) + 1)])
        assert scores.min() >= t.THRESHOLD, size


def test_scores_without_a_way_back_are_those_of_the_training_pass():
    rng = np.random.default_rng(3)
    p = t.fresh(5)
    vectors = np.concatenate([rng.normal(size=(40, t.INPUT)), np.zeros((1, t.INPUT))]).astype(np.float32)
    windows = rng.integers(0, 40, size=(50, t.STEPS))
    windows[::5, -1] = 40
    for i in range(0, 50, 10):  # texts shorter than a window
        windows[i, 1 + i // 2 :] = 40
    expected = t.forward(p, vectors, windows)
    assert np.abs(t.logits(p, t._ways(p, vectors), windows) - expected).max() < 1e-5
    full = windows[(windows != 40).all(axis=1)]
    assert np.abs(t.logits(p, t._ways(p, vectors), full) - t.forward(p, vectors, full)).max() < 1e-5
    scores = t.window_scores(p, vectors, windows, at_once=7)
    assert scores.dtype == np.float32 and np.abs(scores - 1 / (1 + np.exp(-expected))).max() < 1e-5
