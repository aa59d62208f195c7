"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is an embedding of the word and the mean of embeddings of its character n-grams (both
hashed).  Two gated recurrent units read a window of ``STEPS`` words from either side, attention weighs
their states, a logistic unit scores the window.  A window begins every ``STRIDE`` words of a text, so
each shares 24 words with the next, and all are scored; the text's score is the highest.

The network is fitted on a bounded sample of labelled rows (``POSITIVE`` and ``NEGATIVE`` texts of at
most ``SAMPLE_BYTES``) by Adam.  A label holds for a text, not a window, so each round trains on the
windows of a toxic text that score highest so far and on all kinds of windows of the others, the worst
ones among them; the first round goes by the log-odds of the n-grams, which also start the embedding.

Null and empty texts, and texts without a word, score 0.  Null and repeated ids are kept as rows; an
empty table gives an empty result; without labels of both kinds every text scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

STEPS, HIDDEN, ATTENTION = 32, 8, 8
#: Words from one window to the next: scored texts (a passage of up to 25 words stands whole in one window), and texts of the sample.
STRIDE, TRAIN_STRIDE = 8, 16
WORD_ROWS, WORD_DIM, GRAM_ROWS, GRAM_DIM = 1 << 13, 6, 1 << 15, 10
GRAMS = (3, 4, 5, 6, 7)
POSITIVE, NEGATIVE, SAMPLE_BYTES = 1200, 1800, 12_000
EPOCHS, MIN_STEPS, BATCH, RATE = 6, 150, 256, 0.015
THRESHOLD = 0.3
INPUT = WORD_DIM + GRAM_DIM

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of several texts: places per text, and hashed word and n-gram rows of the distinct ones."""

    def __init__(self, texts: list[str]):
        raw = "\n".join([t.lower() for t in texts]).encode("utf-8", "replace")
        data = np.frombuffer(b" " + raw + b" ", np.uint8)
        letter = _LETTER[data]
        edge = np.flatnonzero(np.diff(letter.astype(np.int8)))
        start, stop = edge[::2] + 1, edge[1::2] + 1
        lengths = np.array([len(t.lower().encode("utf-8", "replace")) + 1 for t in texts])
        text_end = np.cumsum(lengths) + 1
        self.counts = np.bincount(np.searchsorted(text_end, start, side="right"), minlength=len(texts))[: len(texts)]
        # hashes of any stretch, from running sums of bytes times powers
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(data), _BASE))])
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(data), inverse))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        hashed = lambda a, b: _mixed((sums[b] - sums[a]) * down[a])
        whole = hashed(start, stop) if len(start) else np.zeros(0, np.uint64)
        _, first, self.which = np.unique(whole, return_index=True, return_inverse=True)
        self.word_row = (whole[first] % np.uint64(WORD_ROWS)).astype(np.int64)
        # a word's n-grams run from the break before it to the break after it
        a, b = start[first] - 1, stop[first] + 1
        rows, owner = [], []
        for n in GRAMS:
            many = np.maximum(b - a - n + 1, 0)
            own = np.repeat(np.arange(len(first)), many)
            at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + a[own]
            begin = (at == a[own]).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
            body = hashed(np.maximum(at, a[own] + 1), np.minimum(at + n, b[own] - 1))  # without the breaks, whatever they are
            end = (at + n == b[own]).astype(np.uint64) * np.uint64(0x14057B7EF767814F)
            rows.append((_mixed(body ^ begin ^ end ^ np.uint64(n)) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owner.append(own)
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.gram_row, self.gram_owner = rows[order], owner[order]
        self.gram_count = np.maximum(np.bincount(self.gram_owner, minlength=len(first)), 1)
        self.distinct = len(first)

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Matrix of distinct-word numbers (``distinct``: nothing there) by window, and the text of each window."""
        first = np.cumsum(self.counts) - self.counts
        many = np.where(self.counts == 0, 0, np.maximum(-(-(self.counts - STEPS) // stride) + 1, 1))
        text = np.repeat(np.arange(len(self.counts)), many)
        k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.minimum(k * stride, np.maximum(self.counts[text] - STEPS, 0))
        inside = begin[:, None] + np.arange(STEPS)[None, :]
        padded = np.append(self.which, self.distinct)
        place = np.where(inside < self.counts[text][:, None], first[text][:, None] + inside, len(self.which))
        return padded[place], text

    def summed(self, per_gram: np.ndarray) -> np.ndarray:
        """Sums over the n-grams of each distinct word (they stand in the order of the words)."""
        many = np.bincount(self.gram_owner, minlength=self.distinct)
        begin = np.cumsum(many) - many
        if not len(per_gram):
            return np.zeros((self.distinct, per_gram.shape[1]), per_gram.dtype)
        out = np.add.reduceat(per_gram, np.minimum(begin, len(per_gram) - 1), axis=0)
        out[many == 0] = 0
        return out


Parameters = dict[str, np.ndarray]


def fresh(seed: int = 7) -> Parameters:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    p = {"word": normal(WORD_ROWS, WORD_DIM, scale=0.05), "gram": normal(GRAM_ROWS, GRAM_DIM, scale=0.05)}
    for side in ("f", "b"):
        p["W" + side] = normal(INPUT, 3 * HIDDEN, scale=0.4)
        p["U" + side] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
        p["c" + side] = np.zeros(3 * HIDDEN, np.float32)
    p["A"] = normal(2 * HIDDEN, ATTENTION, scale=0.4)
    p["a"] = normal(ATTENTION, scale=0.5)
    p["o"] = normal(2 * HIDDEN, scale=0.5)
    p["bias"] = np.full(1, -2.0, np.float32)
    return p


def inputs(p: Parameters, words: Words) -> np.ndarray:
    """Input vector of each distinct word, and zeros for none."""
    grams = words.summed(p["gram"][words.gram_row]) / words.gram_count[:, None]
    both = np.concatenate([p["word"][words.word_row], grams.astype(p["word"].dtype)], axis=1)
    return np.concatenate([both, np.zeros((1, INPUT), both.dtype)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(projected: np.ndarray, u: np.ndarray, there: np.ndarray | None, keep: bool):
    """States after each step (step, window, hidden), and what the way back needs."""
    steps, n = projected.shape[:2]
    h = np.zeros((n, HIDDEN), projected.dtype)
    states, trace = np.empty((steps, n, HIDDEN), projected.dtype), []
    for t in range(steps):
        x, hu = projected[t], h @ u
        gates = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        after = new + z * (h - new)
        if there is not None:
            after = np.where(there[t][:, None], after, h)
        if keep:
            trace.append((h, hu, z, r, new))
        h = states[t] = after
    return states, trace


def forward(p: Parameters, vectors: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logit of each window (and what the gradient needs)."""
    none = len(vectors) - 1
    there = (windows != none).T
    mask = None if there.all() else there
    read = {}
    for side, order in (("f", slice(None)), ("b", slice(None, None, -1))):
        projected = vectors @ p["W" + side] + p["c" + side]
        read[side] = _read(projected[windows.T[order]], p["U" + side], None if mask is None else mask[order], keep)
    states = np.concatenate([read["f"][0], read["b"][0][::-1]], axis=2)
    hidden = np.tanh(states @ p["A"])
    energy = hidden @ p["a"]
    if mask is not None:
        energy = np.where(there, energy, -1e9)
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    logit = pooled @ p["o"] + p["bias"][0]
    return (logit, (there, mask, read, states, hidden, weight, pooled)) if keep else logit


def backward(p: Parameters, words: Words, vectors: np.ndarray, windows: np.ndarray, target: np.ndarray, weights: np.ndarray) -> tuple[float, Parameters]:
    """Mean weighted log-loss of the windows and its gradient."""
    logit, (there, mask, read, states, hidden, weight, pooled) = forward(p, vectors, windows, True)
    n = len(logit)
    loss = float((weights * (np.logaddexp(0, logit) - target * logit)).mean())
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = (weights * (_sigmoid(logit) - target) / n).astype(states.dtype)
    g["bias"][0], g["o"] = d.sum(), pooled.T @ d
    d_pooled = d[:, None] * p["o"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(axis=2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["a"] = np.tensordot(hidden, d_energy, axes=([0, 1], [0, 1]))
    d_hidden = d_energy[:, :, None] * p["a"] * (1 - hidden**2)
    g["A"] = np.tensordot(states, d_hidden, axes=([0, 1], [0, 1]))
    d_states = d_states + d_hidden @ p["A"].T
    d_vectors = np.zeros_like(vectors)
    for side, order, part in (("f", slice(None), slice(0, HIDDEN)), ("b", slice(None, None, -1), slice(HIDDEN, None))):
        u, trace, own = p["U" + side], read[side][1], d_states[order, :, part]
        seen = None if mask is None else mask[order]
        d_h, d_projected = np.zeros((n, HIDDEN), states.dtype), np.empty((STEPS, n, 3 * HIDDEN), states.dtype)
        for t in range(STEPS - 1, -1, -1):
            h, hu, z, r, new = trace[t]
            d_after = d_h + own[t]
            live = d_after if seen is None else np.where(seen[t][:, None], d_after, 0)
            d_new = live * (1 - z) * (1 - new**2)
            d_z = live * (h - new) * z * (1 - z)
            d_r = d_new * hu[:, 2 * HIDDEN :] * r * (1 - r)
            d_projected[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g["U" + side] += h.T @ d_hu
            d_h = live * z + d_hu @ u.T
            if seen is not None:
                d_h = d_h + np.where(seen[t][:, None], 0, d_after)
        flat, which = d_projected.reshape(-1, 3 * HIDDEN), windows.T[order].reshape(-1)
        by_word = np.stack([np.bincount(which, weights=flat[:, k], minlength=len(vectors)) for k in range(flat.shape[1])], axis=1).astype(vectors.dtype)
        g["W" + side], g["c" + side] = vectors.T @ by_word, by_word.sum(axis=0)
        d_vectors += by_word @ p["W" + side].T
    d_vectors = d_vectors[:-1]
    used = np.flatnonzero(np.abs(d_vectors).sum(axis=1))
    for k in range(WORD_DIM):
        g["word"][:, k] = np.bincount(words.word_row[used], weights=d_vectors[used, k], minlength=WORD_ROWS)
    per_word = d_vectors[:, WORD_DIM:] / words.gram_count[:, None]
    owner = words.gram_owner
    active = np.zeros(words.distinct, bool)
    active[used] = True
    pick = active[owner]
    for k in range(GRAM_DIM):
        g["gram"][:, k] = np.bincount(words.gram_row[pick], weights=per_word[owner[pick], k], minlength=GRAM_ROWS)
    return loss, g


def _top(scores: np.ndarray, text: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` best windows of each wanted text."""
    order = np.lexsort((-scores, text))
    of = text[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of, side="left")
    return order[(rank < most) & wanted[of]]


#: Per way through the windows: projected inputs of the words (word, gate); weights of the next gates, of attention and of the score on a state.
Ways = list[tuple[np.ndarray, np.ndarray]]


def _ways(p: Parameters, vectors: np.ndarray) -> Ways:
    out = []
    for name, own in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        on_state = np.concatenate([p["U" + name], p["A"][own], p["o"][own, None]], axis=1)
        out.append((vectors @ p["W" + name] + p["c" + name], np.ascontiguousarray(on_state.T)))
    return out


def logits(p: Parameters, ways: Ways, windows: np.ndarray) -> np.ndarray:
    """:func:`forward` without a way back: windows stand last in every array, so that a step runs over long rows, and
    a state leaves only its attention and its share of the score."""
    n, gates = len(windows), 3 * HIDDEN
    steps = np.ascontiguousarray(windows.T)
    there = steps != len(ways[0][0]) - 1
    mask = None if there.all() else there
    parts = np.zeros((STEPS, ATTENTION + 1, n), ways[0][0].dtype)
    for (table, on_state), order in zip(ways, (1, -1), strict=True):
        h, part = np.zeros((HIDDEN, n), table.dtype), np.zeros((len(on_state), n), table.dtype)
        for t in range(STEPS)[::order]:
            x = np.ascontiguousarray(table.take(steps[t], axis=0).T)
            x[: 2 * HIDDEN] += part[: 2 * HIDDEN]
            both = _sigmoid(x[: 2 * HIDDEN])
            new = np.tanh(x[2 * HIDDEN :] + both[HIDDEN:] * part[2 * HIDDEN : gates])
            after = new + both[:HIDDEN] * (h - new)
            h = after if mask is None else np.where(mask[t], after, h)
            part = on_state @ h
            parts[t] += part[gates:]
    energy = np.tensordot(np.tanh(parts[:, :ATTENTION]), p["a"], axes=([1], [0]))
    if mask is not None:
        energy = np.where(mask, energy, -1e9)
    weight = np.exp(energy - energy.max(axis=0))
    return (weight * parts[:, ATTENTION]).sum(axis=0) / weight.sum(axis=0) + p["bias"][0]


def window_scores(p: Parameters, vectors: np.ndarray, windows: np.ndarray, at_once: int = 1024) -> np.ndarray:
    out, ways = np.empty(len(windows), np.float32), _ways(p, vectors)
    short = (windows[:, -1] == len(vectors) - 1) if len(windows) else np.zeros(0, bool)
    for group in (np.flatnonzero(~short), np.flatnonzero(short)):  # full windows need no mask
        for i in range(0, len(group), at_once):
            rows = group[i : i + at_once]
            out[rows] = _sigmoid(logits(p, ways, windows[rows]))
    return out


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Parameters | None:
    labels = np.array(toxic, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    words = Words(texts)
    windows, text = words.windows(TRAIN_STRIDE)
    if not len(windows):
        return None
    rng, p = np.random.default_rng(seed), fresh(seed)
    # log-odds of n-grams by texts
    word_text = np.repeat(np.arange(len(texts)), words.counts)
    pairs = np.unique(word_text.astype(np.int64) * words.distinct + words.which)
    seen_text, seen_word = pairs // words.distinct, pairs % words.distinct
    many = np.bincount(words.gram_owner, minlength=words.distinct)
    first = np.cumsum(many) - many
    counts = np.zeros((2, GRAM_ROWS))
    for label in (0, 1):
        own = seen_word[labels[seen_text] == label]
        spread = np.repeat(first[own] - (np.cumsum(many[own]) - many[own]), many[own]) + np.arange(many[own].sum())
        counts[label] = np.bincount(words.gram_row[spread], minlength=GRAM_ROWS)
    share = (counts + 0.5) / (np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None] + 1)
    odds = np.clip(np.log(share[1] / share[0]), -3, 3) * (counts.sum(axis=0) > 3)
    p["gram"][:, 0] = odds * 0.5
    guess = np.append(words.summed(odds[words.gram_row][:, None])[:, 0] / words.gram_count, -9.0)
    scores = guess[windows].max(axis=1)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    a_round = -(-(int((labels == 1).sum()) + 2 * int((labels == 0).sum())) // BATCH)
    epochs = max(epochs, -(-MIN_STEPS // a_round))  # few labels: more rounds
    for epoch in range(epochs):
        if epoch:
            scores = window_scores(p, inputs(p, words), windows)
        bad = _top(scores, text, labels == 1, 1)
        worst = _top(scores, text, labels == 0, 2)
        others = rng.permutation(np.flatnonzero(labels[text] == 0))[: len(worst)]
        chosen = rng.permutation(np.concatenate([bad, worst, others]))
        target = labels[text[chosen]]
        for i in range(0, len(chosen), BATCH):
            rows = windows[chosen[i : i + BATCH]]
            own = np.unique(rows)
            own = own[own < words.distinct]
            small = _subset(words, own)
            local = np.full(words.distinct + 1, len(own))
            local[own] = np.arange(len(own))
            y = target[i : i + BATCH]
            _, g = backward(p, small, inputs(p, small), local[rows], y, np.where(y == 1, 2.0, 1.0).astype(np.float32))
            step += 1
            rate = RATE * (0.3 if epoch >= epochs * 0.7 else 1.0)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= rate * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + 1e-4 * p[k])
    return p


def _subset(words: Words, own: np.ndarray) -> Words:
    """The distinct words ``own`` only."""
    small = object.__new__(Words)
    many = np.bincount(words.gram_owner, minlength=words.distinct)
    first = (np.cumsum(many) - many)[own]
    take = np.repeat(first - (np.cumsum(many[own]) - many[own]), many[own]) + np.arange(many[own].sum())
    small.distinct, small.word_row, small.gram_row = len(own), words.word_row[own], words.gram_row[take]
    small.gram_owner, small.gram_count = np.repeat(np.arange(len(own)), many[own]), words.gram_count[own]
    return small


def text_scores(p: Parameters | None, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    if p is None or not texts:
        return out
    words = Words(texts)
    windows, text = words.windows()
    if len(windows):
        np.maximum.at(out, text, window_scores(p, inputs(p, words), windows))
    return out


# -- the jobs ---------------------------------------------------------------------------------------
def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> tuple[list[str], list[int]]:
    """Texts and labels of rows that are not held out; at most so many of either kind, taken by hash; ids with both labels are left out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    known = known.where("lo = hi").where(~held_out()).select(F.col("doc_id").alias("__id"), (F.col("lo") == 1).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("o"))
    # twice as many ids as texts, since long texts are left out
    ids = known.where("toxic = 1").orderBy("o", "__id").limit(2 * positive).unionByName(known.where("toxic = 0").orderBy("o", "__id").limit(2 * negative))
    rows = docs.select(F.col("doc_id").alias("__id"), text_column().alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "__id")
    texts: list[str] = []
    toxic: list[int] = []
    for label, most in ((1, positive), (0, negative)):
        for r in rows.where(F.col("toxic") == label).orderBy("o", "__id", "text").limit(most).select("text").collect():
            texts.append(r["text"])
            toxic.append(label)
    return texts, toxic


def score(docs: DataFrame, model: Parameters | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``."""
    rows = docs.select("doc_id", held_out().alias("held_out"), text_column().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) < 1_000_000):
                    size, to = size + len(texts[to]), to + 1
                found = text_scores(model, texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )
                at = to

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
