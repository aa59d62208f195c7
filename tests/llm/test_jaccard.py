"""Components against all pairs of sets in plain Python."""

import random
import re

import pytest
from rows import awkward, empty

from linkloom.llm import jaccard as j

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    """Sorted (id, size, component) of the rows, by union of all linked pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(str((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=50)
    texts = []
    for _ in range(12):  # families with rising numbers of edits, some just under the threshold
        base = rng.choices(vocab, k=rng.choice([6, 12, 40, 120, 300]))
        for edits in range(9):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
    near = rng.choices(vocab, k=150)
    for i in range(150):  # one large family; chains through its members count
        own = list(near)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            own[rng.randrange(150)] = f"e{i}x{rng.random()}"
        texts.append(" ".join(own))
    for i in range(120):  # a common passage in otherwise different texts
        texts.append(" ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 30, 200])) + passage + rng.choices(vocab, k=i % 4)))
    texts += ["Two  words", "two words", "TWO\twords ", "Éa b c", "éa b c", "x y z", "x y z x y z x y z"]
    return texts


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_components(spark, k, num, den, monkeypatch):
    monkeypatch.setattr(j, "HOT", 20)
    docs = awkward(spark, corpus())
    got = [r for r in j.jaccard_components(docs, k, num, den).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, num, den)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    kept = j.keep_one(docs, k, num, den)
    assert kept.columns == docs.columns
    rows = kept.collect()
    empty_rows = sum(r.n_shingles == 0 for r in got)
    assert len(rows) == len({r.group_id for r in got if r.n_shingles}) + empty_rows
    assert {r.doc_id for r in rows if shingles(r.text, k)} == {r.component_id for r in got if r.n_shingles}


def test_empty(spark):
    assert j.jaccard_components(empty(spark), 3, 9, 10).count() == 0
    assert j.keep_one(empty(spark)).count() == 0


def test_sketches_leave_out_far_pairs_and_no_link(spark):
    rng = random.Random(11)
    rows, sets = [], []
    for c in range(60):  # sets that differ from one of three in few or many tokens
        base = random.Random(c % 3)
        near = [base.getrandbits(64) - 2**63 for _ in range(150)]
        sets.append({*near[: 150 - rng.choice([0, 3, 8, 60])], *[rng.getrandbits(63) for _ in range(rng.choice([0, 2, 5, 40]))]})
        rows.append((c, len(sets[c]), sorted(sets[c])))
    searched = spark.createDataFrame(rows, "c long, n int, tokens array<long>").withColumn("sk", j.sketch(j.F.col("tokens")))
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
    sk = {r["c"]: r["sk"] for r in searched.select("c", "sk").collect()}
    for num, den in ((9, 10), (4, 5)):
        left = {(r["a"], r["b"]) for r in j.near(pairs, searched, j.Threshold(num, den)).collect()}
        linked = {(a, b) for a in range(60) for b in range(a + 1, 60) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
        assert linked and linked <= left and len(left) < 60 * 59 // 4
    for a in range(0, 60, 7):
        for b in range(60):
            assert sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sk[a], sk[b])) <= len(sets[a] ^ sets[b])
