"""Suffix arrays against sorting, and removal against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from rows import awkward, empty

from linkloom.llm import suffix_dedup as sd


@pytest.mark.parametrize("raw", [b"", b"a", b"banana", b"mississippi", b"aaaaaaaaaa", b"abababab", b"zyxw", b"abcd" * 40 + b"abd", bytes(random.Random(1).choices(b"ab", k=700)), bytes(random.Random(2).choices(range(1, 250), k=900)), b"a" * 300 + b"b" + b"a" * 299])
def test_suffix_array_and_prefixes(raw):
    text = np.append(np.frombuffer(raw, np.uint8), np.uint8(0))
    data = text.tobytes()
    order = sd.suffix_array(text)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    phi, common = sd.permuted_prefixes(text, order)
    for a, b in zip(want, want[1:]):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert phi[b] == a and common[b] == n


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(24)
    texts = [prose(rng.randint(0, 300)) for _ in range(20)]
    texts += [texts[3], texts[3] + "!", "!" + texts[4], texts[5] * 3]
    texts += [prose(rng.randint(0, 40)) + " " + passage + " " + prose(rng.randint(0, 40)) for _ in range(40)]
    texts += [prose(rng.randint(0, 30)) + line[: 195 + i] + prose(30) for i in range(30)]
    near = prose(200)
    for _ in range(25):
        words = near.split(" ")
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts + ["x" * 199, "x" * 200, "y" * 201, "ab" * 150, "z" * 1000, "\x00" * 250]


@pytest.mark.parametrize("hot, block", [(2000, 1 << 20), (3, 1500)])
def test_removal(spark, monkeypatch, hot, block):
    for name, value in (("HOT", hot), ("BLOCK", block)):
        monkeypatch.setattr(sd, name, value)
    docs = awkward(spark, corpus())
    rows = docs.collect()
    want = sorted(str((r.doc_id, *x)) for r, x in zip(rows, brute([r.text for r in rows])))
    got = sd.remove_repeats(docs).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark):
    assert sd.remove_repeats(empty(spark)).count() == 0
