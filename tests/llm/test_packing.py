"""Packing against the tokenizer run on whole texts, and the plan against small exact cases."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from rows import awkward, empty

from linkloom.llm.packing import TextEncoder, best_fit_pack, complement_plan, default_ranks, default_vocabulary

ODD = ["a  b", " lead", "trail ", "x \n y", "tab\t here", " nbsp 　wide", "don't we'll 12 3.5", "é" * 70 + " ü", "a\x1c b", "w " * 3000]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(whole):
    encode = TextEncoder(default_vocabulary(), default_ranks())
    texts = [*ODD, "an <|endoftext|> inside", *(chr(i) + " " + chr(i) * 3 + "a" for i in range(1, 3000, 7))]
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == [whole(t) for t in texts]


def test_every_piece_has_its_place(spark, whole):
    docs = awkward(spark, ODD)
    rows = best_fit_pack(docs, max_len=64, keep_ids=True).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for d in {(d.doc_id, d.text) for d in docs.collect() if d.doc_id not in (7,)}:
        ids, own = [*whole(d[1] or ""), 2], sorted(by[d[0]], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert all(r.length == 64 for r in own[1:]) and 0 < own[0].length <= 64
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(seq) <= -(-sum(r.length for r in rows) // 64) + 2


def test_empty_table(spark):
    assert best_fit_pack(empty(spark)).count() == 0


@pytest.mark.parametrize("counts, best", [({10: 3}, 3), ({5: 4}, 2), ({6: 2, 4: 2}, 2), ({5: 1, 3: 1, 2: 1}, 1), ({4: 1, 3: 1, 2: 1, 1: 1}, 1), ({1: 25}, 3), ({7: 3, 2: 2, 1: 3, 3: 1}, 4)])
def test_plan(counts, best):
    plan = complement_plan(counts, 10)
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= 10
        for x in lengths:
            used[x] += times
    assert dict(used) == counts and sum(t for _, t in plan) == best


def test_plan_uses_random_counts_once():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 30), rng.integers(1, 400, 30))}
        used, n = defaultdict(int), 0
        for lengths, times in complement_plan(counts, 64):
            n += times
            for x in lengths:
                used[x] += times
        assert dict(used) == counts
        assert n <= 1.3 * -(-sum(k * v for k, v in counts.items()) // 64) + 1
