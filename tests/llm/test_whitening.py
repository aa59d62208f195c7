"""Whitening against an eigensolver and whole-number sums in plain Python."""

import math

import numpy as np
import pytest

from linkloom.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2) for i, v in vectors], SCHEMA)


def plain(vectors, most=4):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    usual = max({len(x) for _, x in good}, key=lambda d: (sum(len(x) == d for _, x in good), d))
    good = [(i, x) for i, x in good if len(x) == usual]
    distinct = sorted({tuple(x) for _, x in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    a = np.array(distinct, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-values)[:most]
    out = {}
    for i, x in good:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k, o in enumerate(order, 1):
            out.setdefault((i, k), []).append((n, dev, (np.array(x) - np.array(sums) / n) @ vectors[:, o] / math.sqrt(values[o]), values[o] / values.sum()))
    return out


def test_whitened(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 7)) * np.array([5, 3, 2, 1, 0.5, 0.2, 0.1])
    vectors = list(enumerate((base @ np.linalg.qr(rng.normal(size=(7, 7)))[0]).tolist()))
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)] + [(0, vectors[0][1]), (None, vectors[5][1])]
    vectors += [(2000, None), (2001, [None] * 7), (2002, [math.nan] + [0.0] * 6), (2003, [math.inf] * 7), (2004, [-math.inf] + [1.0] * 6), (2005, [1.0]), (2006, [])]
    got = {}
    for r in w.whiten(frame(spark, vectors)).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
        assert 0 <= r.identity_error < 1e-10
    want = plain(vectors)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    signs = {k: np.sign(got[0, k][0].whitened * want[0, k][0][2]) for k in range(1, 5)}
    for (i, k), rows in got.items():
        for r, (n, dev, value, share) in zip(rows, want[i, k]):
            assert (r.n, r.deviation) == (n, dev)
            assert r.whitened * signs[k] == pytest.approx(value, abs=1e-8) and r.explained == pytest.approx(share, rel=1e-9)


def test_few_components(spark):
    line = [(i, [i, 2 * i, -i]) for i in range(9)]
    rows = w.whiten(frame(spark, line)).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 9
    assert sum(r.whitened**2 for r in rows) / 9 == pytest.approx(1) and rows[0].explained == pytest.approx(1)
    assert w.whiten(frame(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert w.whiten(frame(spark, [(1, []), (2, None)])).count() == 0
    assert w.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("dim", [1, 2, 5, 24, 65])
def test_factor_and_rotations(dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(dim, max(dim - 2, 1))) * np.geomspace(1, 1e-3, max(dim - 2, 1))
    v = a @ a.T
    order, factor = w.pivoted_cholesky(v)
    assert np.allclose(np.triu(factor, 1), 0) and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12)
    values, vectors = w.components(v)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-8)
    assert np.allclose((vectors.T * values) @ vectors, v, atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=1e-6, atol=1e-14)


def test_exact_deviation():
    x = np.array([[3, -4], [1 << 40, 5]])
    assert w._deviations(x[:1], 10, [7, 9]) == [(30 - 7) ** 2 + (-40 - 9) ** 2]
    assert w._deviations(x, 1, [0, 0])[1] is None
    assert w._deviations(np.array([[1 << 20]]), 1 << 11, [5]) == [((1 << 31) - 5) ** 2]
