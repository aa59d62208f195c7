"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers ``floor(256 c)``.  The vectors to fit on are the distinct ones; they are found by a
grouped shuffle whose map side has already dropped repeats, so a vector that a third of all rows hold is no hot key.
Two passes over them give the sums per dimension and, centred before multiplying, the scatter matrix: every task sends
one triangle of numbers, which are added by their place.  Only matrices of dimension x dimension reach the driver.
There the covariance is factored with pivoting, P'VP = LL', and the columns of L are rotated against each other until
they are orthogonal: their norms squared are the eigenvalues, the columns divided by their norms the components.
A last pass over the fit list measures how far the whitened vectors are from unit covariance.

Rows whose vector is null, or holds a null or an entry that is not finite, are left out, and so is a row whose vector
has another length than the most frequent one (ties: the longest), as it has no place among the components.  Repeated rows
and null ids are kept as they are.  Components with no variance do not exist: one distinct vector gives no rows.  An
empty table gives no rows.  Equal eigenvalues have components in no certain order.  A deviation beyond 64 bits is
null.  Entries must stay within 2^44 (an error otherwise).  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut

SCALE = 256
_LARGEST = 1 << 44
_LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows whose vectors have finite entries only."""
    entries = F.col(vector).cast("array<double>")
    # a comparison with the largest double is false for infinities and, as NaN is the largest of all, for NaN
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c) <= F.lit(1.7976931348623157e308), F.lit(False)))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("bigint"))
    return rows.where(entries.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = np.asarray(column.flatten()).reshape(len(column), dim)
    if values.size and max(int(values.max()), -int(values.min())) > _LARGEST:
        raise OverflowError("an entry is too large for exact sums")
    return values


@dataclass
class Fit:
    """Number of vectors, sums per dimension (exact), mean, eigenvalues (falling) and components (rows)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.values)[:, None]).T


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order ``p`` and lower trapezoid ``l`` with ``v[p][:, p] = l l'``; it ends where no variance is left."""
    v, p = v.copy(), np.arange(len(v))
    left = len(v) * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    factor = np.zeros_like(v)
    for k in range(len(v)):
        best = k + int(v.diagonal()[k:].argmax())
        if v[best, best] <= left:
            return p, factor[:, :k]
        for a in (v, factor, p[:, None]):
            a[[k, best]] = a[[best, k]]
        v[:, [k, best]] = v[:, [best, k]]
        factor[k, k] = np.sqrt(v[k, k])
        factor[k + 1 :, k] = v[k + 1 :, k] / factor[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return p, factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal, longest first.

    A round rotates disjoint pairs of columns at once; in the rounds of a sweep every pair meets once.
    """
    a = factor.copy()
    width = a.shape[1]
    if width < 2:
        return a
    even = width + width % 2
    ring = np.arange(even)
    tolerance = np.finfo(float).eps * np.sqrt(len(a))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            i, j = ring[: even // 2], ring[::-1][: even // 2]
            real = (i < width) & (j < width)
            i, j = i[real], j[real]
            left, right = a[:, i], a[:, j]
            p, q, d = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            scale = np.sqrt(p * q)
            off = np.divide(np.abs(d), scale, out=np.zeros_like(d), where=scale > 0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > tolerance
            zeta = np.divide(q - p, 2 * d, out=np.zeros_like(d), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, i], a[:, j] = c * left - c * t * right, c * t * left + c * right
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= tolerance:
            break
    return a[:, np.argsort(-(a * a).sum(0), kind="stable")]


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero, falling, and unit eigenvectors as rows."""
    order, factor = pivoted_cholesky(covariance)
    rotated = one_sided_jacobi(factor)
    values = (rotated * rotated).sum(0)
    vectors = np.empty_like(rotated.T)
    vectors[:, order] = (rotated / np.sqrt(values)).T
    return values, vectors


def _sums(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([n] + total, pa.decimal128(38, 0)), pa.array(range(dim + 1), pa.int32())], ["s", "at"])

    parts = distinct.mapInArrow(add, "s decimal(38,0), at int").groupBy("at").agg(F.sum("s").alias("s"))
    found = {r["at"]: int(r["s"]) for r in parts.collect()}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dim)]


def _added(distinct: DataFrame, dim: int, shape: tuple[int, int], term) -> np.ndarray:
    """Sum over the fit list of matrices ``term(x)`` of a bounded shape, added by place after one row a place and task."""
    places = np.arange(shape[0] * shape[1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += term(_matrix(batch.column(0), dim))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total.ravel())], ["at", "s"])

    out = np.zeros(shape[0] * shape[1])
    for r in distinct.mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out.reshape(shape)


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Stored distinct vectors of the commonest length, and that length."""
    usual = vectors.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    dim = usual["dim"] if usual else 0
    return cut(vectors.where(F.size("x") == dim).select("x").distinct(), "fit"), dim


def fit(distinct: DataFrame, dim: int, most: int = 4) -> Fit:
    """The ``most`` leading components of the vectors in ``distinct`` (at most as many as have variance)."""
    n, sums = _sums(distinct, dim)
    if n == 0 or dim == 0:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((0, dim)))
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _added(distinct, dim, (dim, dim), scatter) / n
    values, vectors = components(covariance)
    found = Fit(n, sums, float(covariance.trace()), values[:most], vectors[:most])
    kept = len(found.values)
    if not kept:
        return found

    def products(x: np.ndarray) -> np.ndarray:
        w = np.hstack([found.whiten(x), np.ones((len(x), 1))])
        return w.T @ w

    moments = _added(distinct, dim, (kept + 1, kept + 1), products) / n
    centre = moments[:kept, kept]
    found.identity_error = float(np.abs(moments[:kept, :kept] - np.outer(centre, centre) - np.eye(kept)).max())
    return found


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum (n x - s)^2`` per row, exact; in machine words where they surely hold it."""
    reach = max((n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)), 1)
    if reach * reach * max(len(sums), 1) <= _LONG:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [d if d <= _LONG else None for d in exact]


def whiten(rows: DataFrame, most: int = 4, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component."""
    vectors = whole_vectors(rows, id_col, vector)
    distinct, dim = fit_list(vectors)
    found = fit(distinct, dim, most)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kept = len(found.values)
    explained = found.values / found.trace if kept else found.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            rows, whole = len(x), np.repeat(np.arange(len(x)), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(whole)), pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()),
                    pa.array(np.full(rows * kept, found.n)), pa.array([d for d in _deviations(x, found.n, found.sums) for _ in range(kept)], pa.int64()),
                    pa.array(found.whiten(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * kept, found.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    if not kept:
        return rows.sparkSession.createDataFrame([], schema)
    return vectors.where(F.size("x") == dim).mapInArrow(project, schema)
