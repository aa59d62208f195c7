"""Element-wise products of the vectors of pairs of nodes.

Joined to pairs one end after the other, a vector travels once a pair.  Here pairs get the row numbers of their ends'
vectors, and meet the vectors in cells of two blocks of row numbers: a vector goes once to each cell that one of its
pairs is in.  Pairs and vectors are dealt by cell once and stored, so a solver that runs through the products several
times multiplies anew but moves nothing.
"""

from __future__ import annotations

import math
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..functions.skew import find_hot, salted_join
from ..sources.adjacency import bucketed

#: Entries of all vectors up to which they are joined to the pairs, which takes a broadcast of 16 MB.
FEW_VALUES = 2_000_000
#: Least number of blocks, and entries of the products of one cell at most; its pairs are parted if they make more.
BLOCKS = 4
CELL_VALUES = 32_000_000
#: Pairs multiplied at once.
CHUNK = 8_192


def vectors_size(emb: DataFrame) -> tuple[int, int]:
    """Number of vectors and entries of the longest."""
    told = emb.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    return told["n"], max(1, told["dim"] or 0)


def _numbered(emb: DataFrame) -> DataFrame:
    """Stored ``(__row, node, vec)``: a number for every row of ``emb``; floats stay floats, all others are doubles."""
    vec = F.col("vec") if dict(emb.dtypes)["vec"] == "array<float>" else F.col("vec").cast("array<double>")
    return cut(emb.select(F.monotonically_increasing_id().alias("__row"), "node", vec.alias("vec")), "vectors")


def _met(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored pairs with the rows ``__i`` and ``__j`` of their ends; those without both vectors are dropped."""
    for end, row in (("s", "__i"), ("t", "__j")):
        known = vectors.select(F.col("node").alias(end), F.col("__row").alias(row))
        pairs = salted_join(pairs, known, [end], find_hot(pairs, end)).select(*pairs.columns, row)
    return cut(pairs, "met")


def _block(row: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")


def products_in_cells(pairs: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """Stored ``pairs`` (``s``, ``t`` and more) with ``features``, the products of the vectors of their ends in doubles."""
    own, kinds = pairs.columns, dict(pairs.dtypes)
    vectors = _numbered(emb)
    met = _met(pairs, vectors)
    most = max(1, CELL_VALUES // dim)
    # twice as many cells as are needed, so that only nodes with very many pairs make a cell too large
    blocks = max(BLOCKS, math.isqrt(4 * met.count() // most) + 1)
    of = [_block(c, blocks) for c in ("__i", "__j")]
    pairs = met.withColumn("__cell", F.least(*of) * blocks + F.greatest(*of))
    # a few numbers, one a cell at most
    parts = pairs.groupBy("__cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__parts")).filter("__parts > 1").collect()
    large = met.sparkSession.createDataFrame([tuple(r) for r in parts], "__cell int, __parts int")
    part = F.pmod(F.xxhash64(*met.columns), F.coalesce("__parts", F.lit(1))).cast("int")
    pairs = pairs.join(F.broadcast(large), "__cell", "left").withColumn("__part", part).drop("__parts")
    keys = ["__cell", "__part"]
    pairs = bucketed(pairs.select(*keys, *met.columns), keys, label="pairs")
    wanted = pairs.select(*keys, F.explode(F.array("__i", "__j")).alias("__row")).distinct()
    sent = bucketed(wanted.join(vectors.select("__row", "vec"), "__row").select(*keys, "__row", "vec"), keys, label="sent")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", features array<double>"
    return pairs.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda p, v: _multiplied(p, v, own), schema)


def _multiplied(pairs: pa.Table, vectors: pa.Table, own: list[str]) -> pa.Table:
    """The pairs of a cell with their products."""
    names = np.asarray(vectors.column("__row"))
    order = np.argsort(names)
    i, j = (order[np.searchsorted(names, np.asarray(pairs.column(c)), sorter=order)] for c in ("__i", "__j"))
    return pairs.select(own).append_column("features", _product_lists(vectors.column("vec").combine_chunks(), i, j))


def _product_lists(vec: pa.Array, i: np.ndarray, j: np.ndarray) -> pa.Array:
    lengths = vec.value_lengths()
    dim = lengths[0].as_py() if len(vec) else 0
    values = vec.flatten()
    if not vec.null_count and not values.null_count and len(values) == len(vec) * (dim or 0) and set(lengths.unique().to_pylist()) <= {dim}:
        z = np.asarray(values).reshape(len(vec), dim)
        out = np.empty((len(i), dim))
        for lo in range(0, len(i), CHUNK):
            at = slice(lo, lo + CHUNK)
            np.multiply(z[i[at]], z[j[at]], out=out[at], dtype=np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * dim, pa.int32()), pa.array(out.ravel()))
    # as Spark has it: nothing for a vector that is missing, and nulls where an entry is
    rows = vec.to_pylist()
    times = lambda x, y: None if x is None or y is None else x * y
    found = [None if rows[a] is None or rows[b] is None else [times(x, y) for x, y in zip_longest(rows[a], rows[b])] for a, b in zip(i, j)]
    return pa.array(found, pa.list_(pa.float64()))
