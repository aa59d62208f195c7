"""Counts over shared neighbours and ways of two hops, by blocks of nodes.

Opening every way as a row would shuffle the sum of the squared degrees.  Here nodes are dealt into ``K`` blocks by their
number, and what travels are pieces of neighbour lists, to cells of two blocks: every edge goes to at most ``2 * K`` cells,
and the ways are opened inside a cell's task and leave it as counts.  ``K`` grows only when a cell would hold more than
``CELL_EDGES`` ends of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..functions.skew import find_hot, salted_join
from ..sources.adjacency import Adjacency, adjacency, bucketed

#: Least number of blocks; ends of edges in a cell from which on there are more blocks.
BLOCKS = 8
CELL_EDGES = 32_000_000
#: Ways opened at once in a task.
CHUNK = 4_000_000


def blocks_for(steps: int) -> int:
    """Blocks for that many directed edges: a cell sees two blocks' share of them."""
    return max(BLOCKS, -(-2 * steps // CELL_EDGES))


def _block(n: str | Column, blocks: int) -> Column:
    return F.pmod(n, F.lit(blocks)).cast("int")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start .. start + length - 1`` of all rows in a row."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most :data:`CHUNK`, or of one larger row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        yield lo, hi
        lo = hi


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column as one array, with the start and length of every row."""
    column = table.column(name).combine_chunks()
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64), np.cumsum(lengths) - lengths, lengths


def _two_hops(table: pa.Table, block: int, blocks: int) -> pa.Table:
    """``(n, walks, reached)`` of the nodes of one block into another: each row of the cell is a middle node's two lists."""
    ends, _, ends_of = _lists(table, "ends")
    far, start, length = _lists(table, "far")
    order = np.argsort(ends, kind="stable")
    node, middle = ends[order], np.repeat(np.arange(len(ends_of)), ends_of)[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = length[middle]
    walks = np.add.reduceat(sizes, first)
    reached = np.zeros(len(first), np.int64)
    entry = np.r_[first, len(node)]
    width = int(far.max()) + 1
    for lo, hi in _cuts(walks):
        at = slice(entry[lo], entry[hi])
        if hi == lo + 1 and walks[lo] > CHUNK:
            seen = np.zeros(width, bool)
            for a, b in _cuts(sizes[at]):
                part = middle[at][a:b]
                seen[far[_spans(start[part], length[part])]] = True
            reached[lo] = seen.sum()
            continue
        who = np.repeat(np.repeat(np.arange(hi - lo), np.diff(entry[lo : hi + 1])), sizes[at])
        keys = who * width + far[_spans(start[middle[at]], sizes[at])]
        keys.sort()
        fresh = keys[np.r_[True, keys[1:] != keys[:-1]]]
        reached[lo:hi] = np.bincount(fresh // width, minlength=hi - lo)
    return pa.table({"n": node[first] * blocks + block, "walks": walks, "reached": reached})


def two_hop_counts(edges: DataFrame | Adjacency) -> DataFrame:
    """``(node, walks, reached)``: ways of two hops of every node and the different nodes at their ends, itself included."""
    from .graph import numbered

    given = edges.pairs.filter(F.col("src") <= F.col("dst")) if isinstance(edges, Adjacency) else edges
    pairs, ids = numbered(given)
    steps = adjacency(pairs).pairs
    blocks = blocks_for(steps.count())
    inside = F.expr(f"int(dst div {blocks})")
    # a middle node's neighbours by block; its pieces meet each other, so no row holds a whole list
    pieces = steps.groupBy(F.col("src").alias("middle"), _block("dst", blocks).alias("block")).agg(F.sort_array(F.collect_list(inside)).alias("part"))
    pieces = bucketed(pieces, ["middle"], label="pieces")
    left = pieces.select("middle", F.col("block").alias("i"), F.col("part").alias("ends"))
    right = pieces.select("middle", F.col("block").alias("j"), F.col("part").alias("far"))
    cells = left.join(right, "middle").select("i", "j", "ends", "far")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _two_hops(table, key[0].as_py(), blocks)

    found = cells.groupBy("i", "j").applyInArrow(run, "n long, walks long, reached long")
    totals = found.groupBy("n").agg(F.sum("walks").alias("walks"), F.sum("reached").alias("reached"))
    return totals.join(ids, "n").select("node", "walks", "reached")


def _shared(pairs: pa.Table, lists: pa.Table) -> pa.Table:
    """The pairs of a cell, each once, with the size of the intersection of their ends' lists, where there is one."""
    lists = lists.sort_by("n")
    values, start, length = _lists(lists, "part")
    names = np.asarray(lists.column("n"))
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.array([], np.int64)
    names, start = names[first], start[first]
    length = np.add.reduceat(length, first) if len(first) else length
    a, b = np.asarray(pairs.column("a")), np.asarray(pairs.column("b"))
    order = np.lexsort((b, a))
    fresh = np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)][: len(order)]
    row = order[fresh]
    row = row[np.isin(a[row], names) & np.isin(b[row], names)]
    a, b = np.searchsorted(names, a[row]), np.searchsorted(names, b[row])
    # the larger list of a pair is marked, the smaller one is looked up
    large = np.where(length[a] >= length[b], a, b)
    small = a + b - large
    order = np.argsort(large, kind="stable")
    row, large, small = row[order], large[order], small[order]
    common = np.zeros(len(row), np.int64)
    marked = np.zeros(int(values.max()) + 1 if len(values) else 0, bool)
    turns = np.flatnonzero(np.r_[True, large[1:] != large[:-1]]) if len(large) else []
    for lo, hi in zip(turns, np.r_[turns[1:], len(large)].astype(int)):
        own = values[start[large[lo]] : start[large[lo]] + length[large[lo]]]
        marked[own] = True
        for x, y in _cuts(length[small[lo:hi]]):
            near = small[lo + x : lo + y]
            hits = marked[values[_spans(start[near], length[near])]]
            common[lo + x : lo + y] = np.add.reduceat(hits, np.cumsum(length[near]) - length[near], dtype=np.int64)
        marked[own] = False
    found = common > 0
    kept = pairs.select(["s", "t"]).take(pa.array(row[found]))
    return kept.append_column("common", pa.array(common[found]))


def shared_counts(edges: DataFrame | Adjacency, pairs: DataFrame) -> DataFrame:
    """``(s, t, common)``: given pairs with at least one shared neighbour and their number, each pair once.

    Only the lists of nodes in a pair travel, and only to the cells of their pairs.
    """
    from .graph import numbered

    given = edges.pairs.filter(F.col("src") <= F.col("dst")) if isinstance(edges, Adjacency) else edges
    links, ids = numbered(given)
    adj = adjacency(links)
    blocks = blocks_for(adj.steps.count())
    asked = pairs.select("s", "t")
    for end, name in (("s", "a"), ("t", "b")):
        own = ids.select(F.col("node").alias(end), F.col("n").alias(name))
        asked = salted_join(asked, own, [end], find_hot(pairs, end))
    of = [_block(c, blocks) for c in ("a", "b")]
    asked = cut(asked.withColumn("cell", F.least(*of) * blocks + F.greatest(*of)), "asked")
    wanted = asked.select("cell", F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.collect_set("cell").alias("cells"))
    # one list a node, and one a salt of a hub
    parts = adj.steps.groupBy(*adj.keys).agg(F.sort_array(F.collect_list("dst")).alias("part"))
    sent = parts.select(F.col("src").alias("n"), "part").join(wanted, "n").select(F.explode("cells").alias("cell"), "n", "part")
    kinds = dict(asked.dtypes)
    return asked.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(_shared, f"s {kinds['s']}, t {kinds['t']}, common long")
