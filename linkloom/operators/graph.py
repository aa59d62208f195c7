"""Graph primitives on an edge frame with ``src`` and ``dst`` of any orderable type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.ordering import first_rows, global_index
from ..functions.pairs import mirror, undirected_pairs
from ..functions.scratch import cut, cut_with, drop_cut, scratch_path
from ..functions.skew import find_hot, salted_join
from ..sources.adjacency import Adjacency, adjacency
from .blocks import shared_counts


def degree(edges: DataFrame) -> DataFrame:
    """Degree over distinct pairs; nodes counted map-side before the shuffle."""
    ends = undirected_pairs(edges).select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over stored (node, nb) rows."""
    if large:
        rows = mirror(pairs.select(F.col("node").alias("src"), F.col("nb").alias("dst"))).select(
            F.col("src").alias("node"), F.col("dst").alias("nb")
        )
    else:
        rows = pairs.select(F.greatest("node", "nb").alias("node"), F.least("node", "nb").alias("nb"))
    least, seen = cut_with(rows.groupBy("node").agg(F.min("nb").alias("m"), F.count(F.lit(1)).alias("rows")), "least", most=F.max("rows"))
    root = F.least("node", "m")
    hot = least.filter(F.col("rows") >= skew.HOT_ROWS).select("node") if (seen["most"] or 0) >= skew.HOT_ROWS else None
    joined = salted_join(rows, least.drop("rows"), ["node"], hot)
    if large:
        moved = joined.filter(F.col("nb") > F.col("node")).select(F.col("nb").alias("node"), root.alias("nb"))
    else:
        both = F.array(F.struct(F.col("nb").alias("node")), F.struct(F.col("node").alias("node")))
        moved = joined.select(F.explode(both).alias("e"), F.col("m").alias("nb")).select("e.node", "nb")
    return moved.filter(F.col("node") != F.col("nb")).distinct()


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges between dense numbers, and ``(node, n)`` in node order.

    Loops over text ids would sort for every minimum and shuffle the texts in every
    round; numbers are aggregated by hash.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ids = cut(global_index(nodes, [F.col("node").asc()], "n"), "ids")
    pairs = undirected_pairs(edges)
    for end in ("src", "dst"):
        by_end = ids.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
        pairs = salted_join(pairs, by_end, [end], find_hot(edges, end)).drop(end)
    return cut(pairs.select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")), "numbered"), ids


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node as component id.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the number of
    rounds grows with the logarithm of the diameter, and the rows never exceed the edges.
    It runs until a round changes nothing.
    """
    if dict(edges.dtypes)["src"] == "string":
        pairs, ids = numbered(edges)
        found = connected_components(pairs).withColumnRenamed("node", "n")
        named = ids.select(F.col("n").alias("component"), F.col("node").alias("name"))
        # the largest component may hold most nodes: its rows are spread over salts
        labelled = ids.join(found, "n").select("node", "component")
        labelled = salted_join(labelled, named, ["component"], find_hot(found, "component"))
        return labelled.select("node", F.col("name").alias("component"))
    pairs = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    state = cut(pairs.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("nb")), "cc")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    mark = None
    while True:
        middle = cut(_star(state, True), "cc")
        after, new_mark = cut_with(_star(middle, False), "cc", rows=F.count(F.lit(1)), mix=F.bit_xor(F.xxhash64("node", "nb")))
        drop_cut(state)
        drop_cut(middle)
        state = after
        if mark == new_mark:
            break
        mark = new_mark
    return nodes.join(state, "node", "left").select("node", F.coalesce("nb", "node").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def bfs(edges: DataFrame | Adjacency, sources: DataFrame, max_depth: int | None = None, target=None) -> DataFrame:
    """``(node, parent, depth)`` from all ``sources`` (one column) level by level, to the end or to ``max_depth``.

    The parent is the smallest neighbour one level up.  A neighbour of level d is in level
    d-1, d or d+1, so new nodes are checked against two levels only.  Each level is one
    table in a shared folder, so the plan stays flat however deep the search goes; the
    adjacency is dealt by node once, so a level moves only the frontier and what it finds.
    """
    (name,) = sources.columns
    if not isinstance(edges, Adjacency) and dict(edges.dtypes)["src"] == "string":
        return _bfs_by_number(edges, sources.withColumnRenamed(name, "node"), max_depth, target)
    search = Levels(adjacency(edges), sources.select(F.col(name).alias("node")).distinct(), "bfs")
    while max_depth is None or search.depth < max_depth:
        found = search.grow(target)
        if not found["n"] or found["hit"]:
            break
    return search.rows()


class Levels:
    """A breadth-first search that grows level by level; level d is a stored table ``(node, parent)``."""

    def __init__(self, adj: Adjacency, start: DataFrame, label: str):
        self.adj, self.spark, self.depth = adj, start.sparkSession, 0
        self.root = scratch_path(self.spark, label)
        self.schema = f"node {adj.id_type}, parent {adj.id_type}"
        start.select(F.col("node").cast(adj.id_type).alias("node"), F.lit(None).cast(adj.id_type).alias("parent")).write.parquet(f"{self.root}/depth=0")

    def level(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/depth={depth}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, depth int").parquet(self.root)

    def grow(self, target=None) -> dict:
        """Add a level; its number of nodes ``n``, and ``hit``, how many of them are ``target``."""
        near = self.level(self.depth).select("node")
        reach = self.adj.reach(near.withColumnRenamed("node", "src"))
        found = reach.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        if self.depth:
            near = near.union(self.level(self.depth - 1).select("node"))
        found.join(near, "node", "left_anti").write.parquet(f"{self.root}/depth={self.depth + 1}")
        self.depth += 1
        counts = self.level(self.depth).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node") == F.lit(target)).alias("hit"))
        return counts.first().asDict()

    def way_back(self, node) -> list:
        """``node`` of the last level and its parents up to a source."""
        out = [node]
        for depth in range(self.depth, 0, -1):
            out.append(self.level(depth).filter(F.col("node") == F.lit(out[-1])).first()["parent"])
        return out


def _bfs_by_number(edges: DataFrame, sources: DataFrame, max_depth: int | None, target) -> DataFrame:
    pairs, ids = numbered(edges)
    start = ids.join(sources.select("node").distinct(), "node").select("n")
    goal = None
    if target is not None:
        hit = ids.filter(F.col("node") == F.lit(target)).first()
        goal = hit["n"] if hit is not None else None
    tree = bfs(pairs, start, max_depth, goal).withColumnRenamed("node", "n")
    parents = ids.select(F.col("n").alias("parent"), F.col("node").alias("name"))
    named = salted_join(tree.join(ids, "n"), parents, ["parent"], find_hot(tree, "parent"), "left")
    lone = sources.select("node").distinct().join(ids, "node", "left_anti")
    rows = named.select("node", F.col("name").alias("parent"), "depth")
    return rows.unionByName(lone.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))


def neighborhood(edges: DataFrame, node, limit: int | None = None) -> DataFrame:
    """Distinct 1-hop neighbours of ``node``; the filter reaches the scan on both sides."""
    out = (
        edges.filter(F.col("src") == F.lit(node)).select(F.col("dst").alias("node"))
        .union(edges.filter(F.col("dst") == F.lit(node)).select(F.col("src").alias("node")))
        .distinct()
    )
    return first_rows(out, [F.col("node").asc()], limit) if limit is not None else out


def shortest_path(edges: DataFrame | Adjacency, src, dst, max_hops: int = 10) -> DataFrame:
    """``(step, node)`` rows of one undirected shortest path of at most ``max_hops`` edges.

    Two searches grow towards each other, each time the one with the smaller last level, until a new level meets the
    last level of the other: were there a shorter path, an earlier pair of levels would have met.  Of several meeting
    nodes the smallest is taken.  Parents are followed back on both sides, one row a level.
    """
    adj = adjacency(edges)
    spark = adj.steps.sparkSession
    schema = f"step int, node {adj.id_type}"
    if src == dst:
        return spark.createDataFrame([(0, src)], schema)
    sides = [Levels(adj, spark.createDataFrame([(end,)], f"node {adj.id_type}"), "path") for end in (src, dst)]
    sizes = [1, 1]
    while sides[0].depth + sides[1].depth < max_hops and min(sizes):
        one = 0 if sizes[0] <= sizes[1] else 1
        sizes[one] = sides[one].grow()["n"]
        last = [side.level(side.depth).select("node") for side in sides]
        met = last[0].join(last[1], "node", "left_semi").agg(F.min("node").alias("node")).first()["node"]
        if met is not None:
            path = sides[0].way_back(met)[::-1] + sides[1].way_back(met)[1:]
            return spark.createDataFrame(list(enumerate(path)), schema)
    return spark.createDataFrame([], schema)


def common_neighbors(edges: DataFrame | Adjacency, pairs: DataFrame) -> DataFrame:
    """Shared neighbours per given pair ``(s, t)`` as ``(s, t, node)`` rows.

    Wedges are opened only from the candidate pairs, and from the end with the smaller
    degree; the second step joins on (other end, middle), a unique key.
    """
    adj = adjacency(edges)
    size = cut(adj.degrees(), "degree")
    pairs = cut(pairs.select("s", "t"), "pairs")
    sized = salted_join(pairs, size.select(F.col("src").alias("s"), F.col("n").alias("n_s")), ["s"], find_hot(pairs, "s"))
    sized = cut(salted_join(sized, size.select(F.col("src").alias("t"), F.col("n").alias("n_t")), ["t"], find_hot(pairs, "t")), "sized")
    small_first = F.col("n_s") <= F.col("n_t")
    open_from = sized.select(
        F.when(small_first, F.col("s")).otherwise(F.col("t")).alias("src"),
        F.when(small_first, F.col("t")).otherwise(F.col("s")).alias("far"),
        "s", "t",
    )
    wedges = adj.reach(open_from).select("s", "t", "far", F.col("dst").alias("node"))
    closing = adj.pairs.select(F.col("src").alias("far"), F.col("dst").alias("node"))
    return wedges.join(closing, ["far", "node"], "left_semi").select("s", "t", "node")


def common_neighbor_counts(edges: DataFrame | Adjacency, pairs: DataFrame) -> DataFrame:
    """Pairs with at least one shared neighbour and their number; lists travel, not the shared neighbours."""
    return shared_counts(edges, pairs)


def shared_with(edges: DataFrame, a, b, limit: int = 25) -> DataFrame:
    """Shared neighbours of ``a`` and ``b`` with the number of edges to both, descending."""
    both = (
        mirror(edges.select("src", "dst"))
        .filter(F.col("src").isin(a, b))
        .groupBy(F.col("dst").alias("node"))
        .agg(F.count_if(F.col("src") == F.lit(a)).alias("to_a"), F.count_if(F.col("src") == F.lit(b)).alias("to_b"))
        .filter((F.col("to_a") > 0) & (F.col("to_b") > 0))
        .select("node", (F.col("to_a") * F.col("to_b")).alias("count"))
    )
    return first_rows(both, [F.col("count").desc(), F.col("node").asc()], limit)


def one_hop_paths(edges: DataFrame, limit: int = 500) -> DataFrame:
    """``()-[]-()`` listing: each edge is matched in both directions."""
    return first_rows(mirror(edges), [F.col("src").asc(), F.col("dst").asc(), F.col("type").asc()], limit)
