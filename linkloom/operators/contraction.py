"""Spanning forests and components by contraction, in rounds that at least halve the nodes.

Edges carry distinct numbers.  In a round every node picks the smallest edge at it.  A picked edge belongs to the
minimum spanning forest, and its number is the new name of the nodes that picked it: of its two ends one has this name
and the other the same or a smaller one, so names point to ever smaller names until both ends agree.  Following the
pointers gives the groups of the round; edges inside a group go, of edges between the same two groups the smallest
stays, and every edge that stays still is an edge of the graph.  The number of rounds grows with the logarithm of the
nodes, whatever the length of paths, and the rows of a round are those that the one before has left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.scratch import cut, cut_with
from ..functions.skew import salted_join

#: Pointers followed in one job; longer chains take further jobs.
JUMPS = 3


@dataclass
class Contraction:
    """``chosen``: numbers of the forest's edges per round; ``names``: per round ``(node, name)`` of its nodes."""

    chosen: list[DataFrame]
    names: list[DataFrame]

    def forest(self) -> DataFrame | None:
        """``e``: numbers of the edges of the minimum spanning forest; None without any."""
        if not self.chosen:
            return None
        out = self.chosen[0]
        for part in self.chosen[1:]:
            out = out.unionByName(part)
        return out

    def groups(self) -> DataFrame | None:
        """``(node, name)``: nodes of the first round with the name of their component; None without any."""
        if not self.names:
            return None
        found = self.names[-1]
        for names in self.names[-2::-1]:
            later = found.select(F.col("node").alias("name"), F.col("name").alias("last"))
            # a large component's name is on most rows of ``found``, but as a key it is met by one row of each side
            found = names.join(later, "name", "left").select("node", F.coalesce("last", "name").alias("name"))
        return cut(found, "groups")

    def smallest(self) -> DataFrame | None:
        """``(name, least)``: the smallest node of each component, carried up from round to round; None without any."""
        found = None
        for names in self.names:
            if found is None:
                rows = names.select("name", F.col("node").alias("least"))
            else:
                later = names.select(F.col("node").alias("name"), F.col("name").alias("next"))
                rows = found.join(later, "name", "left").select(F.coalesce("next", "name").alias("name"), "least")
            found = rows.groupBy("name").agg(F.min("least").alias("least"))
        return found


def _roots(parents: DataFrame) -> DataFrame:
    """Stored ``(name, root)`` of pointers ``(name, parent)`` that end in names pointing to themselves."""
    while True:
        steps = parents
        for _ in range(JUMPS):
            steps = _followed(steps, steps).select("name", F.col("next").alias("parent"))
        # one step more tells whether all have arrived
        last = _followed(steps, parents).select("name", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved"))
        found, seen = cut_with(last, "roots", moved=F.max("moved"))
        if not seen["moved"]:
            return found.select("name", F.col("parent").alias("root"))
        parents = found.drop("moved")


def _followed(steps: DataFrame, pointers: DataFrame) -> DataFrame:
    return steps.join(pointers.select(F.col("name").alias("parent"), F.col("parent").alias("next")), "parent")


def contract(edges: DataFrame, steps: DataFrame | None = None) -> Contraction:
    """Contract stored edges ``(a, b, e)`` with distinct numbers ``e`` until none is left; loops are left out.

    ``steps``: both directions ``(a, b, e)`` of the same edges, dealt by ``a``, from which the first round is read.
    """
    chosen, names = [], []
    edges = edges.filter("a <> b")
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), "e"), F.struct(F.col("b").alias("node"), "e")))
        at_node = edges.select(ends.alias("x")).select("x.*").groupBy("node")
        if steps is not None:
            # no row has to be dealt for the picks, and none for the first end of an edge
            at_node, edges = steps.filter("a <> b").select(F.col("a").alias("node"), "e").groupBy("node"), steps.filter("a < b")
            steps = None
        picks, seen = cut_with(at_node.agg(F.min("e").alias("pick"), F.count(F.lit(1)).alias("rows")), "picks", most=F.max("rows"))
        if seen["most"] is None:
            break
        hot = picks.filter(F.col("rows") >= skew.HOT_ROWS).select("node") if seen["most"] >= skew.HOT_ROWS else None
        named = edges
        for end in ("a", "b"):
            own = picks.select(F.col("node").alias(end), F.col("pick").alias(f"pick_{end}"))
            named = salted_join(named, own, [end], hot)
        named = cut(named.select("pick_a", "pick_b", "e"), "named")
        picked = named.filter((F.col("e") == F.col("pick_a")) | (F.col("e") == F.col("pick_b")))
        roots = _roots(picked.select(F.col("e").alias("name"), F.least("pick_a", "pick_b").alias("parent")))
        chosen.append(picked.select("e"))
        names.append(picks.join(roots.withColumnRenamed("name", "pick"), "pick").select("node", F.col("root").alias("name")))
        left, hot_picks = named.filter("pick_a <> pick_b"), None if hot is None else picks.filter(F.col("rows") >= skew.HOT_ROWS).select("pick")
        for end in ("a", "b"):
            own = roots.select(F.col("name").alias(f"pick_{end}"), F.col("root").alias(end))
            left = salted_join(left, own, [f"pick_{end}"], hot_picks)
        between = left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e")
        edges = cut(between.groupBy("a", "b").agg(F.min("e").alias("e")), "between")
    return Contraction(chosen, names)


def numbered_pairs(edges: DataFrame) -> DataFrame:
    """Stored distinct ``(a, b, e)`` with ``a <= b`` and numbers as :func:`contract` needs them."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    # numbers from the places in the stored rows: the order does not matter for components
    return cut(pairs.withColumn("e", F.monotonically_increasing_id()), "numbered")


def components_by_contraction(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, nodes of loops included."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    groups = contract(numbered_pairs(edges)).groups()
    if groups is None:
        return nodes.select("node", F.col("node").alias("component"))
    least, seen = cut_with(groups.groupBy("name").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("rows")), "least", most=F.max("rows"))
    hot = least.filter(F.col("rows") >= skew.HOT_ROWS).select("name") if seen["most"] >= skew.HOT_ROWS else None
    named = salted_join(groups, least.drop("rows"), ["name"], hot).select("node", "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
