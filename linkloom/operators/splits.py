"""Train / validation / test splits: random, connectivity-preserving and temporal."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60
from ..functions.ordering import global_index
from ..functions.pairs import canonical, out_of_order, packable, packed, unpacked
from ..functions.scratch import cut
from ..functions.skew import find_hot, salted_join
from ..sources.adjacency import adjacency_of
from .contraction import components_by_contraction, contract, numbered_pairs
from .graph import bfs, component_sizes, mirror, numbered, undirected_pairs

SETS = ("train", "val", "test")


def _share(x: float | None) -> float:
    return max(0.0, min(1.0, float(x or 0.0)))


def split_sizes(total: int, test: float, val: float | None) -> tuple[int, int]:
    """Pairs in test and validation: floors of the shares, validation cut to the rest."""
    k_test = math.floor(total * _share(test))
    return k_test, max(0, min(total - k_test, math.floor(total * _share(val))))


def _draw_order(seed: int | str) -> list[Column]:
    return [hash60(str(seed), F.col("src"), F.col("dst")), F.col("src"), F.col("dst")]


def _bands(place: Column, k_test: int, k_val: int) -> Column:
    return F.when(place < k_test, "test").when(place < k_test + k_val, "val").otherwise("train")


def random_split(edges: DataFrame, test: float, val: float | None = None, seed: int | str = 42) -> DataFrame:
    """``(src, dst, set)`` with exact sizes; test is drawn first, then validation."""
    pairs = undirected_pairs(edges)
    ranked = global_index(pairs, _draw_order(seed), "place")
    k_test, k_val = split_sizes(ranked.count(), test, val)
    return ranked.select("src", "dst", _bands(F.col("place"), k_test, k_val).alias("set"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """BFS tree edges of every component from its smallest node, in canonical direction."""
    text = dict(edges.dtypes)["src"] == "string"
    fits = F.min(packable("src", "dst") if text else F.lit(False))
    seen = out_of_order(edges.select("src", "dst")).agg(
        F.max("swapped").alias("swapped"), fits.alias("packable"),
        F.max(F.greatest(F.length(F.col("src").cast("string")), F.length(F.col("dst").cast("string")))).alias("places"),
    ).first()
    if seen["packable"]:
        # the texts' order without a table of numbers, which every pair would have to visit on both ways
        number = lambda c: packed(F.col(c), seen["places"]).alias(c)
        tree = _levels_tree(edges.select(number("src"), number("dst")))
        tree = tree.select(unpacked(F.col("src")).alias("src"), unpacked(F.col("dst")).alias("dst"))
    elif text:
        numbers, ids = numbered(edges)
        tree = _levels_tree(numbers)
        for end in ("src", "dst"):
            by_end = ids.select(F.col("n").alias(end), F.col("node").alias(f"name_{end}"))
            tree = salted_join(tree, by_end, [end], find_hot(numbers, end)).drop(end)
        tree = tree.select(F.col("name_src").alias("src"), F.col("name_dst").alias("dst"))
    else:
        tree = _levels_tree(edges)
    # tree edges are edges: where all of these are canonical, the rule tells the direction
    return undirected_pairs(edges).join(mirror(tree), ["src", "dst"], "left_semi") if seen["swapped"] else canonical(tree)


def _levels_tree(edges: DataFrame) -> DataFrame:
    """``(src, dst)``: every node that is not the smallest of its component, and its parent."""
    pairs = numbered_pairs(edges)
    adj = adjacency_of(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "e"))
    least = contract(pairs, adj.steps.select(F.col("src").alias("a"), F.col("dst").alias("b"), "e")).smallest()
    roots = adj.pairs.select(F.col("src").alias("node")).limit(0) if least is None else least.select(F.col("least").alias("node"))
    return bfs(adj, roots).filter(F.col("parent").isNotNull()).select(F.col("node").alias("src"), F.col("parent").alias("dst"))


def drawn_forest(edges: DataFrame, seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """Stored distinct pairs ``(src, dst, e)`` with their place in draw order, and those of the spanning forest that
    prefers early places (the only minimum spanning forest under this order).

    Contraction takes a logarithmic number of rounds, also on long paths.
    """
    ranked = cut(global_index(undirected_pairs(edges), _draw_order(seed), "e"), "drawn")
    numbers = contract(ranked.select(F.col("src").alias("a"), F.col("dst").alias("b"), "e")).forest()
    return ranked, ranked.limit(0) if numbers is None else ranked.join(numbers, "e", "left_semi").select("src", "dst", "e")


def connected_split(
    edges: DataFrame, test: float, val: float | None = None, seed: int | str = 42, forest: str = "drawn"
) -> DataFrame:
    """Spanning forest to train; test, then validation, from the other pairs by draw order.

    ``forest``: ``drawn`` (see :func:`drawn_forest`) or ``levels`` (the shortest-path trees of :func:`spanning_forest`).
    """
    return _connected(edges, test, val, seed, forest)[0]


def _connected(edges: DataFrame, test: float, val: float | None, seed: int | str, forest: str = "drawn") -> tuple[DataFrame, DataFrame]:
    """:func:`connected_split` and its stored forest."""
    if forest == "drawn":
        pairs, tree = drawn_forest(edges, seed)
        tree = cut(tree, "forest")
        ranked = global_index(pairs.join(tree.select("e"), "e", "left_anti"), [F.col("e").asc()], "place")
    elif forest == "levels":
        pairs = cut(undirected_pairs(edges), "pairs")
        tree = cut(spanning_forest(pairs), "forest")
        ranked = global_index(pairs.join(tree, ["src", "dst"], "left_anti"), _draw_order(seed), "place")
    else:
        raise ValueError(f"unknown forest '{forest}'")
    k_test, k_val = split_sizes(pairs.count(), test, val)
    rest = ranked.select("src", "dst", _bands(F.col("place"), k_test, k_val).alias("set"))
    return rest.unionByName(tree.select("src", "dst", F.lit("train").alias("set"))), tree


def stitch_components(edges: DataFrame) -> DataFrame:
    """Invented edges from every other component's smallest node to the largest component's.

    The hub is one value known to the driver, so no join is needed.
    """
    sizes = cut(component_sizes(components_by_contraction(edges)), "sizes")
    hub = sizes.orderBy(F.col("size").desc(), F.col("component")).limit(1).collect()
    if not hub:
        return sizes.select(F.col("component").alias("src"), F.col("component").alias("dst"), F.lit(True).alias("synthetic"))
    center = F.lit(hub[0]["component"])
    return sizes.filter(F.col("component") != center).select(
        F.least("component", center).alias("src"),
        F.greatest("component", center).alias("dst"),
        F.lit(True).alias("synthetic"),
    )


def pair_times(edges: DataFrame) -> DataFrame:
    """``(src, dst, timestamps)`` with the times of all types of a pair joined.

    A group holds at most one row per edge type; a missing list falls back to the last time.
    """
    fallback = F.array(F.coalesce("last_ts", "first_ts", "ts", F.lit(0.0)))
    times = F.when(F.size("timestamps") > 0, F.col("timestamps")).otherwise(fallback)
    merged = F.sort_array(F.array_distinct(F.flatten(F.collect_list(times))))
    return edges.groupBy("src", "dst").agg(merged.alias("timestamps"))


def ranked_times(times: DataFrame) -> DataFrame:
    """Distinct times of a ``timestamps`` column with their 0-based place."""
    return global_index(times.select(F.explode("timestamps").alias("ts")).distinct(), [F.col("ts").asc()], "place")


def _range_at(ranked: DataFrame, lo: int, hi: int) -> tuple[float, float] | None:
    """Smallest and largest time with ``lo <= place < hi``."""
    if hi <= lo:
        return None
    edge = ranked.filter(F.col("place").between(lo, hi - 1)).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return edge["a"], edge["b"]


def band_label(
    times: DataFrame,
    test: float = 0.1,
    val: float | None = 0.1,
    test_times: list[float] | None = None,
    val_times: list[float] | None = None,
):
    """Function from a time column to its set name.

    Share bands are contiguous, so two ranges known to the driver replace a join.  The
    last ``ceil(T * test)`` distinct times are test, the ``ceil(T * val)`` before are
    validation; explicit lists override the shares and validation yields to test.
    """
    need_rank = test_times is None or (val_times is None and _share(val) > 0)
    ranked = ranked_times(times) if need_rank else None
    total = ranked.count() if need_rank else 0
    if test_times is None:
        n_test = min(total, math.ceil(total * _share(test)))
        test_range, wanted = _range_at(ranked, total - n_test, total), None
    else:
        wanted = [float(x) for x in test_times]
        test_range = None
        n_test = ranked.filter(F.col("ts").isin(wanted)).count() if need_rank and wanted else 0
    val_range = None
    if val_times is None and need_rank:
        n_val = min(total - n_test, math.ceil(total * _share(val)))
        val_range = _range_at(ranked, total - n_test - n_val, total - n_test)

    def member(ts: Column, span, chosen) -> Column:
        if chosen:
            return ts.isin([float(x) for x in chosen])
        return ts.between(*span) if span else F.lit(False)

    return lambda ts: (
        F.when(member(ts, test_range, wanted), "test").when(member(ts, val_range, val_times), "val").otherwise("train")
    )


def temporal_split(
    edges: DataFrame,
    test: float = 0.1,
    val: float | None = 0.1,
    test_times: list[float] | None = None,
    val_times: list[float] | None = None,
    new_pairs_only: bool = False,
) -> DataFrame:
    """Each pair's times are sliced into the bands, so a pair may be in several sets.

    After the one shuffle that joins the types of a pair, slicing is narrow.  With
    ``new_pairs_only`` a pair seen in an earlier set is left out of the later ones.
    """
    times = cut(pair_times(edges), "times")
    label = band_label(times, test, val, test_times, val_times)

    def slice_of(name: str) -> Column:
        return F.struct(F.lit(name).alias("set"), F.filter("timestamps", lambda x: label(x) == F.lit(name)).alias("timestamps"))

    slices = F.array(*[slice_of(s) for s in SETS])
    kept = F.filter(slices, lambda x: F.size(x["timestamps"]) > 0)
    if new_pairs_only:
        kept = F.slice(kept, 1, 1)
    out = times.select("src", "dst", F.explode(kept).alias("b")).select("src", "dst", "b.set", "b.timestamps")
    return out.withColumns(
        {
            "first_ts": F.element_at("timestamps", 1),
            "last_ts": F.element_at("timestamps", -1),
            "ts": F.element_at("timestamps", -1),
            "interaction_count": F.size("timestamps").cast("bigint"),
        }
    )


def split_nodes(split: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """``(id, set)``: train keeps all nodes, the other sets only the ends of their pairs."""
    held = split.filter(F.col("set") != "train")
    ends = held.select("set", F.explode(F.array("src", "dst")).alias(key)).distinct()
    known = ends.join(nodes.select(key), key, "left_semi")
    return nodes.select(key, F.lit("train").alias("set")).unionByName(known.select(key, "set"))


def split_report(split: DataFrame, connectivity: bool = True, forest: DataFrame | None = None) -> DataFrame:
    """Pairs per set with the number of components of the train pairs (not for temporal splits).

    A ``forest`` that spans the train pairs tells it: every edge of it makes one component of two.
    """
    counts = split.groupBy("set").agg(F.count(F.lit(1)).alias("pairs"))
    if not connectivity:
        return counts.withColumns({"components": F.lit(None).cast("bigint"), "connected": F.lit(None).cast("boolean")})
    train = split.filter(F.col("set") == "train")
    if forest is not None:
        parts = train.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count() - forest.count()
    else:
        parts = components_by_contraction(train).agg(F.count_distinct("component").alias("n")).first()["n"]
    is_train = F.col("set") == "train"
    return counts.withColumns(
        {
            "components": F.when(is_train, F.lit(parts)).cast("bigint"),
            "connected": F.when(is_train, F.lit(parts == 1)),
        }
    )


@dataclass
class Split:
    """Edges per set (mirrored for message passing), their nodes and the counts."""

    edges: DataFrame
    nodes: DataFrame
    report: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("set") == name)

    def mirrored(self, name: str) -> DataFrame:
        return mirror(self.part(name).drop("set"))


def execute_split(
    edges: DataFrame,
    nodes: DataFrame,
    mode: str = "temporal",
    test: float = 0.1,
    val: float | None = 0.1,
    seed: int | str = 42,
    test_times: list[float] | None = None,
    val_times: list[float] | None = None,
) -> Split:
    """Run one split and store it; the report and the node sets read the stored rows."""
    forest = None
    if mode == "temporal":
        made = temporal_split(edges, test, val, test_times, val_times)
    elif mode in ("random", "connected"):
        if mode == "random":
            pairs = random_split(edges, test, val, seed)
        else:
            pairs, forest = _connected(edges, test, val, seed)
        info = edges.groupBy("src", "dst").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("timestamps")))).alias("timestamps"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
        made = pairs.join(info, ["src", "dst"]).withColumns(
            {"ts": F.col("last_ts"), "interaction_count": F.size("timestamps").cast("bigint")}
        )
    else:
        raise ValueError(f"unknown split mode '{mode}'")
    stored = cut(made, "split")
    return Split(stored, split_nodes(stored, nodes), split_report(stored, mode != "temporal", forest))
