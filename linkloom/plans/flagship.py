"""Flagship query: how well shared neighbours in the train graph support held-out pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators.graph import common_neighbor_counts, undirected_pairs
from ..operators.splits import temporal_split


def held_out_support(edges: DataFrame, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """Per set of a temporal split: pairs, interactions, pairs with a shared train neighbour, their number.

    Wedges are opened from the split's own pairs only, never from all pairs of a node.
    """
    split = cut(temporal_split(edges, test, val), "split")
    train = cut(undirected_pairs(split.filter(F.col("set") == "train")), "train")
    pairs = split.select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()
    support = common_neighbor_counts(train, pairs)
    rows = split.select("set", F.col("src").alias("s"), F.col("dst").alias("t"), "interaction_count")
    return rows.join(support, ["s", "t"], "left").groupBy("set").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("interaction_count").alias("interactions"),
        F.count("common").alias("supported_pairs"),
        F.coalesce(F.sum("common"), F.lit(0)).alias("shared_neighbors"),
    )
