"""Joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

# A key is hot from this many rows on; hot keys share this many salts.
HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(big: DataFrame, key: str) -> DataFrame:
    """Keys of ``big`` with too many rows for one task (counted map-side first)."""
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") >= HOT_ROWS).select(key)


def salted_join(
    big: DataFrame, other: DataFrame, on: list[str], hot: DataFrame | None = None, how: str = "inner"
) -> DataFrame:
    """Join on ``on``; rows of ``big`` under a hot value of the first key are spread over salts.

    ``hot`` is the stored table of hot key values (see :func:`find_hot`); it is joined to both
    sides, and Spark broadcasts it if its size allows.  Rows of ``other`` under a hot key are
    repeated once per salt; everything else is an ordinary join, and no row is dropped.
    """
    if hot is None:
        return big.join(other, on, how)
    key = on[0]
    marks = hot.select(F.col(hot.columns[0]).alias(key), F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS))).otherwise(F.lit(0))
    left = big.join(marks, key, "left").withColumn("__salt", salt.cast("int")).select(*big.columns, "__salt")
    spread = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(marks, key, "left").withColumn("__salt", F.explode(spread)).select(*other.columns, F.col("__salt").cast("int").alias("__salt"))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def find_hot(big: DataFrame, key: str) -> DataFrame | None:
    """Stored hot key values of ``big``, as many as there are; None without any."""
    found = hot_keys(big, key)
    return None if found.isEmpty() else cut(found, "hot")


def keep_ends(edges: DataFrame, ids: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges whose ends are all in ``ids`` (one column); hubs are salted."""
    (name,) = ids.columns
    columns = edges.columns
    for end in ends:
        edges = salted_join(edges, ids.withColumnRenamed(name, end), [end], find_hot(edges, end), "left_semi")
    return edges.select(*columns)
