"""Adjacency kept partitioned by its first end, as a bucketed table.

The rows are dealt by node once, when the adjacency is written; a lookup from any frontier then moves the frontier
alone, in every hop of every loop that reads the table.  A node with ``skew.HOT_ROWS`` neighbours or more has its rows
spread over salts, which are part of the bucket key, and its frontier row is repeated once a salt.

The table's files lie in a folder of their own and its layout is known from a few values, so another session can read
them (:func:`attach`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.pairs import mirror, undirected_pairs
from ..functions.scratch import cut, scratch_path


def table_name(path: str) -> str:
    return f"linkloom_{hashlib.md5(path.encode()).hexdigest()}"


def buckets_for(spark: SparkSession) -> int:
    """As many buckets as a shuffle makes partitions: with fewer, a join would deal the table's rows anew."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, keys: list[str], path: str | None = None, label: str = "bucketed") -> DataFrame:
    """Write ``df`` dealt and sorted by ``keys``, one file a bucket, and go on from the table."""
    spark = df.sparkSession
    path, n = path or scratch_path(spark, label), buckets_for(spark)
    dealt = df.repartition(n, *keys).sortWithinPartitions(*keys, *[c for c in df.columns if c not in keys])
    dealt.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table_name(path))
    return spark.table(table_name(path))


def attach(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """The bucketed table below ``path``, also if this session did not write it."""
    name, by = table_name(path), ", ".join(keys)
    spark.sql(f"create table if not exists {name} ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    return spark.table(name)


@dataclass
class Adjacency:
    """``steps``: ``(src, dst)`` and what the pairs hold besides, with a ``salt`` if there are ``hot`` nodes; ``hot``: their ids, or None."""

    steps: DataFrame
    hot: DataFrame | None = None

    @property
    def keys(self) -> list[str]:
        return ["src"] if self.hot is None else ["src", "salt"]

    @property
    def pairs(self) -> DataFrame:
        """Directed pairs ``(src, dst)``."""
        return self.steps.select("src", "dst")

    @property
    def id_type(self) -> str:
        return dict(self.steps.dtypes)["src"]

    def reach(self, frontier: DataFrame, how: str = "inner") -> DataFrame:
        """Columns of ``frontier`` (with its node as ``src``) and the neighbour ``dst``; only the frontier is dealt."""
        if self.hot is None:
            return frontier.join(self.steps, "src", how)
        marks = self.hot.select("src", F.lit(True).alias("__hot"))
        salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(skew.SALTS - 1))).otherwise(F.array(F.lit(0)))
        spread = frontier.join(marks, "src", "left").withColumn("salt", F.explode(salts)).drop("__hot")
        return spread.join(self.steps, ["src", "salt"], how).drop("salt")

    def degrees(self) -> DataFrame:
        return self.steps.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def adjacency(edges: DataFrame | Adjacency, path: str | None = None) -> Adjacency:
    """Both directions of the distinct pairs of ``edges``; an adjacency that is there already is taken as it is."""
    return edges if isinstance(edges, Adjacency) else adjacency_of(undirected_pairs(edges), path)


def adjacency_of(pairs: DataFrame, path: str | None = None) -> Adjacency:
    """:func:`adjacency` of pairs ``(src, dst)`` that are distinct as they are; their further columns stay with the steps."""
    steps = mirror(pairs)
    counts = steps.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= skew.HOT_ROWS).select("src")
    if counts.isEmpty():
        return Adjacency(bucketed(steps, ["src"], path, "adj"))
    hot = cut(counts, "hot")
    marked = steps.join(hot.withColumn("__hot", F.lit(True)), "src", "left")
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("dst"), F.lit(skew.SALTS))).otherwise(F.lit(0)).cast("int")
    return Adjacency(bucketed(marked.select("src", salt.alias("salt"), *steps.columns[1:]), ["src", "salt"], path, "adj"), hot)


def save_adjacency(edges: DataFrame | Adjacency, folder: str) -> Adjacency:
    """Write an adjacency below ``folder`` (new, shared), with what another session needs to read it."""
    spark = (edges.steps if isinstance(edges, Adjacency) else edges).sparkSession
    made = adjacency(edges.pairs if isinstance(edges, Adjacency) else edges, f"{folder}/steps")
    if made.hot is not None:
        made.hot.write.parquet(f"{folder}/hot")
    columns = ", ".join(f"{n} {t}" for n, t in made.steps.dtypes)
    spark.createDataFrame([(columns, buckets_for(spark), made.hot is not None)], "columns string, buckets int, hot boolean").write.parquet(f"{folder}/about")
    return made


def load_adjacency(spark: SparkSession, folder: str) -> Adjacency:
    """An adjacency that :func:`save_adjacency` has written, in whatever session."""
    about = spark.read.parquet(f"{folder}/about").first()
    hot = spark.read.parquet(f"{folder}/hot") if about["hot"] else None
    keys = ["src", "salt"] if about["hot"] else ["src"]
    return Adjacency(attach(spark, f"{folder}/steps", about["columns"], keys, about["buckets"]), hot)
