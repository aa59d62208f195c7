"""Embedding tables ``(node, vec)`` per family, their dimension and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.scratch import path_exists

DEFAULT_DIM = 128


def write_embeddings(path: str, emb: DataFrame, family: str) -> None:
    """Replace one family's partition; rows without a list vector are skipped."""
    rows = emb.filter(F.col("vec").isNotNull()).select("node", F.col("vec").cast("array<double>").alias("vec"))
    rows.write.mode("overwrite").parquet(f"{path}/family={family}")


def load_embeddings(spark: SparkSession, path: str, family: str) -> DataFrame:
    where = f"{path}/family={family}"
    if not path_exists(spark, where):
        raise ValueError(f"no embeddings of family '{family}'")
    df = spark.read.parquet(where)
    if not isinstance(df.schema["vec"].dataType, T.ArrayType):
        return df.limit(0)
    return df.filter(F.col("vec").isNotNull())


def infer_dim(emb: DataFrame) -> int:
    """Size of any stored vector, else 128."""
    row = emb.filter(F.col("vec").isNotNull()).select(F.size("vec").alias("d")).limit(1).collect()
    return int(row[0]["d"]) if row else DEFAULT_DIM


def embedding_stats(emb: DataFrame) -> DataFrame:
    """Count, dimension, norm range and spread of the dimensions (population), as one row."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    whole = emb.agg(
        F.count(F.lit(1)).alias("count"), F.max(F.size("vec")).cast("bigint").alias("dim"),
        F.min(norm).alias("norm_min"), F.max(norm).alias("norm_max"), F.avg(norm).alias("norm_mean"),
    )
    dims = emb.select(F.posexplode("vec").alias("j", "x")).groupBy("j").agg(F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    spread = dims.agg(
        F.min("sd").alias("min_dim_std"), F.avg("sd").alias("mean_dim_std"), F.max("sd").alias("max_dim_std")
    ).first()
    return whole.withColumns({c: F.lit(spread[c]).cast("double") for c in ("min_dim_std", "mean_dim_std", "max_dim_std")})


# Parts of a property name that mark a family, checked in this order.
FAMILY_MARKS = {
    "FastRP": ["fastrp"],
    "Node2Vec": ["node2vec", "n2v"],
    "GraphSAGE": ["graphsage", "sage"],
    "HashGNN": ["hashgnn", "hgnn"],
    "TGN": ["tgn"],
}


def family_column(name: Column) -> Column:
    """Family marked in a property name, else the sanitised name."""
    low = F.lower(name)
    out = None
    for family, marks in FAMILY_MARKS.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        if family == "HashGNN":
            hit = hit | (low.contains("hash") & low.contains("gnn"))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    plain = F.trim(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return out.otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("Embedding")))
