"""Reading edge lists and node features, and the small sample graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that count as missing in a CSV cell.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Accepted names of the endpoint and type columns, first match wins.
SOURCE_NAMES = ("source", "src")
TARGET_NAMES = ("target", "dst")
TYPE_NAMES = ("type", "rel_type")


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(MISSING_TEXT), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return _blank_to_null(_csv(spark, path))
    return spark.read.format(fmt).load(path)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", False).csv(path)


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``row_idx``: file, start of the block, and place in the task that reads the block.

    Spark packs files into tasks by size, so a running number alone does not follow the files.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn("row_idx", place)


def _find(df: DataFrame, names: tuple[str, ...]) -> str | None:
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[n] for n in names if n in by_lower), None)


def edge_columns(df: DataFrame) -> tuple[str, str, str | None]:
    """Names of the source, target and (optional) type column, found in any case."""
    source, target = _find(df, SOURCE_NAMES), _find(df, TARGET_NAMES)
    if source is None or target is None:
        raise ValueError("an edge list needs 'source' and 'target' (or 'src' and 'dst') columns")
    return source, target, _find(df, TYPE_NAMES)


def as_edges(df: DataFrame) -> DataFrame:
    """Rename endpoints to ``src``/``dst`` (text) and the type column to ``rel_type``."""
    source, target, kind = edge_columns(df)
    named = {source: "src", target: "dst"} | ({kind: "rel_type"} if kind else {})
    return df.select(
        *[
            F.col(f"`{c}`").cast("string").alias(named[c]) if c in named else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def read_edges(spark: SparkSession, path: str, fmt: str = "csv", keep_order: bool = True) -> DataFrame:
    """Edge list from CSV or Parquet; ``row_idx`` orders the rows by file (in name order) and place in it."""
    if not keep_order:
        return as_edges(read_table(spark, path, fmt))
    raw = _numbered(_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path))
    return as_edges(_blank_to_null(raw) if fmt == "csv" else raw)


def as_features(df: DataFrame) -> DataFrame:
    key = _find(df, ("id",))
    if key is None:
        raise ValueError("a feature table needs an 'id' column")
    return df.select(
        F.col(f"`{key}`").cast("string").alias("id"), *[F.col(f"`{c}`") for c in df.columns if c != key]
    )


def read_features(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return as_features(read_table(spark, path, fmt))


def sample_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Six users on a ring, with country and age."""
    nodes = [(0, "GR", 23), (1, "GR", 25), (2, "DE", 28), (3, "FR", 22), (4, "DE", 26), (5, "GR", 24)]
    links = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)]
    return (
        spark.createDataFrame([(str(i), c, a) for i, c, a in nodes], "id string, country string, age int"),
        spark.createDataFrame([(str(a), str(b)) for a, b in links], "source string, target string"),
    )
