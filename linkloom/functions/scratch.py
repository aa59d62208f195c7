"""Cutting lineage through tables in the shared checkpoint folder.

Every loop and every two-pass operator needs its intermediate rows to be the same
in both passes, also after an executor was lost.  The rows are written as Parquet
below ``spark.checkpoint.dir`` and read back: unlike a cached frame such a table
survives executors, and unlike an RDD checkpoint it keeps column pruning and sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="linkloom-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str = "t") -> str:
    return f"{checkpoint_dir(spark)}/linkloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once and go on from the stored rows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_with(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`cut` and aggregates of the stored rows."""
    stored = cut(df, label)
    return stored, stored.agg(*[c.alias(n) for n, c in measures.items()]).first().asDict()


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return bool(fs.exists(where))


def remove_path(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return bool(fs.delete(where, True))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, where = _filesystem(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def drop_cut(df: DataFrame) -> None:
    """Remove the table behind a frame made by :func:`cut` once nothing reads it."""
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark)}/linkloom/"
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/linkloom/" in folder and root.split("://")[-1].lstrip("/") in folder:
            remove_path(spark, folder)
