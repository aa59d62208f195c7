"""Edge table kept up to date from a stream of interactions.

Each micro-batch writes its own rolled-up delta under its batch number, so a repeated
batch replaces itself; readers merge the deltas, and ``compact`` folds them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.scratch import list_dirs
from ..operators.clean import canonicalize_direction, drop_null_endpoints, drop_self_loops, timestamp_rollup, with_type


def batch_delta(batch: DataFrame) -> DataFrame:
    """Distinct ``(src, dst, type, ts)`` of one batch after the cleaning rules."""
    typed = batch if "type" in batch.columns else with_type(batch)
    clean = canonicalize_direction(drop_self_loops(drop_null_endpoints(typed)))
    return clean.select("src", "dst", "type", "ts").distinct()


def stream_edges(interactions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start the stream; ``interactions`` has ``src, dst, ts`` and optionally ``type``."""

    def save(batch: DataFrame, number: int) -> None:
        batch_delta(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        interactions.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_edges(spark: SparkSession, path: str) -> DataFrame:
    """Merged edges with their sorted distinct times."""
    return timestamp_rollup(spark.read.parquet(path).select("src", "dst", "type", "ts"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Fold all deltas into ``target`` (a new folder) as one batch with the highest number."""
    numbers = [d for d in list_dirs(spark, path) if d.startswith("batch=")]
    last = max(int(d.split("=")[1]) for d in numbers)
    rows = spark.read.parquet(path).select("src", "dst", "type", "ts").distinct()
    rows.write.mode("overwrite").parquet(f"{target}/batch={last}")
