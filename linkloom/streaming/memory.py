"""Node memories kept up to date from a stream of events, in whatever order and however often they come.

The distinct events are part of the state, so a repeated event is known and left out.  The memory is a
decayed sum: events later than a node's newest one are summed per node (combined map-side) and added to
its stored row; a node that gets an earlier event is summed anew from its own events.  A batch writes the
rows of the nodes it touches, under its own number; readers take the newest row per node.  A batch that
runs twice replaces its own rows and reads those of earlier batches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ordering import previous_row
from ..functions.scratch import cut, list_dirs
from ..functions.skew import find_hot, salted_join
from ..operators.embeddings.temporal import apply_projection, blend_neighbors, last_k_neighbors, memory_sums
from ..operators.graph import mirror


def _earlier(spark: SparkSession, path: str, table: str, number: int | None) -> DataFrame | None:
    """Rows of all batches before ``number`` (of all without it), with their ``batch``."""
    found = sorted(int(d.split("=")[1]) for d in list_dirs(spark, f"{path}/{table}") if d.startswith("batch="))
    found = [b for b in found if number is None or b < number]
    if not found:
        return None
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return rows.filter(F.col("batch") <= found[-1])


def _newest(rows: DataFrame | None) -> DataFrame | None:
    """Rows of the newest batch of each node."""
    if rows is None:
        return None
    last = rows.groupBy("node").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["node", "batch"], "left_semi").drop("batch")


def _decayed(acc: str, last: str, now: Column, tau: float) -> Column:
    return F.transform(acc, lambda x: x * F.exp((F.col(last) - now) / F.lit(float(tau))))


def fresh_events(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """``(ts, src, dst)`` of the batch in both directions, each once and only if it is not known."""
    events = mirror(batch.select("src", "dst", "ts").filter("src <> dst")).select("ts", "src", "dst").distinct()
    return events if known is None else events.join(known.select("ts", "src", "dst"), ["src", "dst", "ts"], "left_anti").select("ts", "src", "dst")


def merge_state(
    fresh: DataFrame, known: DataFrame | None, old: DataFrame | None, dim: int, time_dim: int, tau: float, seed: int | str
) -> DataFrame:
    """``(node, last_ts, acc)`` of the nodes that ``fresh`` touches."""
    order = [F.col("ts").asc(), F.col("dst").asc()]
    if old is None:
        timed = previous_row(fresh, ["src"], order, {"before": "ts"})
        return memory_sums(cut(timed.select("ts", "src", "dst", F.coalesce(F.col("ts") - F.col("before"), F.lit(0.0)).alias("gap")), "gaps"), dim, time_dim, tau, seed)
    first = fresh.groupBy("src").agg(F.min("ts").alias("first"))
    seen = cut(first.join(old.select(F.col("node").alias("src"), F.col("last_ts").alias("stored")), "src"), "seen")
    late = seen.filter("first < stored").select("src")
    again = known.select("ts", "src", "dst").join(late, "src", "left_semi")
    events = cut(fresh.unionByName(again), "events")
    timed = previous_row(events, ["src"], order, {"before": "ts"})
    in_order = seen.filter("first >= stored").select("src", "stored")
    timed = salted_join(timed, in_order, ["src"], find_hot(events, "src"), "left")
    gap = F.coalesce(F.col("ts") - F.coalesce("before", "stored"), F.lit(0.0))
    new = memory_sums(cut(timed.select("ts", "src", "dst", gap.alias("gap")), "gaps"), dim, time_dim, tau, seed)
    before = old.join(in_order.select(F.col("src").alias("node")), "node", "left_semi")
    a, b = before.alias("a"), new.alias("b")
    joined = b.join(a, F.col("a.node") == F.col("b.node"), "left")
    added = F.zip_with(_decayed("a.acc", "a.last_ts", F.col("b.last_ts"), tau), F.col("b.acc"), lambda x, y: x + y)
    return joined.select("b.node", "b.last_ts", F.coalesce(added, F.col("b.acc")).alias("acc"))


def merge_recent(fresh: DataFrame, old: DataFrame | None, k: int) -> DataFrame:
    """Last ``k`` events of the nodes that ``fresh`` touches; both sides hold at most ``k`` rows a node."""
    recent = last_k_neighbors(fresh, k)
    if old is None:
        return recent
    touched = recent.select("node").distinct()
    every = old.join(touched, "node", "left_semi").select("node", "neighbor", "ts").unionByName(recent.select("node", "neighbor", "ts"))
    order = Window.partitionBy("node").orderBy(F.col("ts").desc(), F.col("neighbor").asc())
    kept = every.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return kept.select("node", "rank", "neighbor", "ts")


def stream_memory(
    events: DataFrame,
    path: str,
    checkpoint: str,
    dim: int = 16,
    time_dim: int = 8,
    tau: float = 10.0,
    k: int = 10,
    seed: int | str = 42,
) -> StreamingQuery:
    """Start the stream; ``events`` has ``src, dst, ts`` with numeric time."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _earlier(spark, path, "events", number)
        fresh = cut(fresh_events(batch, known), "fresh")
        state = merge_state(fresh, known, _newest(_earlier(spark, path, "state", number)), dim, time_dim, tau, seed)
        recent = merge_recent(fresh, _newest(_earlier(spark, path, "recent", number)), k)
        for table, rows in (("recent", recent), ("state", state), ("events", fresh)):
            rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")

    return (
        events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_memory(
    spark: SparkSession, path: str, nodes: DataFrame, dim: int = 16, time_dim: int = 8, seed: int | str = 42
) -> DataFrame:
    """``(node, vec)`` from the newest state."""
    state = _newest(_earlier(spark, path, "state", None))
    recent = _newest(_earlier(spark, path, "recent", None))
    memory = apply_projection(state, dim, time_dim, seed)
    return blend_neighbors(nodes, memory, recent, dim)
