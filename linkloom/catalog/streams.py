"""Streaming queries: the event log as a stream, result after all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut, scratch_path
from ..streaming import collapse, keyed, memory
from .base import Graphs, list_text, register
from .embeddings import MEMORY_SQL

CATALOG: dict = {}


def _hops(g: Graphs, folder: str) -> DataFrame:
    """Interactions as a stream of files over a few micro-batches: in no order of time, and some of them twice."""
    raw = cut(g.handoff_raw().filter("src is not null").select("src", "dst", "ts", F.col("rel_type").alias("type")), "hops")
    draw = F.xxhash64("src", "dst", "ts", "type")
    again = raw.filter(F.pmod(draw, F.lit(10)) == 0).withColumn("p", F.pmod(draw, F.lit(2)))
    files = raw.withColumn("p", F.pmod(draw, F.lit(3))).unionByName(again)
    files.write.partitionBy("p").parquet(folder)
    some = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        g.spark.readStream.schema("src string, dst string, ts double, type string, p long")
        .option("maxFilesPerTrigger", some)
        .parquet(folder)
        .drop("p")
    )


@register(
    CATALOG, "w2_streaming_collapse",
    """with r as (select least(a, b)::VARCHAR as src, greatest(a, b)::VARCHAR as dst, ts, type from (
    select lag(user_id) over (order by ts, event_id) as a, user_id as b, event_type as type,
    date_diff('day', DATE '1970-01-01', ts::DATE) as ts from events) where a is not null and a <> b)
    select src, dst, type, array_to_string([x::VARCHAR for x in list_sort(list(distinct ts))], ',') as times, count(distinct ts) as interaction_count
    from r group by src, dst, type""",
)
def streaming_collapse(g: Graphs) -> DataFrame:
    path, check = scratch_path(g.spark, "stream"), scratch_path(g.spark, "check")
    collapse.stream_edges(_hops(g, scratch_path(g.spark, "in")), path, check).awaitTermination()
    return collapse.current_edges(g.spark, path).select(
        "src", "dst", "type", list_text("timestamps").alias("times"), "interaction_count"
    )


@register(CATALOG, "w1_streaming_memory", MEMORY_SQL)
def streaming_memory(g: Graphs) -> DataFrame:
    path, check = scratch_path(g.spark, "stream"), scratch_path(g.spark, "check")
    hops = _hops(g, scratch_path(g.spark, "in"))
    memory.stream_memory(hops, path, check, dim=8, time_dim=4).awaitTermination()
    rows = memory.current_memory(g.spark, path, g.nodes("handoff"), 8, 4)
    return rows.select("node", F.posexplode("vec").alias("j", "x")).select("node", "j", (F.round("x", 5) + F.lit(0.0)).alias("x"))


def _in_time(g: Graphs, folder: str) -> tuple[DataFrame, str]:
    """Interactions as a stream of files about in order of time: some come one file late, some twice, a tick ends them.

    With the stream goes the delay that is long enough for the late ones.
    """
    raw = cut(g.handoff_raw().filter("src is not null").select("src", "dst", "ts"), "hops")
    span = raw.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    width = (span["high"] - span["low"] + 1) / 4
    draw = F.pmod(F.xxhash64("src", "dst", "ts"), F.lit(10))
    part = F.floor((F.col("ts") - F.lit(span["low"])) / F.lit(width)).cast("int")
    come = F.when(draw == 0, F.array(part + 1)).when(draw == 1, F.array(part, part + 1)).otherwise(F.array(part))
    dealt = raw.withColumn("part", F.explode(come))
    days = int(2 * width) + 1
    for p in range(5):
        dealt.filter(F.col("part") == p).drop("part").write.mode("append").parquet(folder)
    g.spark.createDataFrame([(None, None, span["high"] + days + 2)], "src string, dst string, ts double").write.mode("append").parquet(folder)
    some = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = g.spark.readStream.schema("src string, dst string, ts double").option("maxFilesPerTrigger", some).parquet(folder)
    return rows, f"{days} days"


@register(CATALOG, "w1_keyed_memory", MEMORY_SQL)
def keyed_memory(g: Graphs) -> DataFrame:
    path, check = scratch_path(g.spark, "stream"), scratch_path(g.spark, "check")
    rows, delay = _in_time(g, scratch_path(g.spark, "in"))
    keyed.stream_keyed_memory(rows, path, check, delay, dim=8, time_dim=4).awaitTermination()
    found = memory.current_memory(g.spark, path, g.nodes("handoff"), 8, 4)
    return found.select("node", F.posexplode("vec").alias("j", "x")).select("node", "j", (F.round("x", 5) + F.lit(0.0)).alias("x"))
