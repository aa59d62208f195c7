"""Times of a pair in chunks: a row per pair, type and span of time instead of one list per pair.

A pair with any number of times is as many rows as its times fill spans, so no row grows with the history, and a hot
pair is spread over the shuffle by its spans.  Each chunk has its own bounds: a slice of time leaves whole chunks as they
are, opens only those that its borders cut, and skips the others by their bounds, in the scan if the chunks are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import SETS, band_label


def _bounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"first_ts": F.element_at("timestamps", 1), "last_ts": F.element_at("timestamps", -1), "n": F.size("timestamps").cast("bigint")}
    )


def time_chunks(events: DataFrame, width: float, keys: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    """``(keys, chunk, timestamps, first_ts, last_ts, n)`` of events with ``keys`` and ``ts``: sorted distinct times.

    A chunk spans ``width`` units of time, so it holds at most as many times as the resolution leaves in that.
    Null times are left out.
    """
    if not width > 0:
        raise ValueError("the width of a chunk must be above 0")
    spans = events.filter("ts is not null").select(*keys, "ts", F.floor(F.col("ts") / F.lit(float(width))).cast("bigint").alias("chunk")).distinct()
    return _bounded(spans.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("ts")).alias("timestamps")))


def joined_types(chunks: DataFrame) -> DataFrame:
    """Chunks per pair, the times of all its types in one list per span."""
    times = F.array_sort(F.array_distinct(F.flatten(F.collect_list("timestamps"))))
    return _bounded(chunks.groupBy("src", "dst", "chunk").agg(times.alias("timestamps")))


def rollup(chunks: DataFrame, keys: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    """First and last time and number of times per key, from the bounds alone."""
    return chunks.groupBy(*keys).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("interaction_count")
    )


def events_of(chunks: DataFrame, as_of: float | None = None) -> DataFrame:
    """One row per time, up to ``as_of``: chunks that begin later are not read."""
    rows = chunks if as_of is None else time_slice(chunks, None, as_of)
    return rows.select(*[c for c in rows.columns if c not in ("chunk", "timestamps", "first_ts", "last_ts", "n")], F.explode("timestamps").alias("ts"))


def time_slice(chunks: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Chunks cut to ``low <= time <= high``; only those across a border are opened."""
    inside, whole = F.lit(True), F.lit(True)
    if low is not None:
        inside, whole = inside & (F.col("last_ts") >= F.lit(float(low))), whole & (F.col("first_ts") >= F.lit(float(low)))
    if high is not None:
        inside, whole = inside & (F.col("first_ts") <= F.lit(float(high))), whole & (F.col("last_ts") <= F.lit(float(high)))

    def keep(x):
        ok = F.lit(True)
        ok = ok if low is None else ok & (x >= F.lit(float(low)))
        return ok if high is None else ok & (x <= F.lit(float(high)))

    cut_to = F.when(whole, F.col("timestamps")).otherwise(F.filter("timestamps", keep))
    return _bounded(chunks.filter(inside).withColumn("timestamps", cut_to).filter(F.size("timestamps") > 0))


def temporal_chunk_split(chunks: DataFrame, test: float = 0.1, val: float | None = 0.1) -> DataFrame:
    """The bands of ``temporal_split`` over chunks: ``(src, dst, set, chunk, timestamps, first_ts, last_ts, n)``.

    Bands are ranges of time, so a chunk whose bounds have one label is passed on unopened.
    """
    label = band_label(chunks, test, val)

    def part(name: str):
        return F.struct(F.lit(name).alias("set"), F.filter("timestamps", lambda x: label(x) == F.lit(name)).alias("timestamps"))

    parts = F.array(*[part(name) for name in SETS])
    one = F.array(F.struct(label(F.col("first_ts")).alias("set"), F.col("timestamps").alias("timestamps")))
    opened = F.when(label(F.col("first_ts")) == label(F.col("last_ts")), one).otherwise(F.filter(parts, lambda p: F.size(p["timestamps"]) > 0))
    rows = chunks.select("src", "dst", "chunk", F.explode(opened).alias("p"))
    return _bounded(rows.select("src", "dst", "p.set", "chunk", "p.timestamps"))
