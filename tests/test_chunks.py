"""Time lists in chunks against plain lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import chunks as ch
from linkloom.operators.splits import temporal_split

RNG = np.random.default_rng(2)
EVENTS = [(f"a{i % 3}", "b", "xy"[i % 2], float(t)) for i, t in enumerate(RNG.integers(-30, 60, 400))] + [("h", "b", "x", t / 2) for t in range(500)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([*EVENTS, *EVENTS[:50], ("a0", "b", "x", None)], "src string, dst string, type string, ts double")


@pytest.mark.parametrize("bounds", [(None, None), (-5.0, 17.0), (None, 3.0), (200.25, None), (900.0, 999.0)])
def test_slices(spark, events, bounds):
    low, high = bounds
    chunks = ch.time_chunks(events, 10)
    inside = {e for e in EVENTS if (low is None or e[3] >= low) and (high is None or e[3] <= high)}
    cut = ch.time_slice(chunks, low, high)
    assert sorted((r.src, r.dst, r.type, t) for r in cut.collect() for t in r.timestamps) == sorted(inside)
    assert all(len(r.timestamps) == r.n <= 20 and list(r.timestamps) == sorted(r.timestamps) and math.floor(r.first_ts / 10) == r.chunk == math.floor(r.last_ts / 10) for r in cut.collect())
    told = {(r.src, r.dst, r.type): (r.first_ts, r.last_ts, r.interaction_count) for r in ch.rollup(cut).collect()}
    want = {}
    for e in inside:
        want.setdefault(e[:3], []).append(e[3])
    assert told == {k: (min(v), max(v), len(v)) for k, v in want.items()}
    if low is None:
        assert sorted(map(tuple, ch.events_of(chunks, high).select("src", "dst", "type", "ts").collect())) == sorted(inside)


def test_stored_chunks_are_skipped_by_their_bounds(spark, events, tmp_path):
    ch.time_chunks(events, 10).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = ch.time_slice(stored, -5.0, 17.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(last_ts,-5.0)" in plan and "LessThanOrEqual(first_ts,17.0)" in plan


def test_split_equals_that_of_whole_lists(spark, events):
    chunks = ch.time_chunks(events, 10)
    whole = chunks.groupBy("src", "dst", "type").agg(F.array_sort(F.flatten(F.collect_list("timestamps"))).alias("timestamps"))
    whole = whole.withColumns({c: F.lit(None).cast("double") for c in ("first_ts", "last_ts", "ts")})
    flat = lambda df: sorted((r.src, r.dst, r.set, t) for r in df.collect() for t in r.timestamps)
    assert flat(ch.temporal_chunk_split(ch.joined_types(chunks), 0.2, 0.15)) == flat(temporal_split(whole, 0.2, 0.15))


def test_no_events(spark, events):
    none = ch.time_chunks(events.limit(0), 5)
    assert ch.time_slice(none, 1, 2).count() == 0 and ch.temporal_chunk_split(ch.joined_types(none)).count() == 0
    with pytest.raises(ValueError):
        ch.time_chunks(events, 0)
