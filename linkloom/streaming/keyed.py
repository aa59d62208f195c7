"""Node memories as keyed operator state: pending events, memory and last neighbours of each node.

Events may come in any order and more than once within the delay of the watermark.  They wait in the state of their
node until the watermark has passed them; then a timer takes those that are due, each once and in order of time, adds
them to the decayed sum and to the list of the last ``k`` neighbours, and emits the node's new row.  What came before is
held in these two alone, so a batch costs what it brings, not what the stream has brought so far.  An event behind the
watermark is dropped by Spark.  A row without ``dst`` is a tick: it moves the watermark and nothing else.

The state of a node is worked on by one task; its due events are summed as one matrix product.  Where a single node
gets too many events for that, :mod:`.memory` spreads them and keeps no operator state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.hashing import hash60

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed value: a day, the unit of the test graphs' times, in seconds.
DAY = 86_400


class NodeMemory(StatefulProcessor):
    """State of one node: ``pending`` events, the ``memory`` (newest time and sums), the ``recent`` neighbours."""

    def __init__(self, dim: int, time_dim: int, tau: float, k: int, unit: float):
        self.dim, self.tau, self.k, self.unit = dim, tau, k, unit
        self.freq = np.array([1.0 / (10.0 ** (4.0 * j / max(time_dim - 1, 1))) for j in range(time_dim)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts double, other string, signs string")
        self.memory = handle.getValueState("memory", "last_ts double, acc array<double>")
        self.recent = handle.getListState("recent", "ts double, other string")

    def _millis(self, ts: float) -> int:
        return int(np.ceil(ts * self.unit * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            events = pdf[pdf["other"].notna()].drop_duplicates(["ts", "other"])
            if len(events):
                self.pending.appendList([(float(t), str(o), str(s)) for t, o, s in zip(events["ts"], events["other"], events["signs"])])
                first = min(events["ts"].min(), np.inf if first is None else first)
        if first is not None:
            self.handle.registerTimer(self._millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.pending.exists():
            return iter(())
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted({tuple(r) for r in self.pending.get()})
        due = [r for r in waiting if self._millis(r[0]) <= now]
        later = waiting[len(due) :]
        if later:
            self.pending.put(later)
            self.handle.registerTimer(self._millis(later[0][0]))
        else:
            self.pending.clear()
        if not due:
            return iter(())
        last, acc = self.memory.get() if self.memory.exists() else (None, None)
        last, acc = self._added(due, last, acc)
        self.memory.update((last, acc.tolist()))
        known = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        recent = sorted({*known, *((ts, other) for ts, other, _ in due)}, key=lambda r: (-r[0], r[1]))[: self.k]
        self.recent.put(recent)
        row = {"node": [key[0]], "last_ts": [last], "acc": [acc.tolist()], "recent_ts": [[r[0] for r in recent]], "recent": [[r[1] for r in recent]]}
        return iter([pd.DataFrame(row)])

    def _added(self, due: list[tuple], last: float | None, acc) -> tuple[float, np.ndarray]:
        """Newest time and decayed sums after events in order of time."""
        times = np.array([r[0] for r in due])
        before = np.concatenate([[times[0] if last is None else last], times[:-1]])
        base = (1.0 - 2.0 * (np.array([list(r[2]) for r in due]) == "1")) / np.sqrt(self.dim)
        codes = np.cos((times - before)[:, None] * self.freq)
        sums = np.exp((times - times[-1]) / self.tau) @ np.hstack([base, codes])
        if last is not None:
            sums = sums + np.asarray(acc) * np.exp((last - times[-1]) / self.tau)
        return float(times[-1]), sums

    def close(self) -> None:
        pass


def keyed_memory(
    events: DataFrame, delay: str, dim: int = 16, time_dim: int = 8, tau: float = 10.0, k: int = 10, seed: int | str = 42, unit: float = DAY
) -> DataFrame:
    """Streaming ``(node, last_ts, acc, recent_ts, recent)``: a row whenever events of a node have become final.

    ``events`` has ``src, dst, ts`` with ``ts`` in units of ``unit`` seconds; the watermark follows it by ``delay``.
    """
    timed = events.select("src", "dst", "ts", F.timestamp_micros((F.col("ts") * F.lit(unit * 1e6)).cast("bigint")).alias("at")).withWatermark("at", delay)
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    tick = F.array(F.struct(F.lit("").alias("node"), F.lit(None).cast("string").alias("other")))
    ends = F.when(F.col("dst").isNull() | (F.col("src") == F.col("dst")), tick).otherwise(both)
    signs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (hash60(str(seed), F.col("e.other"), j) % 2).cast("string")), "")
    rows = timed.select(F.explode(ends).alias("e"), "ts", "at").select(F.coalesce("e.node", F.lit("")).alias("node"), "e.other", "ts", "at", signs.alias("signs"))
    return rows.groupBy("node").transformWithStateInPandas(
        NodeMemory(dim, time_dim, tau, k, unit),
        outputStructType="node string, last_ts double, acc array<double>, recent_ts array<double>, recent array<string>",
        outputMode="Update",
        timeMode="EventTime",
    )


def stream_keyed_memory(events: DataFrame, path: str, checkpoint: str, delay: str, **options) -> StreamingQuery:
    """Start the stream; each batch writes the rows of the nodes it has touched, in the layout of :mod:`.memory`.

    Read with ``memory.current_memory``.  A batch that runs twice replaces its own rows.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            rows.select("node", "last_ts", "acc").write.mode("overwrite").parquet(f"{path}/state/batch={number}")
            near = rows.select("node", F.posexplode(F.arrays_zip("recent_ts", "recent")).alias("rank", "r"))
            recent = near.select("node", (F.col("rank") + 1).alias("rank"), F.col("r.recent").alias("neighbor"), F.col("r.recent_ts").alias("ts"))
            recent.write.mode("overwrite").parquet(f"{path}/recent/batch={number}")
        finally:
            rows.unpersist()

    made = keyed_memory(events, delay, **options)
    return made.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
