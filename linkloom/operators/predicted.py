"""Predicted edges next to observed ones: projection, snapshot rows, series, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import first_rows
from .graph import mirror
from .linkpred import edge_start

PREDICTED = "PREDICTED"
EDGE_COLUMNS = [
    "src", "dst", "type", "timestamps", "first_ts", "last_ts", "ts", "interaction_count", "predicted", "probability",
]


def edge_end() -> Column:
    """Last time of an edge: the list first, then the single time columns."""
    listed = F.when(F.size("timestamps") > 0, F.array_max("timestamps"))
    return F.coalesce(listed, "last_ts", "first_ts", "ts", F.lit(0.0))


def max_timestamp(edges: DataFrame) -> float:
    return float(edges.agg(F.coalesce(F.max(edge_end()), F.lit(0.0)).alias("v")).first()["v"])


def observed_rows(edges: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Stored edges with defaults filled; only those that exist at ``cutoff`` if one is given."""
    rows = edges if cutoff is None else edges.filter(edge_start() <= F.lit(float(cutoff)))
    has = set(edges.columns)
    listed = F.when(F.size("timestamps") > 0, F.col("timestamps")).otherwise(F.array(F.coalesce("ts", F.lit(0.0))))
    probability = F.coalesce("probability", F.lit(1.0)) if "probability" in has else F.lit(1.0)
    predicted = F.coalesce("predicted", F.lit(0)) if "predicted" in has else F.lit(0)
    return rows.select(
        "src", "dst", "type", listed.alias("timestamps"),
        edge_start().alias("first_ts"),
        F.coalesce("last_ts", "ts", F.lit(0.0)).alias("last_ts"),
        F.coalesce("last_ts", "ts", F.lit(0.0)).alias("ts"),
        F.coalesce("interaction_count", F.size("timestamps").cast("bigint"), F.lit(1).cast("bigint")).alias("interaction_count"),
        predicted.cast("int").alias("predicted"),
        probability.cast("double").alias("probability"),
    )


def predicted_rows(chosen: DataFrame, ts: float, round_no: int = 1) -> DataFrame:
    """Edge rows for chosen ``(s, t, probability)`` pairs."""
    time = F.lit(float(ts))
    return chosen.select(
        F.col("s").alias("src"), F.col("t").alias("dst"), F.lit(PREDICTED).alias("type"),
        F.array(time).alias("timestamps"), time.alias("first_ts"), time.alias("last_ts"), time.alias("ts"),
        F.lit(1).cast("bigint").alias("interaction_count"),
        F.lit(int(round_no)).alias("predicted"), F.col("probability").cast("double").alias("probability"),
    )


def project_predicted(
    edges: DataFrame, chosen: DataFrame, cutoff: float | None = None, ts: float | None = None, both: bool = True
) -> DataFrame:
    """Observed and predicted edges in one frame, by default in both directions."""
    when = max_timestamp(edges) + 1 if ts is None else ts
    rows = observed_rows(edges, cutoff).unionByName(predicted_rows(chosen, when))
    return mirror(rows).select(*EDGE_COLUMNS) if both else rows


def snapshot_rows(edges: DataFrame, nodes: DataFrame, chosen: DataFrame, ts: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical ``(nodes, edges)`` of a predicted snapshot; nodes are the ends of its edges."""
    rows = project_predicted(edges, chosen, None, ts, both=False)
    observed = F.col("type") != PREDICTED
    rows = rows.withColumns(
        {
            "probability": F.when(observed, F.lit(1.0)).otherwise(F.col("probability")),
            "predicted": F.when(observed, F.lit(0)).otherwise(F.lit(1)),
        }
    )
    ends = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), rows


def predicted_pairs(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("predicted") > 0).select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()


def predicted_series(edges: DataFrame) -> DataFrame:
    """One row per predicted edge, in order of time, falling probability and ends."""
    rows = edges.filter(F.col("type") == PREDICTED).select(
        F.col("src").alias("s"), F.col("dst").alias("t"),
        F.coalesce(F.col("probability").cast("double"), F.lit(0.0)).alias("probability"),
        F.coalesce("last_ts", "ts", F.lit(0.0)).cast("bigint").alias("timestamp"),
        F.coalesce(F.col("predicted"), F.lit(0)).cast("bigint").alias("predicted_timestep"),
    )
    return rows.distinct().orderBy("timestamp", F.col("probability").desc(), "s", "t")


def round_counters(edges: DataFrame) -> DataFrame:
    """Highest round and last time of a snapshot as one row."""
    return edges.agg(
        F.coalesce(F.max(F.coalesce("predicted", F.lit(0))), F.lit(0)).cast("bigint").alias("max_round"),
        F.coalesce(F.max(edge_end()), F.lit(0.0)).cast("bigint").alias("max_ts"),
    )


def remember_predicted(known: DataFrame, new: DataFrame, family: str) -> DataFrame:
    """Known ``(family, s, t)`` rows plus the new pairs of one family, without duplicates."""
    fresh = new.select(F.lit(family).alias("family"), "s", "t").distinct()
    return known.unionByName(fresh.join(known, ["family", "s", "t"], "left_anti"))


def round_rows(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows that the next round adds to a snapshot; pairs that have a predicted row are left out."""
    now = round_counters(edges).first()
    new = predicted_rows(chosen, now["max_ts"] + 1, now["max_round"] + 1)
    known = edges.filter(F.col("type") == PREDICTED).select("src", "dst")
    return new.join(known, ["src", "dst"], "left_anti").select(*EDGE_COLUMNS)


def append_round(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Snapshot rows plus the pairs of the next round."""
    return edges.select(*EDGE_COLUMNS).unionByName(round_rows(edges, chosen))


def confusion(predicted: DataFrame, test: DataFrame, train: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn and P/R/F1 of directed pairs ``(s, t)``; ``predicted`` has ``probability``."""
    keys = ["s", "t"]
    high = predicted.filter(F.col("probability") >= F.lit(float(threshold))).select(*keys)
    tagged = (
        high.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("e"), F.lit(0).alias("r"))
        .unionByName(test.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("e"), F.lit(0).alias("r")))
        .unionByName(train.select(*keys, F.lit(0).alias("p"), F.lit(0).alias("e"), F.lit(1).alias("r")))
    )
    # one shuffle on the pair instead of three joins
    flags = tagged.groupBy(*keys).agg(F.max("p").alias("p"), F.max("e").alias("e"), F.max("r").alias("r"))
    c = flags.agg(
        F.count_if((F.col("p") == 1) & (F.col("e") == 1)).alias("tp"),
        F.count_if((F.col("p") == 1) & (F.col("e") == 0) & (F.col("r") == 0)).alias("fp"),
        F.count_if((F.col("p") == 0) & (F.col("e") == 1)).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = c.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def top_predicted(predicted: DataFrame, node, k: int = 50) -> DataFrame:
    """Best predicted targets of one node."""
    rows = predicted.filter(F.col("s") == F.lit(node)).select(F.col("t").alias("node"), F.col("probability").alias("score"))
    return first_rows(rows, [F.col("score").desc(), F.col("node").asc()], k)
