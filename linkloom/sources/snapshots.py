"""Named snapshots: a folder per snapshot with versioned ``nodes`` and ``edges`` tables.

A write makes a new version folder and readers take the newest finished one, so a job
may read and replace the same table, and a failed write leaves the old version alone.
Tables that are upserted lie in parts by a hash of their key (:mod:`.parted`); an upsert
rewrites the parts that it touches.  The two kinds of versions are numbered together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import list_dirs, path_exists, remove_path
from ..functions.skew import keep_ends
from .adjacency import Adjacency, load_adjacency, save_adjacency
from .parted import Merge, PartedTable

# What makes an edge row unique.
EDGE_KEYS = ["src", "dst", "type"]
# The five embedding families, in display order.
FAMILIES = ["FastRP", "Node2Vec", "GraphSAGE", "HashGNN", "TGN"]
# Names that cannot be dropped.
RESERVED = {"system", "default"}


class SnapshotStore:
    """Snapshots below one root folder on storage that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.current = spark, root.rstrip("/"), None

    # -- names ---------------------------------------------------------------
    def list(self) -> list[str]:
        return [d for d in list_dirs(self.spark, self.root) if not d.startswith("_")]

    def exists(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.root}/{name}")

    def create(self, prefix: str = "dataset", name: str | None = None) -> str:
        """Explicit lower-cased name (error if taken), else ``prefix-N`` with N = max + 1."""
        taken = set(self.list())
        if name is not None:
            chosen = name.strip().lower()
            if not chosen:
                raise ValueError("the snapshot name is empty")
            if chosen in taken:
                raise ValueError(f"snapshot '{chosen}' exists already")
        else:
            numbers = [int(m.group(1)) for t in taken if (m := re.fullmatch(re.escape(prefix) + r"-(\d+)", t))]
            chosen = f"{prefix}-{max(numbers, default=0) + 1}".lower()
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{chosen}")
        fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(fs_path)
        return chosen

    def use(self, name: str) -> str:
        if not self.exists(name):
            raise ValueError(f"no snapshot '{name}'")
        self.current = name
        return name

    def drop(self, name: str) -> bool:
        """Refuses reserved names and the current snapshot; an absent one is no error."""
        if name in RESERVED:
            raise ValueError(f"'{name}' is reserved")
        if name == self.current:
            raise ValueError(f"'{name}' is in use")
        if not self.exists(name):
            return False
        return remove_path(self.spark, f"{self.root}/{name}")

    @staticmethod
    def predicted_name(base: str, family: str) -> str:
        return f"{base}-predicted-{family}"

    def predicted_snapshots(self, base: str) -> DataFrame:
        rows = [(f, self.predicted_name(base, f), self.exists(self.predicted_name(base, f))) for f in FAMILIES]
        return self.spark.createDataFrame(rows, "family string, snapshot string, present boolean")

    def snapshot_pair(self, base: str, family: str) -> tuple[str, str]:
        return base, self.predicted_name(base, family)

    # -- tables --------------------------------------------------------------
    def _versions(self, name: str, table: str) -> list[str]:
        where = f"{self.root}/{name}/{table}"
        done = [v for v in list_dirs(self.spark, where) if v.startswith("v=") and path_exists(self.spark, f"{where}/{v}/_SUCCESS")]
        return [f"{where}/{v}" for v in done]

    def write(self, name: str, table: str, df: DataFrame, partition_by: str | None = None) -> str:
        versions = list_dirs(self.spark, f"{self.root}/{name}/{table}")
        plain = max((int(v[2:]) for v in versions if re.fullmatch(r"v=\d+", v)), default=0)
        number = max(plain, self.parted(name, table).last_number()) + 1
        path = f"{self.root}/{name}/{table}/v={number:06d}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return path

    def parted(self, name: str, table: str) -> PartedTable:
        return PartedTable(self.spark, f"{self.root}/{name}/{table}")

    def _newest(self, name: str, table: str) -> tuple[int, int]:
        """Numbers of the newest whole version and of the newest one in parts, 0 without any."""
        plain, parts = self._versions(name, table), self.parted(name, table).versions()
        return int(plain[-1].rsplit("=", 1)[1]) if plain else 0, parts[-1] if parts else 0

    def read(self, name: str, table: str) -> DataFrame:
        plain, parts = self._newest(name, table)
        if not plain and not parts:
            raise ValueError(f"snapshot '{name}' has no {table}")
        if parts > plain:
            return self.parted(name, table).read(parts)
        return self.spark.read.parquet(f"{self.root}/{name}/{table}/v={plain:06d}")

    def has(self, name: str, table: str) -> bool:
        return any(self._newest(name, table))

    def upsert(self, name: str, table: str, new: DataFrame, keys: list[str], merge: Merge) -> None:
        """Merge rows with unique ``keys``; a table that does not lie in parts yet is dealt into them once."""
        plain, parts = self._newest(name, table)
        if not parts or plain > parts:
            self.parted(name, table).create(self.read(name, table), keys, above=plain)
        self.parted(name, table).upsert(new, merge)

    def nodes(self, name: str) -> DataFrame:
        return self.read(name, "nodes")

    def edges(self, name: str) -> DataFrame:
        return self.read(name, "edges")

    def write_nodes(self, name: str, new: DataFrame) -> None:
        """Upsert on ``id``."""
        if self.has(name, "nodes"):
            self.upsert(name, "nodes", new, ["id"], merge_props)
        else:
            self.parted(name, "nodes").create(new, ["id"])

    def write_edges(self, name: str, new: DataFrame) -> None:
        """Upsert per (src, dst, type), stamping observed rows with ``predicted = 0``."""
        if self.has(name, "edges"):
            self.upsert(name, "edges", new, EDGE_KEYS, upsert_edges)
        else:
            self.parted(name, "edges").create(stamp_observed(new), EDGE_KEYS)

    def append_edges(self, name: str, new: DataFrame) -> None:
        """Add rows whose keys are new."""
        self.upsert(name, "edges", new, EDGE_KEYS, lambda old, rows: old.unionByName(rows, allowMissingColumns=True))

    # -- projections and records ----------------------------------------------
    def record_projection(self, name: str, projection: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Keep name, counts, time and schema of a projection."""
        values = (projection, nodes.count(), edges.count(), nodes.schema.simpleString(), edges.schema.simpleString())
        row = self.spark.createDataFrame(
            [values],
            "projection string, node_count bigint, edge_count bigint, node_schema string, edge_schema string",
        ).withColumn("created_at", F.current_timestamp())
        row.write.mode("append").parquet(f"{self.root}/{name}/_projections")

    def list_projections(self, name: str) -> DataFrame:
        """Newest record per projection name."""
        rows = self.spark.read.parquet(f"{self.root}/{name}/_projections")
        newest = F.max_by(F.struct(*rows.columns), "created_at").alias("r")
        return rows.groupBy(F.col("projection").alias("p")).agg(newest).select("r.*")

    def project_adjacency(self, name: str, types: list[str] | None = None) -> Adjacency:
        """Write both directions of a snapshot's edges, dealt by node, once for all loops and sessions that read them."""
        edges = self.edges(name)
        edges = edges.filter(F.col("type").isin(types)) if types else edges
        number = len(list_dirs(self.spark, f"{self.root}/{name}/_adjacency")) + 1
        return save_adjacency(edges, f"{self.root}/{name}/_adjacency/{number:06d}")

    def adjacency(self, name: str) -> Adjacency:
        """The newest whole projection of :meth:`project_adjacency`."""
        folder = f"{self.root}/{name}/_adjacency"
        done = [d for d in list_dirs(self.spark, folder) if path_exists(self.spark, f"{folder}/{d}/about/_SUCCESS")]
        if not done:
            raise ValueError(f"snapshot '{name}' has no adjacency")
        return load_adjacency(self.spark, f"{folder}/{done[-1]}")

    def append_run_log(self, row: dict) -> None:
        self.spark.createDataFrame([run_log_row(row)], RUN_LOG_SCHEMA).write.mode("append").parquet(
            f"{self.root}/_run_log"
        )

    def run_log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_run_log")

    # -- remembered splits -----------------------------------------------------
    def remember_split(self, base: str, temporal: bool, test: float, val: float, split: str) -> None:
        row = [(base, temporal, round(test, 6), round(val, 6), split)]
        self.spark.createDataFrame(
            row, "base string, temporal boolean, test double, val double, split string"
        ).withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/_splits")

    def reuse_split(self, base: str, temporal: bool, test: float, val: float) -> tuple[str, str | None]:
        """``('reuse', split)``, ``('rebuild', None)`` or ``('locked', split)`` if settings differ."""
        if not path_exists(self.spark, f"{self.root}/_splits"):
            return "rebuild", None
        known = self.spark.read.parquet(f"{self.root}/_splits").filter(F.col("base") == base)
        last = known.orderBy(F.col("recorded_at").desc()).limit(1).collect()
        if not last or not self.exists(last[0]["split"]):
            return "rebuild", None
        same = (last[0]["temporal"], last[0]["test"], last[0]["val"]) == (temporal, round(test, 6), round(val, 6))
        return ("reuse" if same else "locked"), last[0]["split"]


# Columns of the run record, in order, with their types.
RUN_LOG_COLUMNS = [
    ("timestamp_utc", "string"),
    ("base_db", "string"),
    ("embedding_family", "string"),
    ("embedding_property", "string"),
    ("predict_k", "double"),
    ("prob_threshold", "double"),
    ("predicted_db_name", "string"),
    ("split_recorded_at_utc", "string"),
    ("split_seconds", "double"),
    ("split_temporal_mode", "string"),
    ("split_test_holdout", "double"),
    ("split_val_holdout", "double"),
    ("embedding_seconds", "double"),
    ("link_prediction_seconds", "double"),
    ("predicted_db_creation_seconds", "double"),
    ("predicted_graph_projection_seconds", "double"),
    ("materialize_prediction_db_seconds", "double"),
    ("test_auc", "double"),
    ("test_ap", "double"),
    ("test_accuracy", "double"),
    ("test_precision", "double"),
    ("test_recall", "double"),
    ("test_f1", "double"),
]
RUN_LOG_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in RUN_LOG_COLUMNS)


def run_log_row(row: dict) -> tuple:
    """All columns in order, numbers rounded to six places, missing ones null."""
    kept = {c: row.get(c) for c, _ in RUN_LOG_COLUMNS}
    return tuple(
        None if kept[c] is None else str(kept[c]) if kind == "string" else round(float(kept[c]), 6) for c, kind in RUN_LOG_COLUMNS
    )


def merge_props(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Upsert nodes: every non-null new value replaces the old one."""
    columns = [c for c in old.columns if c != key] + [c for c in new.columns if c != key and c not in old.columns]
    o, n = old.alias("o"), new.alias("n")

    def value(c: str):
        if c in old.columns and c in new.columns:
            return F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c)
        return F.col(f"n.`{c}`" if c in new.columns else f"o.`{c}`").alias(c)

    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[value(c) for c in columns])


def stamp_observed(edges: DataFrame) -> DataFrame:
    predicted = F.coalesce("predicted", F.lit(0)) if "predicted" in edges.columns else F.lit(0)
    return edges.withColumn("predicted", predicted.cast("int"))


def upsert_edges(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    """Upsert per (src, dst, type); the keys are unique, so the join has no hot group."""
    new = stamp_observed(new)
    extra = [c for c in new.columns if c not in old.columns]
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    out = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    for c in [*old.columns, *extra]:
        if c in keys:
            continue
        if c in new.columns and c in old.columns:
            out.append(F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c))
        else:
            out.append(F.col(f"n.`{c}`" if c in new.columns else f"o.`{c}`").alias(c))
    return o.join(n, cond, "full_outer").select(*out)


def snapshot_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes, edges, labels and edge types as (kind, name, count) rows."""
    labels = (
        nodes.select(F.explode("labels").alias("name"))
        if "labels" in nodes.columns
        else nodes.select(F.lit("Entity").alias("name"))
    )
    count = F.count(F.lit(1)).alias("count")
    parts = [
        nodes.agg(count).select(F.lit("nodes").alias("kind"), F.lit("all").alias("name"), "count"),
        edges.agg(count).select(F.lit("edges").alias("kind"), F.lit("all").alias("name"), "count"),
        labels.groupBy("name").agg(count).select(F.lit("label").alias("kind"), "name", "count"),
        edges.groupBy(F.col("type").alias("name")).agg(count).select(F.lit("type").alias("kind"), "name", "count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project(
    nodes: DataFrame,
    edges: DataFrame,
    labels: list[str] | None = None,
    types: list[str] | None = None,
    orientation: str = "UNDIRECTED",
    props: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Subgraph by labels and types; UNDIRECTED emits both directions, REVERSE swaps them."""
    if labels and "labels" in nodes.columns:
        nodes = nodes.filter(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])))
        edges = keep_ends(edges, nodes.select("id"))
    if types:
        edges = edges.filter(F.col("type").isin(types))
    if props is not None:
        nodes = nodes.select("id", *[c for c in props if c in nodes.columns])
    swapped = edges.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst")
    if orientation == "REVERSE":
        edges = swapped.select(*edges.columns)
    elif orientation == "UNDIRECTED":
        edges = edges.unionByName(swapped)
    elif orientation != "NATURAL":
        raise ValueError(f"unknown orientation '{orientation}'")
    return nodes, edges
