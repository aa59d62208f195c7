"""Queries on reading, snapshots and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import clean
from ..operators.blocks import two_hop_counts
from ..sources import files, snapshots
from .base import FEATURES_SQL, Graphs, future_sql, register, with_graph
from .prediction import METRICS_SQL
from .splits import bands_sql

CATALOG: dict = {}


def store(g: Graphs) -> snapshots.SnapshotStore:
    return snapshots.SnapshotStore(g.spark, scratch_path(g.spark, "store"))


@register(
    CATALOG, "s1_read_edges",
    """select 'c' || o_custkey as src, 's' || l_suppkey as dst, o_orderstatus as rel_type, l_quantity::VARCHAR as quantity
    from lineitem join orders on l_orderkey = o_orderkey""",
)
def read_edges(g: Graphs) -> DataFrame:
    raw = g.trade_raw().select(
        F.col("src").alias("Source"), F.col("dst").alias("TARGET"), F.col("o_orderstatus").alias("Rel_Type"),
        F.col("l_quantity").alias("quantity"),
    )
    path = scratch_path(g.spark, "csv")
    raw.write.option("header", True).csv(path)
    return files.read_edges(g.spark, path).select("src", "dst", "rel_type", "quantity")


@register(
    CATALOG, "s2_read_features",
    "select c_custkey::VARCHAR as id, c_nationkey::VARCHAR as nation, c_mktsegment as segment from customer",
)
def read_features(g: Graphs) -> DataFrame:
    path = scratch_path(g.spark, "csv")
    g.table("customer").select(
        F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    ).write.option("header", True).csv(path)
    return files.read_features(g.spark, path)


@register(
    CATALOG, "s3_merge_props",
    with_graph("trade") + f""", f as ({FEATURES_SQL}) select coalesce(n.id, f.id) as id, n.nid::BIGINT as nid,
    f.balance as balance, coalesce(f.nation, case when n.id is not null then -1 end)::INTEGER as nation
    from trade_nodes n full outer join f on n.id = f.id""",
)
def merge_props(g: Graphs) -> DataFrame:
    new = g.features().select("id", "balance", "nation")
    s = store(g)
    s.write_nodes("base", g.nodes("trade").withColumn("nation", F.lit(-1)))
    s.write_nodes("base", new)
    return s.nodes("base").select("id", "nid", "balance", "nation")


def _status_edges(g: Graphs, status: str) -> DataFrame:
    raw = g.trade_raw().filter(F.col("o_orderstatus") == status).select("src", "dst", "ts")
    return clean.timestamp_rollup(raw.withColumn("type", F.lit("REL")))


_STATUS = """select src, dst, 'REL' as type, min(ts) as first_ts, max(ts) as last_ts, count(distinct ts) as n from (
    select 'c' || o_custkey as src, 's' || l_suppkey as dst, (year(l_shipdate) * 12 + month(l_shipdate))::DOUBLE as ts
    from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = '{}') group by src, dst"""


@register(
    CATALOG, "s4_upsert_edges",
    f"""with w as (select *, 1 as turn from ({_STATUS.format("F")}) union all select *, 2 from ({_STATUS.format("O")})
    union all select *, 3 from ({_STATUS.format("P")}))
    select src, dst, arg_max(first_ts, turn) as first_ts, arg_max(last_ts, turn) as last_ts,
    arg_max(n, turn)::BIGINT as interaction_count, 0 as predicted from w group by src, dst""",
)
def upsert_edges(g: Graphs) -> DataFrame:
    s = store(g)
    for status in ("F", "O", "P"):
        s.write_edges("base", _status_edges(g, status))
    return s.edges("base").select("src", "dst", "first_ts", "last_ts", "interaction_count", "predicted")


@register(
    CATALOG, "s5_create_snapshot",
    with_graph("trade", "handoff") + """ select 'dataset-1' as snapshot, src, dst, type, first_ts, last_ts from trade
    union all select 'dataset-2', src, dst, type, first_ts, last_ts from handoff""",
)
def create_snapshot(g: Graphs) -> DataFrame:
    s = store(g)
    for graph in ("trade", "handoff"):
        name = s.create()
        s.write_nodes(name, g.nodes(graph))
        s.write_edges(name, g.edges(graph))
    s.create(name="Named")
    parts = [s.edges(n).select(F.lit(n).alias("snapshot"), "src", "dst", "type", "first_ts", "last_ts") for n in s.list() if s.has(n, "edges")]
    return reduce(DataFrame.unionByName, parts)


@register(
    CATALOG, "s6_use_and_drop_snapshot",
    with_graph("handoff") + " select 'one' as snapshot, id, nid::BIGINT as nid from handoff_nodes",
)
def drop_snapshot(g: Graphs) -> DataFrame:
    s = store(g)
    for name in ("one", "two"):
        s.write_nodes(s.create(name=name), g.nodes("handoff"))
    s.use("one")
    s.drop("two")
    parts = [s.nodes(n).select(F.lit(n).alias("snapshot"), "id", "nid") for n in s.list()]
    return reduce(DataFrame.unionByName, parts)


@register(
    CATALOG, "s7_snapshot_summary",
    with_graph("handoff") + """ select 'nodes' as kind, 'all' as name, count(*) as count from handoff_nodes
    union all select 'edges', 'all', count(*) from handoff
    union all select 'label', 'Entity', count(*) from handoff_nodes
    union all select 'type', type, count(*) from handoff group by type""",
)
def snapshot_summary(g: Graphs) -> DataFrame:
    return snapshots.snapshot_summary(g.nodes("handoff"), g.edges("handoff"))


@register(
    CATALOG, "s8_project_undirected",
    with_graph("handoff") + """ select src, dst, type from handoff where type in ('click', 'purchase')
    union all select dst, src, type from handoff where type in ('click', 'purchase')""",
)
def project_undirected(g: Graphs) -> DataFrame:
    _, e = snapshots.project(g.nodes("handoff"), g.edges("handoff"), types=["click", "purchase"])
    return e.select("src", "dst", "type")



@register(
    CATALOG, "s8_project_reverse",
    with_graph("trade", "supply") + """ select dst as src, src as dst, interaction_count::BIGINT as interaction_count from (
    select * from trade union all select * from supply) where src like 'c%'""",
)
def project_reverse(g: Graphs) -> DataFrame:
    edges = g.edges("trade").unionByName(g.edges("supply"))
    kind = F.when(F.col("id").startswith("c"), "Customer").when(F.col("id").startswith("s"), "Supplier").otherwise("Part")
    nodes = g.both_nodes().select("id", F.array(F.lit("Entity"), kind).alias("labels"))
    _, e = snapshots.project(nodes, edges, labels=["Customer", "Supplier"], orientation="REVERSE")
    return e.select("src", "dst", "interaction_count")


@register(
    CATALOG, "s9_list_projections",
    with_graph("handoff") + """, n as (select count(*) as nodes from handoff_nodes), e as (select count(*) as edges from handoff)
    select 'all_undirected' as projection, nodes as node_count, 2 * edges as edge_count from n, e
    union all select 'all_natural', nodes, edges from n, e""",
)
def list_projections(g: Graphs) -> DataFrame:
    s = store(g)
    for kind in ("UNDIRECTED", "NATURAL"):
        n, e = snapshots.project(g.nodes("handoff"), g.edges("handoff"), orientation=kind)
        s.record_projection("base", f"all_{kind.lower()}", n, e)
    return s.list_projections("base").select("projection", "node_count", "edge_count")


@register(
    CATALOG, "s10_predicted_snapshots",
    future_sql() + " select 'FastRP' as family, 'trade-predicted-FastRP' as snapshot, src, dst, type from future",
)
def predicted_snapshots(g: Graphs) -> DataFrame:
    s = store(g)
    s.write_edges("trade", g.edges("trade"))
    s.write_edges(s.predicted_name("trade", "FastRP"), g.future())
    there = s.predicted_snapshots("trade").filter("present").collect()  # one row per family
    parts = [s.edges(r["snapshot"]).select(F.lit(r["family"]).alias("family"), F.lit(r["snapshot"]).alias("snapshot"), "src", "dst", "type") for r in there]
    return reduce(DataFrame.unionByName, parts)


@register(
    CATALOG, "s8_projected_adjacency",
    with_graph("handoff") + """, bw as (select src as a, dst as b from handoff union select dst, src from handoff)
    select x.a as node, count(*) as walks, count(distinct y.b) as reached from bw x join bw y on y.a = x.b group by x.a""",
)
def projected_adjacency(g: Graphs) -> DataFrame:
    """Ways of two hops per node, from one projection of a snapshot."""
    s = store(g)
    s.write_edges("handoff", g.edges("handoff"))
    s.project_adjacency("handoff")
    return two_hop_counts(s.adjacency("handoff"))


@register(
    CATALOG, "s12_append_run_log",
    # the record holds six places: both sides round once, from the whole value
    """select 'trade' as base_db, 'FastRP' as embedding_family, 100.0::DOUBLE as predict_k, 0.5::DOUBLE as prob_threshold, round(auc, 6) as test_auc,
    round(ap, 6) as test_ap, round(accuracy, 6) as test_accuracy, round(precision, 6) as test_precision, round(recall, 6) as test_recall,
    round(f1, 6) as test_f1 from (""" + METRICS_SQL.replace(", 8)", ", 15)") + ")",
)
def run_log(g: Graphs) -> DataFrame:
    from ..operators.linkpred import binary_metrics

    s = store(g)
    m = binary_metrics(g.scored()).first()
    s.append_run_log(
        {"base_db": "trade", "embedding_family": "FastRP", "predict_k": 100, "prob_threshold": 0.5,
         **{f"test_{c}": m[c] for c in ("auc", "ap", "accuracy", "precision", "recall", "f1")}}
    )
    measures = [f"test_{c}" for c in ("auc", "ap", "accuracy", "precision", "recall", "f1")]
    return s.run_log().select("base_db", "embedding_family", "predict_k", "prob_threshold", *measures)


@register(
    CATALOG, "s13_reuse_split",
    with_graph("trade") + bands_sql("trade", 0.1, 0.1) + """ select 'rebuild' as first, 'reuse' as same, 'locked' as other, src, dst, set from split""",
)
def reuse_split(g: Graphs) -> DataFrame:
    from ..operators.splits import temporal_split

    s = store(g)
    steps = {"first": s.reuse_split("trade", True, 0.1, 0.1)[0]}
    s.write("trade-split", "edges", temporal_split(g.edges("trade"), 0.1, 0.1))
    s.remember_split("trade", True, 0.1, 0.1, "trade-split")
    steps["same"], name = s.reuse_split("trade", True, 0.1, 0.1)
    steps["other"] = s.reuse_split("trade", True, 0.2, 0.1)[0]
    return s.edges(name).select(*[F.lit(v).alias(k) for k, v in steps.items()], "src", "dst", "set")


