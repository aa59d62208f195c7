"""Queries that ask the present and the predicted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import query as qu
from .base import Graphs, future_sql, register, with_graph

CATALOG: dict = {}


def _present(g: Graphs):
    return g.nodes("trade"), g.edges("trade")


def _future(g: Graphs):
    return g.both_nodes(), g.future()


@register(
    CATALOG, "q1_query_present",
    with_graph("trade") + """ select dst as supplier, count(*) as customers, sum(interaction_count)::BIGINT as interactions from trade
    where first_ts >= 23970 group by dst""",
)
def query_present(g: Graphs) -> DataFrame:
    text = """select dst as supplier, count(*) as customers, sum(interaction_count) as interactions from {edges}
        where first_ts >= :from group by dst"""
    return qu.query_present(_present(g), text, {"from": 23970.0})


@register(
    CATALOG, "q2_query_future",
    future_sql() + """, n as (select id from trade_nodes union select id from supply_nodes)
    select n.id, count(*) as links, max(probability) as best from future join n on n.id = dst
    where predicted > 0 and probability >= 0.95 group by n.id""",
)
def query_future(g: Graphs) -> DataFrame:
    text = """select n.id, count(*) as links, max(probability) as best from {edges} e join {nodes} n on n.id = e.dst
        where predicted > 0 and probability >= :thr group by n.id"""
    return qu.query_future(_future(g), text, threshold=0.95)


@register(
    CATALOG, "q3_query_both",
    future_sql() + """ select 'present' as side, dst, count(*) as links from trade where first_ts <= 24021 group by dst
    union all select 'future', dst, count(*) from future where first_ts <= 24021 group by dst""",
)
def query_both(g: Graphs) -> DataFrame:
    text = "select dst, count(*) as links from {edges} where first_ts <= :t group by dst"
    present, future = qu.query_both(_present(g), _future(g), text, as_of=24021.0)
    return present.select(F.lit("present").alias("side"), "*").unionByName(future.select(F.lit("future").alias("side"), "*"))


_EDGE_TEXT = """select struct(concat_ws('|', type, src, dst) as id, src as source, dst as target, type, first_ts) as r
    from {edges} where dst = :node"""


@register(
    CATALOG, "q4_query_both_graph",
    future_sql() + """, p as (select * from trade where dst = 's5' and first_ts <= 23980), f as (select * from future where dst = 's5' and first_ts <= 23980)
    select 'present' as side, 'edge' as kind, 'REL|' || src || '|' || dst as id from p union all
    select 'future', 'edge', type || '|' || src || '|' || dst from f union all
    select distinct 'present', 'node', unnest([src, dst]) from p union all select distinct 'future', 'node', unnest([src, dst]) from f""",
)
def query_both_graph(g: Graphs) -> DataFrame:
    sides = qu.query_both(_present(g), _future(g), _EDGE_TEXT, {"node": "s5"}, as_of=23980.0, mode="graph")
    out = None
    for side, (nodes, edges) in zip(("present", "future"), sides):
        for kind, rows in (("node", nodes), ("edge", edges)):
            part = rows.select(F.lit(side).alias("side"), F.lit(kind).alias("kind"), "id")
            out = part if out is None else out.unionByName(part)
    return out


@register(
    CATALOG, "q5_as_of",
    with_graph("trade") + """ select src as id, 'edge' as kind, dst from trade where first_ts <= 23960 union all
    select distinct unnest([src, dst]), 'node', null from trade where first_ts <= 23960""",
)
def as_of(g: Graphs) -> DataFrame:
    nodes, edges = qu.as_of_graph(*_present(g), 23960.0)
    return edges.select(F.col("src").alias("id"), F.lit("edge").alias("kind"), "dst").unionByName(
        nodes.select("id", F.lit("node").alias("kind"), F.lit(None).cast("string").alias("dst"))
    )


_WALKS = """, {n}_step as (select src, dst, type || '|' || src || '|' || dst as id from {n}),
    {n}_walk as (select id as node, id as nodes, [''] as ids, 0 as hops from (select src as id from {n} union select dst from {n})
    union all select s.dst, w.nodes || ' ' || s.dst, list_append(w.ids, s.id), w.hops + 1 from {n}_walk w join {n}_step s on s.src = w.node
    where w.hops < 3 and not list_contains(w.ids, s.id))"""


@register(
    CATALOG, "q3_variable_paths",
    with_graph("reorder", recursive=True) + ", early as (select * from reorder where first_ts <= 23970)" + _WALKS.format(n="reorder") + _WALKS.format(n="early") + """
    select 'present' as side, nodes, hops from early_walk where hops >= 2 union all select 'future', nodes, hops from reorder_walk where hops >= 2""",
)
def variable_paths(g: Graphs) -> DataFrame:
    """Chains of two and three orders that follow each other, before a month and over all months."""
    from ..operators.clean import nodes_from_edges

    late = g.edges("reorder")
    out = None
    for side, edges in (("present", late.filter("first_ts <= 23970")), ("future", late)):
        paths = qu.ask_paths((nodes_from_edges(edges), edges), 2, 3, undirected=False)
        part = paths.select(F.lit(side).alias("side"), F.array_join(F.transform("nodes", lambda x: x["id"]), " ").alias("nodes"), "hops")
        out = part if out is None else out.unionByName(part)
    return out


def _order_paths(g: Graphs) -> DataFrame:
    """Paths of three consecutive orders of a customer; every order has one successor at most."""
    e = g.reorder_raw().filter(F.col("rel_type") == "next")
    a = e.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("rel_type").alias("type"))
    b = e.select(F.col("src").alias("y"), F.col("dst").alias("z"), F.col("rel_type").alias("type2"))
    node = lambda c: F.struct(F.col(c).alias("id"), F.lit("Entity").alias("label"))
    link = lambda s, t, k: F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.col(k).alias("type"))
    return a.join(b, "y").select(
        F.array(node("x"), node("y"), node("z")).alias("nodes"), F.array(link("x", "y", "type"), link("y", "z", "type2")).alias("edges")
    )


_PATHS_SQL = """with p as (select x::VARCHAR as x, y::VARCHAR as y, z::VARCHAR as z from (
    select lag(o_orderkey, 2) over w as x, lag(o_orderkey) over w as y, o_orderkey as z from orders
    window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where x is not null)"""


@register(
    CATALOG, "q6_path_to_graph",
    _PATHS_SQL + """ select 'node' as kind, id from (select x as id from p union select y from p union select z from p)
    union all select 'edge', id from (select 'next|' || x || '|' || y as id from p union select 'next|' || y || '|' || z from p)""",
)
def path_to_graph(g: Graphs) -> DataFrame:
    nodes, edges = qu.path_to_graph(_order_paths(g))
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), "id"))


@register(
    CATALOG, "q7_rows_to_graph",
    with_graph("handoff") + """ select distinct 'node' as kind, unnest([src, dst]) as id, null::VARCHAR as label from handoff
    union all select distinct 'edge', type || '|' || src || '|' || dst, null from handoff""",
)
def rows_to_graph(g: Graphs) -> DataFrame:
    e = g.edges("handoff")
    rows = e.select(
        F.struct(F.col("src").alias("id"), F.lit(None).cast("string").alias("label")).alias("a"),
        F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type").alias("r"),
        F.lit(1).alias("n"),
    )
    nodes, edges = qu.rows_to_graph(rows)
    return nodes.select(F.lit("node").alias("kind"), "id", "label").unionByName(
        edges.select(F.lit("edge").alias("kind"), "id", F.lit(None).cast("string").alias("label"))
    )


@register(
    CATALOG, "q8_edge_view",
    future_sql() + """ select type || '|' || src || '|' || dst as id, src as source, dst as target, type, predicted::BIGINT as predicted,
    predicted::BIGINT as predicted_timestep, probability, last_ts::BIGINT as timestamp, first_ts::BIGINT as first_ts, last_ts::BIGINT as last_ts from future""",
)
def edge_view(g: Graphs) -> DataFrame:
    return qu.edge_view(g.future())


@register(
    CATALOG, "q9_snapshot_pair",
    future_sql() + """ select 'trade' as snapshot, src, dst, type from trade
    union all select 'trade-predicted-FastRP', src, dst, type from future""",
)
def snapshot_pair(g: Graphs) -> DataFrame:
    from ..functions.scratch import scratch_path
    from ..sources.snapshots import SnapshotStore

    s = SnapshotStore(g.spark, scratch_path(g.spark, "store"))
    base, future = s.snapshot_pair("trade", "FastRP")
    s.write_edges(base, g.edges("trade"))
    s.write_edges(future, g.future())
    one, two = (s.edges(n).select(F.lit(n).alias("snapshot"), "src", "dst", "type") for n in (base, future))
    return one.unionByName(two)


@register(
    CATALOG, "q10_diff",
    future_sql() + """, a as (select src, type, count(*) as links from trade where src not like 'p%' group by all),
    b as (select dst as src, type, count(*) as links from future group by all union all select src, type, count(*) from trade where last_ts > 23960 group by all)
    select *, 'present' as side, 1::BIGINT as copies from (select * from a except all select * from b) union all
    select *, 'future', 1 from (select * from b except all select * from a) union all
    select *, 'both', 1 from (select * from a intersect all select * from b)""",
)
def diff(g: Graphs) -> DataFrame:
    trade = g.edges("trade")
    links = F.count(F.lit(1)).alias("links")
    a = trade.filter(~F.col("src").startswith("p")).groupBy("src", "type").agg(links)
    b = g.future().groupBy(F.col("dst").alias("src"), "type").agg(links).unionByName(
        trade.filter(F.col("last_ts") > 23960).groupBy("src", "type").agg(links)
    )
    return qu.diff(a, b)
