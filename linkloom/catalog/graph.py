"""Queries on graph primitives and path templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators.contraction import components_by_contraction
from ..operators.splits import temporal_split
from ..plans.flagship import held_out_support
from .base import Graphs, register, with_graph
from .cleaning import COMPONENTS_SQL
from .splits import bands_sql

CATALOG: dict = {}

_BOTH = ", bw as (select src as a, dst as b from {g} union select dst, src from {g})"


@register(CATALOG, "g1_degree", with_graph("trade") + _BOTH.format(g="trade") + " select a as node, count(*) as degree from bw group by a")
def degree(g: Graphs) -> DataFrame:
    return gr.degree(g.edges("trade"))


@register(
    CATALOG, "g2_connected_components",
    with_graph("reorder", recursive=True) + COMPONENTS_SQL.format(g="reorder") + " select node, component from components",
)
def connected_components(g: Graphs) -> DataFrame:
    return components_by_contraction(g.edges("reorder"))


@register(
    CATALOG, "g3_bfs",
    with_graph("trade", recursive=True) + _BOTH.format(g="trade") + """, walk as (select 'c1' as node, 0 as depth
    union select b, depth + 1 from walk join bw on node = a where depth < 6),
    lv as (select node, min(depth) as depth from walk group by node)
    select l.node, min(m.node) as parent, l.depth from lv l left join bw on bw.a = l.node
    left join lv m on m.node = bw.b and m.depth = l.depth - 1 group by l.node, l.depth""",
)
def bfs(g: Graphs) -> DataFrame:
    return gr.bfs(g.adjacency("trade"), g.spark.createDataFrame([("c1",)], "node string"), 6)


@register(
    CATALOG, "g4_neighborhood",
    with_graph("trade") + _BOTH.format(g="trade") + " select b as node from bw where a = 's1' order by b limit 100",
)
def neighborhood(g: Graphs) -> DataFrame:
    return gr.neighborhood(g.edges("trade"), "s1", 100)


@register(
    CATALOG, "g5_shortest_path",
    with_graph("trade", recursive=True) + _BOTH.format(g="trade") + """, walk as (select 'c1' as node, 0 as depth
    union select b, depth + 1 from walk join bw on node = a where depth < 6)
    select min(depth) as hops from walk where node = 'c2'""",
)
def shortest_path(g: Graphs) -> DataFrame:
    return gr.shortest_path(g.adjacency("trade"), "c1", "c2").agg(F.max("step").alias("hops"))


@register(
    CATALOG, "g6_common_neighbor_counts",
    with_graph("handoff") + _BOTH.format(g="handoff") + bands_sql("handoff", 0.1, 0.1) + """,
    held as (select distinct src, dst from split where set = 'test')
    select src as s, dst as t, count(*) as common from held join bw x on x.a = src join bw y on y.a = dst and y.b = x.b group by 1, 2""",
)
def common_neighbor_counts(g: Graphs) -> DataFrame:
    held = temporal_split(g.edges("handoff"), 0.1, 0.1).filter(F.col("set") == "test")
    return gr.common_neighbor_counts(g.adjacency("handoff"), held.select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct())


@register(
    CATALOG, "g6_common_neighbors_of_two",
    with_graph("handoff") + """, e as (select src as a, dst as b from handoff union all select dst, src from handoff)
    select x.b as node, count(*) as count from e x join e y on x.b = y.b where x.a = '1' and y.a = '2' group by 1
    order by 2 desc, 1 limit 25""",
)
def common_neighbors_of_two(g: Graphs) -> DataFrame:
    return gr.shared_with(g.edges("handoff"), "1", "2")


@register(
    CATALOG, "g7_one_hop_paths",
    with_graph("trade") + """ select src, dst, type from (select src, dst, type from trade union all select dst, src, type from trade)
    order by src, dst, type limit 500""",
)
def one_hop_paths(g: Graphs) -> DataFrame:
    return gr.one_hop_paths(g.edges("trade").select("src", "dst", "type"))


@register(
    CATALOG, "held_out_support",
    with_graph("handoff") + bands_sql("handoff", 0.1, 0.1) + """, tr as (select distinct src, dst from split where set = 'train'),
    bw as (select src as a, dst as b from tr union select dst, src from tr),
    c as (select p.src, p.dst, count(*) as common from (select distinct src, dst from split) p join bw x on x.a = p.src
    join bw y on y.a = p.dst and y.b = x.b group by p.src, p.dst)
    select set, count(*) as pairs, sum(interaction_count)::BIGINT as interactions, count(common) as supported_pairs,
    coalesce(sum(common), 0)::BIGINT as shared_neighbors from split left join c using (src, dst) group by set""",
)
def flagship(g: Graphs) -> DataFrame:
    return held_out_support(g.edges("handoff"))
