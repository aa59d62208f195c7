"""Queries on splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import splits as sp
from ..operators.graph import mirror, undirected_pairs
from .base import Graphs, h60, list_text, register, times_sql, with_graph
from .cleaning import COMPONENTS_SQL

CATALOG: dict = {}


def _draw(seed: str) -> str:
    return h60(f"'{seed}'", "src", "dst")


def bands_sql(g: str, test: float, val: float) -> str:
    """CTEs: per pair the joined times, and the set of every time."""
    return f""", pt as (select distinct src, dst, unnest(timestamps) as ts from {g}),
    tt as (select ts, row_number() over (order by ts desc) - 1 as back, count(*) over () as n from (select distinct ts from pt)),
    bands as (select ts, case when back < ceil(n * {test}) then 'test'
    when back < ceil(n * {test}) + least(ceil(n * {val}), n - ceil(n * {test})) then 'val' else 'train' end as set from tt),
    split as (select src, dst, set, list_sort(list(ts)) as timestamps, min(ts) as first_ts, max(ts) as last_ts,
    count(*) as interaction_count from pt join bands using (ts) group by src, dst, set)"""


FOREST_SQL = COMPONENTS_SQL.format(g="reorder") + """,
    pairs as (select distinct src, dst from reorder),
    walk as (select distinct component as node, 0 as depth from components
    union select b.b, w.depth + 1 from walk w join both_ways b on w.node = b.a where w.depth < 24),
    level as (select node, min(depth) as depth from walk group by node),
    tree as (select l.node, min(b.b) as parent from level l join both_ways b on l.node = b.a
    join level m on m.node = b.b and m.depth = l.depth - 1 group by l.node),
    forest as (select p.src, p.dst from pairs p join tree t on (t.node = p.src and t.parent = p.dst) or (t.node = p.dst and t.parent = p.src))"""


@register(CATALOG, "p1_undirected_pairs", with_graph("handoff") + " select distinct src, dst from handoff")
def pairs(g: Graphs) -> DataFrame:
    return undirected_pairs(g.edges("handoff"))


@register(
    CATALOG, "p2_random_split",
    with_graph("trade") + f""", r as (select src, dst, row_number() over (order by {_draw("7")}, src, dst) - 1 as place,
    count(*) over () as n from (select distinct src, dst from trade))
    select src, dst, case when place < floor(n * 0.1) then 'test' when place < floor(n * 0.1) + floor(n * 0.2) then 'val'
    else 'train' end as set from r""",
)
def random_split(g: Graphs) -> DataFrame:
    return sp.random_split(g.edges("trade"), 0.1, 0.2, 7)


@register(
    CATALOG, "p3_connected_split",
    with_graph("reorder", recursive=True) + FOREST_SQL + f""", n as (select count(*) as n from pairs),
    r as (select src, dst, row_number() over (order by {_draw("7")}, src, dst) - 1 as place from pairs
    where (src, dst) not in (select src, dst from forest))
    select src, dst, case when place < floor(n * 0.1) then 'test' when place < floor(n * 0.1) + floor(n * 0.05) then 'val'
    else 'train' end as set from r, n union all select src, dst, 'train' from forest""",
)
def connected_split(g: Graphs) -> DataFrame:
    return sp.connected_split(g.edges("reorder"), 0.1, 0.05, 7, forest="levels")


@register(CATALOG, "p4_spanning_forest", with_graph("reorder", recursive=True) + FOREST_SQL + " select src, dst from forest")
def spanning_forest(g: Graphs) -> DataFrame:
    return sp.spanning_forest(g.edges("reorder"))


# a pair is in the forest if no way of earlier pairs joins its ends
_DRAWN_SQL = f""", e as (select src, dst, row_number() over (order by {_draw("7")}, src, dst) - 1 as e from (select distinct src, dst from reorder)),
    bw as (select src as a, dst as b, e from e union all select dst, src, e from e),
    way as (select e as top, src as node from e union select top, bw.b from way join bw on bw.a = node and bw.e < top),
    forest as (select src, dst, e from e where not exists (select 1 from way where top = e.e and node = e.dst))"""


@register(CATALOG, "p4_drawn_forest", with_graph("reorder", recursive=True) + _DRAWN_SQL + " select src, dst from forest")
def drawn_forest(g: Graphs) -> DataFrame:
    return sp.drawn_forest(g.edges("reorder"), 7)[1].select("src", "dst")


@register(
    CATALOG, "p3_connected_split_drawn",
    with_graph("reorder", recursive=True) + _DRAWN_SQL + """, n as (select count(*) as n from e),
    r as (select src, dst, row_number() over (order by e) - 1 as place from e where e not in (select e from forest))
    select src, dst, case when place < floor(n * 0.1) then 'test' when place < floor(n * 0.1) + floor(n * 0.05) then 'val'
    else 'train' end as set from r, n union all select src, dst, 'train' from forest""",
)
def connected_split_drawn(g: Graphs) -> DataFrame:
    return sp.connected_split(g.edges("reorder"), 0.1, 0.05, 7)


@register(
    CATALOG, "p5_stitch_components",
    with_graph("reorder", recursive=True) + COMPONENTS_SQL.format(g="reorder") + """,
    hub as (select component as h from components group by component order by count(*) desc, component limit 1)
    select distinct least(component, h) as src, greatest(component, h) as dst, true as synthetic from components, hub where component <> h""",
)
def stitch(g: Graphs) -> DataFrame:
    return sp.stitch_components(g.edges("reorder"))


_SPLIT_OUT = f" select src, dst, set, {times_sql('timestamps')} as times, first_ts, last_ts, interaction_count from split"


def _out(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "set", list_text("timestamps").alias("times"), "first_ts", "last_ts", "interaction_count")


@register(CATALOG, "p6_temporal_split", with_graph("trade") + bands_sql("trade", 0.1, 0.1) + _SPLIT_OUT)
def temporal_split(g: Graphs) -> DataFrame:
    return _out(sp.temporal_split(g.edges("trade"), 0.1, 0.1))


@register(CATALOG, "p6_temporal_split_types", with_graph("handoff") + bands_sql("handoff", 0.2, 0.15) + _SPLIT_OUT)
def temporal_split_types(g: Graphs) -> DataFrame:
    return _out(sp.temporal_split(g.edges("handoff"), 0.2, 0.15))


@register(
    CATALOG, "p6_temporal_chunk_split",
    with_graph("handoff") + bands_sql("handoff", 0.2, 0.15) + """ select src, dst, set, floor(ts / 7)::BIGINT as chunk,
    array_to_string([x::BIGINT::VARCHAR for x in list_sort(list(ts))], ',') as times, min(ts) as first_ts, max(ts) as last_ts, count(*) as n
    from pt join bands using (ts) group by src, dst, set, floor(ts / 7)""",
)
def temporal_chunk_split(g: Graphs) -> DataFrame:
    made = ch.temporal_chunk_split(ch.joined_types(_weeks(g)), 0.2, 0.15)
    return made.select("src", "dst", "set", "chunk", list_text("timestamps").alias("times"), "first_ts", "last_ts", "n")


def _weeks(g: Graphs) -> DataFrame:
    """Times of ``handoff`` in chunks of a week."""
    return ch.time_chunks(g.edges("handoff").select("src", "dst", "type", F.explode("timestamps").alias("ts")), 7)


_SLICE = "(select min(ts) + 20 from (select unnest(timestamps) as ts from handoff)) and (select min(ts) + 61 from (select unnest(timestamps) as ts from handoff))"


@register(
    CATALOG, "e7_time_slice_of_chunks",
    with_graph("handoff") + f""", t as (select src, dst, type, unnest(timestamps) as ts from handoff)
    select src, dst, type, min(ts) as first_ts, max(ts) as last_ts, count(*) as interaction_count from t where ts between {_SLICE} group by 1, 2, 3""",
)
def time_slice_of_chunks(g: Graphs) -> DataFrame:
    weeks = _weeks(g)
    low = g.edges("handoff").agg(F.min("first_ts").alias("low")).first()["low"]
    return ch.rollup(ch.time_slice(weeks, low + 20, low + 61))


@register(
    CATALOG, "p7_temporal_split_explicit",
    with_graph("trade") + """, pt as (select distinct src, dst, unnest(timestamps) as ts from trade),
    split as (select src, dst, case when ts in (23990, 23995) then 'test' when ts in (23980, 23990) then 'val' else 'train' end as set,
    list_sort(list(ts)) as timestamps, min(ts) as first_ts, max(ts) as last_ts, count(*) as interaction_count from pt group by 1, 2, 3)"""
    + _SPLIT_OUT,
)
def temporal_split_explicit(g: Graphs) -> DataFrame:
    return _out(sp.temporal_split(g.edges("trade"), test_times=[23990, 23995, 99999], val_times=[23980, 23990]))


@register(
    CATALOG, "p6_temporal_split_new_pairs",
    with_graph("handoff") + bands_sql("handoff", 0.2, 0.15) + """, f as (select src, dst, arg_min(set, case set when 'train' then 0
    when 'val' then 1 else 2 end) as set from split group by src, dst) select src, dst, set, interaction_count from split
    join f using (src, dst, set)""",
)
def temporal_split_new_pairs(g: Graphs) -> DataFrame:
    made = sp.temporal_split(g.edges("handoff"), 0.2, 0.15, new_pairs_only=True)
    return made.select("src", "dst", "set", "interaction_count")


@register(
    CATALOG, "p8_mirror",
    with_graph("trade") + " select src, dst, interaction_count from trade union all select dst, src, interaction_count from trade",
)
def mirrored(g: Graphs) -> DataFrame:
    return mirror(g.edges("trade")).select("src", "dst", "interaction_count")


@register(
    CATALOG, "p9_split_nodes",
    with_graph("trade") + bands_sql("trade", 0.1, 0.1) + """ select id, 'train' as set from trade_nodes union all
    select distinct id, set from (select src as id, set from split union all select dst, set from split) where set <> 'train'""",
)
def split_nodes(g: Graphs) -> DataFrame:
    return sp.split_nodes(sp.temporal_split(g.edges("trade"), 0.1, 0.1), g.nodes("trade"))


@register(
    CATALOG, "p10_split_report",
    with_graph("reorder", recursive=True) + f""", r as (select src, dst, row_number() over (order by {_draw("7")}, src, dst) - 1 as place,
    count(*) over () as n from (select distinct src, dst from reorder)),
    s as (select src, dst, case when place < floor(n * 0.1) then 'test' else 'train' end as set from r),
    tr as (select src, dst from s where set = 'train')"""
    + COMPONENTS_SQL.format(g="tr") + """ select set, count(*) as pairs,
    case when set = 'train' then (select count(distinct component) from components) end::BIGINT as components,
    case when set = 'train' then (select count(distinct component) = 1 from components) end as connected from s group by set""",
)
def split_report(g: Graphs) -> DataFrame:
    return sp.split_report(sp.random_split(g.edges("reorder"), 0.1, 0.0, 7))


@register(CATALOG, "p11_execute_split")
def execute_split(g: Graphs) -> DataFrame:
    out = None
    for mode, graph in (("temporal", "handoff"), ("random", "trade"), ("connected", "reorder")):
        split = sp.execute_split(g.edges(graph), g.nodes(graph), mode, 0.1, 0.1)
        nodes = split.nodes.groupBy("set").agg(F.count(F.lit(1)).alias("nodes"))
        part = split.report.join(nodes, "set").select(F.lit(mode).alias("mode"), "*")
        out = part if out is None else out.unionByName(part)
    return out
