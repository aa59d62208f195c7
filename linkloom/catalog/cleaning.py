"""Queries on edge cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean
from .base import Graphs, list_text, register, times_sql, with_graph

CATALOG: dict = {}

# node -> smallest node reached, over all components
COMPONENTS_SQL = """, both_ways as (select src as a, dst as b from {g} union select dst, src from {g}),
    reach as (select distinct a as node, a as other from both_ways
    union select r.node, b.b from reach r join both_ways b on r.other = b.a),
    components as (select node, min(other) as component from reach group by node)"""

_HANDOFF_ALL = """select a::VARCHAR as src, b::VARCHAR as dst, ts, type, event_id from (
    select lag(user_id) over (order by ts, event_id) as a, user_id as b, event_id,
    date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE as ts, event_type as type from events)"""


@register(
    CATALOG, "e1_sanitize_type",
    r"""select o_orderpriority as raw, coalesce(nullif(regexp_replace(o_orderpriority, '[^\p{L}\p{N}_]', '', 'g'), ''), 'REL') as type,
    count(*) as n from orders group by 1, 2 union all
    select props, coalesce(nullif(regexp_replace(props, '[^\p{L}\p{N}_]', '', 'g'), ''), 'REL'), count(*) from events group by 1, 2""",
)
def sanitize_type(g: Graphs) -> DataFrame:
    raw = g.table("orders").select(F.col("o_orderpriority").alias("raw")).unionByName(
        g.table("events").select(F.col("props").alias("raw"))
    )
    return raw.select("raw", clean.sanitize_type(F.col("raw")).alias("type")).groupBy("raw", "type").agg(F.count(F.lit(1)).alias("n"))


@register(CATALOG, "e2_resolve_timestamp", "select event_id, value as ts from events")
def resolve_timestamp(g: Graphs) -> DataFrame:
    raw = g.table("events").select("event_id", F.col("value").cast("string").alias("Value"))
    return clean.resolve_timestamp(raw, "VALUE")


@register(
    CATALOG, "e3_drop_null_endpoints",
    f"select src, dst, event_id from ({_HANDOFF_ALL}) where src is not null and dst is not null",
)
def drop_null_endpoints(g: Graphs) -> DataFrame:
    return clean.drop_null_endpoints(g.handoff_raw()).select("src", "dst", F.col("row_idx").alias("event_id"))


@register(
    CATALOG, "e4_drop_self_loops",
    f"select src, dst, event_id from ({_HANDOFF_ALL}) where src is not null and src::BIGINT <> dst::BIGINT",
)
def drop_self_loops(g: Graphs) -> DataFrame:
    rows = clean.drop_self_loops(clean.drop_null_endpoints(g.handoff_raw()))
    return rows.select("src", "dst", F.col("row_idx").alias("event_id"))


@register(
    CATALOG, "e5_canonicalize_direction",
    f"""select least(src::BIGINT, dst::BIGINT)::VARCHAR as src, greatest(src::BIGINT, dst::BIGINT)::VARCHAR as dst, event_id
    from ({_HANDOFF_ALL}) where src is not null""",
)
def canonicalize_direction(g: Graphs) -> DataFrame:
    rows = clean.canonicalize_direction(clean.drop_null_endpoints(g.handoff_raw()))
    return rows.select("src", "dst", F.col("row_idx").alias("event_id"))


@register(
    CATALOG, "e6_collapse_edges",
    """with r as (select 'c' || o_custkey as src, 's' || l_suppkey as dst, l_quantity as quantity,
    (year(l_shipdate) * 12 + month(l_shipdate))::DOUBLE as ts, case when l_discount > 0.05 then l_tax end as tax,
    row_number() over (order by l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) as n
    from lineitem join orders on l_orderkey = o_orderkey)
    select src, dst, count(distinct ts) as interaction_count, arg_max(quantity, n) as quantity,
    arg_max(tax, n) filter (where tax is not null) as tax from r group by src, dst""",
)
def collapse_edges(g: Graphs) -> DataFrame:
    raw = clean.with_type(g.trade_raw())
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    raw = raw.select(
        "src", "dst", "type", "ts", *order, F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_discount") > 0.05, F.col("l_tax")).alias("tax"),
    )
    return clean.collapse_edges(raw, order).select("src", "dst", "interaction_count", "quantity", "tax")


@register(
    CATALOG, "e7_timestamp_rollup",
    with_graph("handoff") + f""" select src, dst, type, {times_sql("timestamps")} as times, first_ts, last_ts, ts,
    interaction_count from handoff""",
)
def timestamp_rollup(g: Graphs) -> DataFrame:
    rows = clean.canonicalize_direction(clean.drop_self_loops(clean.drop_null_endpoints(clean.with_type(g.handoff_raw()))))
    return clean.timestamp_rollup(rows).select(
        "src", "dst", "type", list_text("timestamps").alias("times"), "first_ts", "last_ts", "ts", "interaction_count"
    )


@register(
    CATALOG, "e7_whole_cleaning",
    with_graph("trade") + f" select src, dst, type, {times_sql('timestamps')} as times, interaction_count from trade",
)
def whole_cleaning(g: Graphs) -> DataFrame:
    rows = clean.clean_edges(g.trade_raw().select("src", "dst", "ts"), "ts")
    return rows.select("src", "dst", "type", list_text("timestamps").alias("times"), "interaction_count")


@register(
    CATALOG, "e8_largest_component",
    with_graph("reorder", recursive=True) + COMPONENTS_SQL.format(g="reorder") + """,
    biggest as (select component from components group by component order by count(*) desc, component limit 1)
    select src, dst, type from reorder join components on src = node join biggest using (component)""",
)
def largest_component(g: Graphs) -> DataFrame:
    return clean.largest_component(g.edges("reorder")).select("src", "dst", "type")


@register(CATALOG, "e9_nodes_from_edges", with_graph("handoff") + " select id from handoff_nodes")
def nodes_from_edges(g: Graphs) -> DataFrame:
    return clean.nodes_from_edges(g.edges("handoff"))


@register(
    CATALOG, "e10_edge_property_columns",
    "select l_quantity as quantity, l_tax as tax from lineitem join orders on l_orderkey = o_orderkey",
)
def edge_property_columns(g: Graphs) -> DataFrame:
    raw = clean.with_type(g.trade_raw()).select(
        "src", "dst", "type", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax")
    )
    return raw.select(*clean.edge_property_columns(raw))


@register(CATALOG, "e11_assign_nid", with_graph("trade", "handoff") + """ select 'trade' as graph, id, nid from trade_nodes
    union all select 'handoff', id, nid from handoff_nodes""")  # fmt: skip
def assign_nid(g: Graphs) -> DataFrame:
    def one(name: str) -> DataFrame:
        return clean.assign_nid(clean.nodes_from_edges(g.edges(name))).select(F.lit(name).alias("graph"), "id", "nid")

    return one("trade").unionByName(one("handoff"))


