"""Queries on the embedding families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators.embeddings import store, temporal
from ..operators.embeddings.families import embed
from ..operators.embeddings.fastrp import fastrp
from ..operators.embeddings.graphsage import SageModel, fit_graphsage
from ..operators.embeddings.hashgnn import hashgnn
from ..operators.embeddings.node2vec import random_walks
from ..operators.splits import temporal_split
from .base import Graphs, h60, register, with_graph

CATALOG: dict = {}

_BW = ", bw as (select src as a, dst as b from {g} union select dst, src from {g})"
_DIE = h60("'42'", "id", "j") + " % 6"


def _spread(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row per node and entry, for comparing vectors."""
    return df.select("node", F.posexplode("vec").alias("j", "x")).select("node", "j", F.round("x", digits).alias("x"))


def _fastrp_sql(base: str) -> str:
    return with_graph("handoff") + _BW.format(g="handoff") + f""", base as ({base}),
    n1 as (select a as node, j, avg(x) as x from bw join base on base.node = b group by a, j),
    n2 as (select a as node, j, avg(x) as x from bw join n1 on n1.node = b group by a, j),
    u as (select 1 as hop, * from n1 union all select 2, * from n2),
    s as (select hop, node, sqrt(sum(x * x)) as norm from u group by hop, node)
    select node, j, round(sum(case when norm > 0 then x / norm else 0 end), 6) + 0.0 as x from u join s using (hop, node) group by node, j"""


@register(
    CATALOG, "m1_fastrp",
    _fastrp_sql(f"""select id as node, j::INTEGER as j, case {_DIE} when 0 then sqrt(3.0) when 1 then -sqrt(3.0) else 0.0 end as x
    from handoff_nodes, range(8) r(j)"""),
)
def fastrp_topology(g: Graphs) -> DataFrame:
    return _spread(fastrp(g.nodes("handoff"), g.adjacency("handoff"), dim=8)).withColumn("x", F.col("x") + F.lit(0.0))


def _user_features(g: Graphs) -> DataFrame:
    """Users with their mean event value and number of purchases."""
    e = g.table("events").groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.round(F.avg("value"), 4).alias("mean_value"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
    )
    return g.nodes("handoff").join(e, "id", "left")


_FDIE = h60("'42'", "'f'", "i", "j") + " % 6"


@register(
    CATALOG, "m1_fastrp_with_features",
    _fastrp_sql(f"""select id as node, j::INTEGER as j, case {_DIE} when 0 then sqrt(3.0) when 1 then -sqrt(3.0) else 0.0 end as x
    from handoff_nodes, range(4) r(j) union all
    select id, (j + 4)::INTEGER, sum(v * case {_FDIE} when 0 then sqrt(3.0) when 1 then -sqrt(3.0) else 0.0 end)
    from (select n.id, 0 as i, round(avg(value), 4) as v from handoff_nodes n join events on user_id::VARCHAR = n.id group by n.id
    union all select n.id, 1, count(case when event_type = 'purchase' then 1 end)
    from handoff_nodes n join events on user_id::VARCHAR = n.id group by n.id), range(4) r(j) group by id, j"""),
)
def fastrp_features(g: Graphs) -> DataFrame:
    rows = fastrp(_user_features(g), g.edges("handoff"), 8, 0.5, ["mean_value", "purchases"])
    return _spread(rows).withColumn("x", F.col("x") + F.lit(0.0))


@register(
    CATALOG, "m2_random_walks",
    with_graph("handoff", recursive=True) + f""", two_way as (select distinct src, dst from (select src, dst from handoff union all select dst, src from handoff)),
    placed as (select src, dst, row_number() over (order by src, dst) - 1 as place from two_way),
    spans as (select src as node, min(place) as first, count(*) as degree from placed group by src),
    w as (select nid * 2 + n as walk, 0 as step, id as cur, id as path from handoff_nodes, (select unnest([0, 1]) as n)
    union all select w.walk, w.step + 1, p.dst, w.path || '>' || p.dst from w join spans s on s.node = w.cur
    join placed p on p.place = s.first + {h60("'42'", "w.walk", "w.step + 1")} % s.degree where w.step < 5)
    select walk::BIGINT as walk, path from w where step = 5""",
)
def walks(g: Graphs) -> DataFrame:
    made = random_walks(g.nodes("handoff"), g.edges("handoff"), 6, 2)
    return made.select("walk", F.array_join("path", ">").alias("path"))


@register(CATALOG, "m2_random_walks_biased")
def walks_biased(g: Graphs) -> DataFrame:
    made = random_walks(g.nodes("handoff"), g.edges("handoff"), 4, 1, p=2.0, q=0.5)
    return made.select("walk", F.array_join("path", ">").alias("path"))


@register(CATALOG, "m2_node2vec")
def node2vec(g: Graphs) -> DataFrame:
    return _spread(embed("Node2Vec", g.nodes("handoff"), g.edges("handoff"), 8, walk_length=10, walks_per_node=2), 3)


@register(CATALOG, "m3_graphsage")
def graphsage(g: Graphs) -> DataFrame:
    return _spread(embed("GraphSAGE", _user_features(g), g.edges("handoff"), 8, epochs=2, steps_per_epoch=2), 3)


@register(
    CATALOG, "m3_graphsage_saved_model",
    with_graph("handoff") + " select id as node, 8::BIGINT as entries, 1.0::DOUBLE as length from handoff_nodes",
)
def graphsage_saved_model(g: Graphs) -> DataFrame:
    """A model of the largest-value kind, trained before the last tenth of the times, saved, loaded and used on the whole graph."""
    early = temporal_split(g.edges("handoff"), 0.1, 0.0).filter("set = 'train'")
    nodes = _user_features(g).na.fill(0)
    known = nodes.join(early.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    model, _ = fit_graphsage(known, early, ["mean_value", "purchases"], 8, epochs=2, steps_per_epoch=1, aggregator="max")
    path = scratch_path(g.spark, "model")
    model.save(g.spark, path)
    vectors = SageModel.load(g.spark, path).embed(nodes, g.adjacency("handoff"))
    length = F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), 6)
    return vectors.select("node", F.size("vec").cast("bigint").alias("entries"), length.alias("length"))


def _hash_round(r: int, prev: str) -> str:
    """One min-hash round over rows ``(node, bit)`` with two slots."""
    value = lambda kind: f"({h60(chr(39) + '42' + chr(39), str(r), 'k', chr(39) + kind + chr(39), 'bit')} % 1099511627776) * 1048576 + bit"
    return f"""o{r} as (select node, k, min({value("o")}) as v from {prev}, range(2) t(k) group by node, k),
    s{r} as (select node, k, min({value("n")}) as v from {prev}, range(2) t(k) group by node, k),
    n{r} as (select a as node, k, min(v) as v from bw join s{r} on s{r}.node = b group by a, k),
    b{r} as (select distinct node, min(v) % 1048576 as bit from (select * from o{r} union all select * from n{r}) group by node, k)"""


@register(
    CATALOG, "m4_hashgnn",
    with_graph("handoff") + _BW.format(g="handoff") + f""", b0 as (select distinct id as node, {h60("'42'", "id", "i")} % 16 as bit
    from handoff_nodes, range(2) t(i)), """ + ", ".join(_hash_round(r, f"b{r - 1}") for r in (1, 2)) + """
    select node, j::INTEGER as j, max(case when bit = j then 1.0 else 0.0 end)::DOUBLE as x from b2, range(16) t(j) group by node, j""",
)
def hashgnn_bits(g: Graphs) -> DataFrame:
    return _spread(hashgnn(g.nodes("handoff"), g.adjacency("handoff"), dim=16, iterations=2, density=2))


@register(CATALOG, "m4_hashgnn_with_features")
def hashgnn_features(g: Graphs) -> DataFrame:
    f = _user_features(g).select("id", "nid", (F.col("purchases") > 13).cast("int").alias("buyer"), (F.col("mean_value") > 20).cast("int").alias("rich"))
    return _spread(embed("HashGNN", f, g.edges("handoff"), 16, iterations=2, density=2))


_EVENTS = ", ev as (select distinct unnest(timestamps) as ts, src, dst from {g}), events2 as (select * from ev union all select ts, dst, src from ev)"


@register(
    CATALOG, "m5a_temporal_events",
    with_graph("handoff") + _EVENTS.format(g="handoff") + " select ts, src, dst from events2 where ts <= 19740",
)
def temporal_events(g: Graphs) -> DataFrame:
    return temporal.temporal_events(g.edges("handoff"), 19740).orderBy(*temporal.event_order())


@register(
    CATALOG, "m5b_last_k_neighbors",
    with_graph("trade") + _EVENTS.format(g="trade") + """ select node, rank::INTEGER as rank, neighbor, ts from (
    select src as node, row_number() over (partition by src order by ts desc, dst) as rank, dst as neighbor, ts from events2) where rank <= 10""",
)
def last_k_neighbors(g: Graphs) -> DataFrame:
    return temporal.last_k_neighbors(temporal.temporal_events(g.edges("trade")))


def _neg(i: int) -> str:
    return h60("'42'", "e.ts", "s.nid", "d.nid", str(i)) + " % n"


@register(
    CATALOG, "m5c_negative_destinations",
    with_graph("handoff") + _EVENTS.format(g="handoff") + f""", c as (select count(*) as n from handoff_nodes),
    dr as (select e.ts as ts, e.src as src, e.dst as dst, s.nid as sn, d.nid as dn, [{", ".join(_neg(i) for i in range(6))}] as tries
    from events2 e join handoff_nodes s on s.id = e.src join handoff_nodes d on d.id = e.dst, c)
    select ts, src, dst, id as neg from (select *, coalesce([t for t in tries if t <> sn and t <> dn][1], tries[6]) as pick from dr)
    join handoff_nodes on nid = pick""",
)
def negative_destinations(g: Graphs) -> DataFrame:
    return temporal.negative_destinations(temporal.temporal_events(g.edges("handoff")), g.nodes("handoff"))


def _sign_sql(*parts: str) -> str:
    return f"(case when {h60(*parts)} % 2 = 0 then 1.0::DOUBLE else -1.0::DOUBLE end)"


#: The recurrence in closed form: decayed sums of signs and time codes, projected, half a node's own and half its last neighbours'.
MEMORY_SQL = with_graph("handoff") + _EVENTS.format(g="handoff") + f""",
    gp as (select ts, src, dst, coalesce(ts - lag(ts) over (partition by src order by ts, dst), 0.0) as gap,
    exp((ts - max(ts) over (partition by src)) / 10.0) as w from events2),
    entry as (select unnest(generate_series(0, 11)) as j), place as (select unnest(generate_series(0, 7)) as i),
    acc as (select src as node, j, sum(w * case when j < 8 then {_sign_sql("'42'", "dst", "j")} / sqrt(8.0) else cos(gap * (1.0::DOUBLE / power(10.0::DOUBLE, 4.0 * (j - 8) / 3))) end) as x
    from gp, entry group by src, j),
    mem as (select node, i as j, sum({_sign_sql("'42'", "'p'", "i", "j")} / sqrt(12.0) * x) as x from acc, place group by node, i),
    last_events as (select src as node, dst as nb, row_number() over (partition by src order by ts desc, dst) as r from events2),
    near as (select l.node as node, m.j as j, avg(m.x) as x from last_events l join mem m on m.node = l.nb where r <= 10 group by 1, 2)
    select n.id as node, p.i::INTEGER as j, round((coalesce(m.x, 0) + coalesce(q.x, 0)) / 2, 5) + 0.0 as x from handoff_nodes n cross join place p
    left join mem m on m.node = n.id and m.j = p.i left join near q on q.node = n.id and q.j = p.i"""


@register(CATALOG, "m5d_temporal_memory", MEMORY_SQL)
def temporal_memory(g: Graphs) -> DataFrame:
    return _spread(temporal.temporal_memory(g.nodes("handoff"), g.edges("handoff"), 8, 4), 5).withColumn("x", F.col("x") + F.lit(0.0))


@register(
    CATALOG, "m6_write_load_embeddings",
    """select vec_id as node, j::INTEGER as j, round(embedding[j + 1]::DOUBLE, 6) + 0.0 as x
    from (select vec_id, embedding, unnest(range(len(embedding))) as j from embeddings)""",
)
def write_load(g: Graphs) -> DataFrame:
    path = scratch_path(g.spark, "emb")
    rows = g.table("embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    store.write_embeddings(path, rows, "FastRP")
    loaded = store.load_embeddings(g.spark, path, "FastRP")
    return _spread(loaded).withColumn("x", F.col("x") + F.lit(0.0))


@register(CATALOG, "m7_infer_dim", "select max(len(embedding))::BIGINT as dim, count(*) as vectors from embeddings")
def infer_dim(g: Graphs) -> DataFrame:
    rows = g.table("embeddings").select(F.col("embedding").alias("vec"))
    dim = store.infer_dim(rows)
    return rows.agg(F.lit(dim).cast("bigint").alias("dim"), F.count(F.lit(1)).alias("vectors"))


@register(
    CATALOG, "m8_embedding_stats",
    """with e as (select vec_id, unnest(embedding)::DOUBLE as x, generate_subscripts(embedding, 1) as j from embeddings),
    n as (select vec_id, sqrt(sum(x * x)) as norm, count(*) as dim from e group by vec_id),
    d as (select j, stddev_pop(x) as sd from e group by j)
    select (select count(*) from n) as count, (select max(dim) from n) as dim, (select round(min(norm), 5) from n) as norm_min,
    (select round(max(norm), 5) from n) as norm_max, (select round(avg(norm), 5) from n) as norm_mean,
    (select round(min(sd), 5) from d) as min_dim_std, (select round(avg(sd), 5) from d) as mean_dim_std,
    (select round(max(sd), 5) from d) as max_dim_std""",
)
def embedding_stats(g: Graphs) -> DataFrame:
    s = store.embedding_stats(g.table("embeddings").select(F.col("embedding").alias("vec")))
    return s.select("count", "dim", *[F.round(c, 5).alias(c) for c in s.columns if c not in ("count", "dim")])


@register(
    CATALOG, "m9_family_of",
    """with x as (select o_orderkey, case o_orderkey % 7 when 0 then 'FastRP' when 1 then 'emb_n2v_' when 2 then 'my.SAGE-'
    when 3 then 'hash_of_gnn' when 4 then 'tgn' when 5 then 'HGNN' else '--x y-' end || o_orderstatus as name from orders)
    select name, case when lower(name) like '%fastrp%' then 'FastRP' when lower(name) like '%node2vec%' or lower(name) like '%n2v%' then 'Node2Vec'
    when lower(name) like '%sage%' then 'GraphSAGE' when lower(name) like '%hgnn%' or (lower(name) like '%hash%' and lower(name) like '%gnn%') then 'HashGNN'
    when lower(name) like '%tgn%' then 'TGN' else trim(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_') end as family, count(*) as n
    from x group by 1, 2""",
)
def family_of(g: Graphs) -> DataFrame:
    k = F.col("o_orderkey") % 7
    text = F.lit("--x y-")
    for i, name in enumerate(["FastRP", "emb_n2v_", "my.SAGE-", "hash_of_gnn", "tgn", "HGNN"]):
        text = F.when(k == i, name).otherwise(text)
    names = g.table("orders").select(F.concat(text, "o_orderstatus").alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", store.family_column(F.col("name")).alias("family"), "n")


