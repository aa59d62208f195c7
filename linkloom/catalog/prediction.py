"""Queries on link prediction: sampling, features, metrics, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..functions.ordering import global_index
from ..operators import linkpred as lp
from ..operators import predicted as pr
from ..operators.embeddings.families import embed
from ..operators.splits import execute_split, temporal_split
from ..plans import prediction as plan
from ..sources.snapshots import SnapshotStore
from .base import CHOSEN_SQL, SCORED_SQL, SERIES_SQL, Graphs, future_sql, graph_sql, h60, register, times_sql, u60, with_graph
from .splits import bands_sql

CATALOG: dict = {}


def _open_sql(nodes: str, edges: str, k: int | str, seed: str) -> str:
    """CTE ``open`` (s, t, draw): open pairs of ``nodes`` (id, nid) by rank; ``edges`` is a table with src, dst, ``k`` SQL."""
    size = "(n * (n - 1)) // 2"
    place = f"{size} - 1 - ((n - 2 - a) * (n - 1 - a)) // 2 - (n - 1 - b)"
    swapped = f"list_reduce(keys, lambda x, y: case when {h60(f"'{seed}'", 'y % 16', 'greatest(x, (y // 16 - x + m) % m)')} % 2 = 1 then (y // 16 - x + m) % m else x end, i)"
    return f"""op_n as (select count(*)::BIGINT as n from {nodes}),
    op_e as (select distinct least(x.nid, y.nid) as a, greatest(x.nid, y.nid) as b from {edges} e join {nodes} x on x.id = e.src join {nodes} y on y.id = e.dst where x.nid <> y.nid),
    op_p as (select {place} as place from op_e, op_n),
    op_k as (select place - (row_number() over (order by place) - 1) as key from op_p),
    op_m as (select {size} - (select count(*) from op_e) as m, n from op_n),
    op_r as (select greatest(m, 1) as m, n, list_transform(generate_series(0, 15), lambda r: ({h60(f"'{seed}'", "'key'", "r")} % greatest(m, 1)) * 16 + r) as keys from op_m),
    op_d as (select i as draw, m, n, {swapped} as key from op_r, (select unnest(generate_series(0, least(({k})::BIGINT, (select m from op_m)) - 1)) as i)),
    op_c as (select draw, n, key + before as place from (select draw, n, key, sum(case when draw is null then 1 else 0 end) over (order by key, draw nulls first
    rows unbounded preceding)::BIGINT as before from (select draw, n, key from op_d union all select null, null, key from op_k)) where draw is not null),
    op_row as (select nid, (select {size} from op_n) - ((select n from op_n) - nid) * ((select n from op_n) - nid - 1) // 2 as start from {nodes}),
    op_a as (select draw, nid as a, place - start + nid + 1 as b from op_c asof join op_row on place >= start),
    open as (select case when {_before("x.id", "y.id")} then x.id else y.id end as s, case when {_before("x.id", "y.id")} then y.id else x.id end as t, draw
    from op_a join {nodes} x on x.nid = a join {nodes} y on y.nid = b)"""


def _before(a: str, b: str) -> str:
    """SQL of the id order of two ids that are both whole numbers or both text."""
    return f"case when try_cast({a} as BIGINT) is not null and try_cast({b} as BIGINT) is not null then {a}::BIGINT < {b}::BIGINT else {a} < {b} end"


@register(
    CATALOG, "l1_sample_negatives",
    with_graph("trade") + ", old as (select src, dst from trade where first_ts <= 23975), "
    + _open_sql("trade_nodes", "old", 5000, "42") + " select s, t from open",
)
def sample_negatives(g: Graphs) -> DataFrame:
    return lp.sample_negatives(g.nodes("trade"), g.edges("trade"), 5000, 23975.0).select("s", "t")


def _embedded(g: Graphs) -> DataFrame:
    """Nodes of ``trade`` that the embeddings table has a vector for."""
    return g.nodes("trade").join(g.table("embeddings").select(F.col("vec_id").alias("nid")), "nid", "left_semi").select("id")


_EMBEDDED = """, emb as (select id, row_number() over (order by id) - 1 as nid from trade_nodes where nid in (select vec_id from embeddings)), """


@register(
    CATALOG, "l2_sample_negatives_embedded",
    with_graph("trade") + _EMBEDDED + _open_sql("emb", "trade", 5000, "42") + " select s, t from open",
)
def sample_negatives_embedded(g: Graphs) -> DataFrame:
    return lp.sample_negatives(_embedded(g), g.edges("trade"), 5000).select("s", "t")


@register(
    CATALOG, "l1_every_open_pair",
    with_graph("trade") + _EMBEDDED + """ h as (select id, row_number() over (order by id) - 1 as nid from emb where nid % 2 = 0)
    select x.id as s, y.id as t from h x join h y on x.id < y.id
    where not exists (select 1 from trade e where (e.src = x.id and e.dst = y.id) or (e.src = y.id and e.dst = x.id))""",
)
def every_open_pair(g: Graphs) -> DataFrame:
    """As many draws as there are pairs: all open pairs of every second embedded node, each once."""
    half = global_index(_embedded(g), [F.col("id").asc()], "place").filter("place % 2 = 0").select("id")
    return lp.sample_negatives(half, g.edges("trade"), 1 << 40).select("s", "t")


@register(
    CATALOG, "l3_snapshot_cutoff",
    with_graph("trade") + bands_sql("trade", 0.1, 0.1) + """ select set, max(o.first_ts) as cutoff from split
    join trade o using (src, dst) group by set""",
)
def snapshot_cutoff(g: Graphs) -> DataFrame:
    split = temporal_split(g.edges("trade"), 0.1, 0.1)
    rows = [(s, lp.snapshot_cutoff(plan.pairs_of(split, s), g.edges("trade"))) for s in ("train", "val", "test")]
    return g.spark.createDataFrame(rows, "set string, cutoff double")


def _table_vectors(g: Graphs) -> DataFrame:
    """Vectors of the embeddings table on the nodes of ``handoff`` with the same number."""
    v = g.table("embeddings").select(F.col("vec_id").alias("nid"), F.col("embedding").alias("vec"))
    return g.nodes("handoff").join(v, "nid").select(F.col("id").alias("node"), "vec")


_VECTORS = """, v as (select id as node, [x::DOUBLE for x in embedding] as vec from handoff_nodes join embeddings on vec_id = nid)"""


@register(
    CATALOG, "l4_hadamard",
    with_graph("handoff") + _VECTORS + """ select distinct h.src as s, h.dst as t, round(list_dot_product(a.vec, b.vec), 5) as total,
    round(a.vec[1] * b.vec[1], 6) as first from handoff h join v a on a.node = src join v b on b.node = dst""",
)
def hadamard(g: Graphs) -> DataFrame:
    rows = lp.hadamard(g.pairs("handoff"), _table_vectors(g))
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("s", "t", F.round(total, 5).alias("total"), F.round(F.get("features", F.lit(0)), 6).alias("first"))


@register(
    CATALOG, "l5_training_set",
    with_graph("handoff") + _VECTORS + ", p as (select distinct src as s, dst as t from handoff where src in (select node from v) and dst in (select node from v)), k as (select ceil(count(*) * 0.5)::BIGINT as k from p), "
    + _open_sql("handoff_nodes", "handoff", "select k from k", "42") + """,
    neg as (select s, t from open)
    select 1.0::DOUBLE as label, count(*) as rows from p union all
    select 0.0, count(*) from neg where s in (select node from v) and t in (select node from v) having count(*) > 0""",
)
def training_set(g: Graphs) -> DataFrame:
    rows = lp.training_set(g.pairs("handoff"), _table_vectors(g), g.nodes("handoff"), g.edges("handoff"), 0.5)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@register(CATALOG, "l6_fit_logistic")
def fit_logistic(g: Graphs) -> DataFrame:
    rows = lp.training_set(g.pairs("handoff"), _table_vectors(g), g.nodes("handoff"), g.edges("handoff"))
    model = lp.fit_logistic(rows)
    weights = [(i, round(float(w), 5)) for i, w in enumerate(model.coefficients)] + [(-1, round(model.intercept, 5))]
    return g.spark.createDataFrame(weights, "entry int, weight double")


@register(CATALOG, "l7_score")
def score(g: Graphs) -> DataFrame:
    rows = lp.training_set(g.pairs("handoff"), _table_vectors(g), g.nodes("handoff"), g.edges("handoff"))
    model = lp.fit_logistic(rows)
    scored = lp.score(rows.filter("label = 1").select("s", "t", "features"), model)  # the usable pairs with their products
    return scored.select("s", "t", F.round("probability", 4).alias("probability"))


METRICS_SQL = (
    with_graph("trade") + ", " + SCORED_SQL + """, h as (select probability as p, count(case when label = 1 then 1 end) as pos,
    count(case when label = 0 then 1 end) as neg from scored group by 1),
    r as (select *, sum(pos) over (order by p desc) as cp, sum(neg) over (order by p desc) as cn from h),
    m as (select sum(pos) as np, sum(neg) as nn, sum(neg * (cp - pos) + neg * pos / 2.0)::DOUBLE as w, sum(pos * cp / (cp + cn)::DOUBLE) as st,
    sum(case when p >= 0.5 then pos else 0 end) as tp, sum(case when p >= 0.5 then neg else 0 end) as fp from r)
    select np::BIGINT as count_pos, nn::BIGINT as count_neg, round(w / (np::DOUBLE * nn), 8) as auc, round(st / np, 8) as ap,
    round((tp + nn - fp) / (np + nn)::DOUBLE, 8) as accuracy, round(tp / (tp + fp)::DOUBLE, 8) as precision,
    round(tp / np::DOUBLE, 8) as recall, round(2.0 * tp / (2 * tp + fp + np - tp)::DOUBLE, 8) as f1 from m"""
)


@register(CATALOG, "l8_binary_metrics", METRICS_SQL)
def binary_metrics(g: Graphs) -> DataFrame:
    m = lp.binary_metrics(g.scored())
    return m.select("count_pos", "count_neg", *[F.round(c, 8).alias(c) for c in m.columns[2:]])



@register(
    CATALOG, "l9_candidate_pool",
    with_graph("trade") + ", " + _open_sql("trade_nodes", "trade", 6000, "pool|1") + " select s, t, draw as pool_pos from open",
)
def candidate_pool(g: Graphs) -> DataFrame:
    return lp.candidate_pool(g.nodes("trade"), g.edges("trade"), 6000)


@register(
    CATALOG, "l10_family_pool",
    with_graph("trade") + ", " + _open_sql("trade_nodes", "trade", 6000, "pool|1")
    + f""" select s, t, draw as pool_pos from open where {u60("'used'", "s", "t")} >= 0.3""",
)
def family_pool(g: Graphs) -> DataFrame:
    pool = lp.candidate_pool(g.nodes("trade"), g.edges("trade"), 6000)
    used = pool.filter(unit_hash("used", F.col("s"), F.col("t")) < 0.3)
    return lp.family_pool(g.nodes("trade"), g.edges("trade"), used, 2000)


_SCORED = with_graph("trade") + ", " + SCORED_SQL


@register(
    CATALOG, "l11_select_threshold_first",
    _SCORED + """ select s, t, probability from scored order by (probability >= 0.9) desc,
    case when probability >= 0.9 then pool_pos end, probability desc, s, t limit 6000""",
)
def select_threshold_first(g: Graphs) -> DataFrame:
    return lp.select_threshold_first(g.scored(), 6000, 0.9).select("s", "t", "probability")


@register(
    CATALOG, "l11_select_above_only",
    _SCORED + " select s, t, probability from scored where probability >= 0.9 order by pool_pos limit 6000",
)
def select_above_only(g: Graphs) -> DataFrame:
    return lp.select_threshold_first(g.scored(), 6000, 0.9, fill_below=False).select("s", "t", "probability")


@register(
    CATALOG, "l12_select_top_k",
    _SCORED + """ select s, t, probability, (select count(*) from scored) as total_scored,
    (select count(*) from scored where probability >= 0.5) as above_threshold from scored order by probability desc, s, t limit 1000""",
)
def select_top_k(g: Graphs) -> DataFrame:
    report = lp.selection_report(g.scored(), 0.5).first()
    top = lp.select_top_k(g.scored(), 1000, 0.5).select("s", "t", "probability")
    return top.withColumns({c: F.lit(report[c]) for c in ("total_scored", "above_threshold")})


@register(
    CATALOG, "l13_select_test_first",
    _SCORED + """, r as (select 0 as stage, * from scored where label = 1 and probability >= 0.8 union all
    select 1, * from scored where label = 0)
    select stage, s, t, probability from r order by stage, (probability >= 0.8 or stage = 0) desc,
    case when probability >= 0.8 or stage = 0 then pool_pos end, probability desc, s, t limit 20000""",
)
def select_test_first(g: Graphs) -> DataFrame:
    rows = g.scored()
    test, pool = rows.filter(F.col("label") == 1), rows.filter(F.col("label") == 0)
    return lp.select_test_first(test, pool, 20000, 0.8).select("stage", "s", "t", "probability")


@register(
    CATALOG, "l14_select_at_least_k",
    _SCORED + """ select s, t, probability from scored where label = 0 order by (probability >= 0.95) desc,
    case when probability >= 0.95 then pool_pos end, probability desc, s, t limit 3000""",
)
def select_at_least_k(g: Graphs) -> DataFrame:
    rows, seen = g.scored(), g.scored().filter(F.col("label") == 1)
    return lp.select_at_least_k(rows.unionByName(rows), 3000, 0.95, seen).select("s", "t", "probability")


@register(
    CATALOG, "l15_recognized_test_pairs", _SCORED + " select s, t, probability from scored where label = 1 and probability >= 0.7"
)
def recognized(g: Graphs) -> DataFrame:
    return lp.recognized_test_pairs(g.scored().filter(F.col("label") == 1), 0.7).select("s", "t", "probability")


@register(
    CATALOG, "l16_avoid_set",
    "with " + graph_sql("trade", "supply") + ", " + SERIES_SQL + ", " + CHOSEN_SQL
    + " select s, t from chosen union select src, dst from trade",
)
def avoid_set(g: Graphs) -> DataFrame:
    known = g.bare_pairs("trade")
    return lp.avoid_set(g.chosen(), known, known)


@register(
    CATALOG, "l17_remember_predicted",
    "with " + graph_sql("supply") + ", " + SERIES_SQL + """ select distinct family, s, t from series where predicted_timestep = 1
    union select 'TGN', s, t from series where predicted_timestep = 2""",
)
def remember_predicted(g: Graphs) -> DataFrame:
    rows = g.series()
    known = rows.filter("predicted_timestep = 1").select("family", "s", "t").distinct()
    return pr.remember_predicted(known, rows.filter("predicted_timestep = 2"), "TGN")


@register(CATALOG, "l18_max_timestamp", future_sql() + " select max(last_ts) as max_ts from future")
def max_timestamp(g: Graphs) -> DataFrame:
    top = pr.max_timestamp(g.future())
    return g.future().agg(F.max(F.lit(top)).alias("max_ts"))


@register(
    CATALOG, "l19_project_predicted",
    "with " + ", ".join([graph_sql("trade", "supply"), SERIES_SQL, CHOSEN_SQL]) + f""", o as (select src, dst, type, timestamps, first_ts,
    last_ts, interaction_count, 0 as predicted, 1.0::DOUBLE as probability from trade where first_ts <= 23990
    union all select s, t, 'PREDICTED', [24100.0], 24100, 24100, 1, 1, probability from chosen)
    select src, dst, type, {times_sql("timestamps")} as times, first_ts, last_ts, interaction_count, predicted, probability from o
    union all select dst, src, type, {times_sql("timestamps")}, first_ts, last_ts, interaction_count, predicted, probability from o""",
)
def project_predicted(g: Graphs) -> DataFrame:
    rows = pr.project_predicted(g.edges("trade"), g.chosen(), 23990.0, 24100.0)
    return _edge_out(rows)


def _edge_out(rows: DataFrame) -> DataFrame:
    from .base import list_text

    return rows.select(
        "src", "dst", "type", list_text("timestamps").alias("times"), "first_ts", "last_ts", "interaction_count", "predicted",
        "probability",
    )


@register(
    CATALOG, "l20_materialize_predicted",
    future_sql() + f""" select src, dst, type, {times_sql("timestamps")} as times, first_ts, last_ts, interaction_count,
    case when type = 'PREDICTED' then 1 else 0 end as predicted, probability from future""",
)
def materialize(g: Graphs) -> DataFrame:
    from ..functions.scratch import scratch_path

    s = SnapshotStore(g.spark, scratch_path(g.spark, "store"))
    nodes, rows = pr.snapshot_rows(g.edges("trade"), g.both_nodes(), g.chosen())
    run = plan.PredictionRun(None, None, g.chosen(), nodes, rows, None)
    return _edge_out(s.edges(plan.materialize_predicted(s, "trade", "FastRP", run)))


@register(
    CATALOG, "l20_predicted_nodes", future_sql() + " select src as id from future union select dst from future"
)
def predicted_nodes(g: Graphs) -> DataFrame:
    return pr.snapshot_rows(g.edges("trade"), g.both_nodes(), g.chosen())[0].select("id")


@register(CATALOG, "l21_predicted_pairs", future_sql() + " select distinct src as s, dst as t from future where predicted > 0")
def predicted_pairs(g: Graphs) -> DataFrame:
    return pr.predicted_pairs(g.future())


@register(
    CATALOG, "l22_predicted_series",
    future_sql() + """ select src as s, dst as t, probability, last_ts::BIGINT as timestamp, predicted::BIGINT as predicted_timestep
    from future where type = 'PREDICTED'""",
)
def predicted_series(g: Graphs) -> DataFrame:
    return pr.predicted_series(g.future())


@register(
    CATALOG, "l23_round_counters",
    future_sql() + " select max(predicted)::BIGINT as max_round, max(last_ts)::BIGINT as max_ts from future",
)
def round_counters(g: Graphs) -> DataFrame:
    return pr.round_counters(g.future())


@register(
    CATALOG, "l24_test_pairs",
    with_graph("trade") + bands_sql("trade", 0.1, 0.1) + " select distinct src as s, dst as t from split where set = 'test'",
)
def test_pairs(g: Graphs) -> DataFrame:
    split = execute_split(g.edges("trade"), g.nodes("trade"), "temporal", 0.1, 0.1)
    return plan.pairs_of(split.edges, "test")


@register(
    CATALOG, "l25_confusion",
    _SCORED + """, x as (select distinct s, t from scored where label = 1), tr as (select s, t from scored where label = 0 and probability < 0.8),
    pr as (select s, t from scored where probability >= 0.6),
    n as (select (select count(*) from pr semi join x using (s, t)) as tp,
    (select count(*) from pr anti join x using (s, t) where (s, t) not in (select (s, t) from tr)) as fp,
    (select count(*) from x anti join pr using (s, t)) as fn)
    select tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 8) as precision, round(tp / (tp + fn)::DOUBLE, 8) as recall,
    round(2.0 * tp / (2 * tp + fp + fn)::DOUBLE, 8) as f1 from n""",
)
def confusion(g: Graphs) -> DataFrame:
    rows = g.scored()
    out = pr.confusion(rows, rows.filter("label = 1"), rows.filter("label = 0 and probability < 0.8"), 0.6)
    return out.select("tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@register(
    CATALOG, "l26_top_predicted",
    _SCORED + " select t as node, probability as score from scored where s = 'c7' order by 2 desc, 1 limit 50",
)
def top_predicted(g: Graphs) -> DataFrame:
    return pr.top_predicted(g.scored(), "c7")


@register(CATALOG, "l27_run_link_prediction")
def run_link_prediction(g: Graphs) -> DataFrame:
    nodes, edges = g.nodes("handoff"), g.edges("handoff")
    split = execute_split(edges, nodes, "temporal", 0.1, 0.1)
    emb = embed("FastRP", nodes, split.part("train"), 16)
    run = plan.run_link_prediction(nodes, edges, split, emb, k=100)
    added = run.edges.filter(F.col("predicted") > 0).count()
    rounded = [F.round(c, 3).alias(c) for c in ("auc", "ap", "accuracy", "precision", "recall", "f1")]
    return run.metrics.select("set", "count_pos", "count_neg", *rounded).withColumn("predicted_edges", F.lit(added))


