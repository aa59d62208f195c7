"""Queries that compare prediction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pairs import pair_key
from ..operators import compare as cm
from ..operators.linkpred import binary_metrics
from ..sources.snapshots import FAMILIES
from .base import SERIES_SQL, Graphs, graph_sql, register, u60, with_graph

CATALOG: dict = {}

_SERIES = "with " + graph_sql("supply") + ", " + SERIES_SQL
_KEYS = _SERIES + ", k as (select distinct family, least(s, t) || '|' || greatest(s, t) as key from series)"
_GT = ", gt as (select distinct least(src, dst) || '|' || greatest(src, dst) as key from supply where last_ts >= 23990)"


def _truth(g: Graphs) -> DataFrame:
    late = g.edges("supply").filter(F.col("last_ts") >= 23990)
    return late.select(F.col("dst").alias("s"), F.col("src").alias("t"))


@register(
    CATALOG, "c1_pair_key",
    with_graph("handoff") + " select type, least(src, dst) || '|' || greatest(src, dst) as key from handoff",
)
def keys(g: Graphs) -> DataFrame:
    return g.edges("handoff").select("type", pair_key(F.col("dst"), F.col("src")).alias("key"))


@register(
    CATALOG, "c2_overlap_pct",
    _KEYS + """, a as (select key from k where family = 'FastRP'), b as (select key from k where family = 'TGN'),
    n as (select (select count(*) from a) as size_a, (select count(*) from b) as size_b, (select count(*) from a semi join b using (key)) as common)
    select *, round(common / least(size_a, size_b)::DOUBLE * 100, 8) as overlap_pct from n""",
)
def overlap(g: Graphs) -> DataFrame:
    out = cm.overlap_pct(g.family_series("FastRP", 0.4), g.family_series("TGN", 0.4))
    return out.withColumn("overlap_pct", F.round("overlap_pct", 8))


@register(
    CATALOG, "c3_gt_coverage_pct",
    _KEYS + _GT + """, a as (select key from k where family = 'FastRP'),
    n as (select (select count(*) from a) as size_a, (select count(*) from gt) as size_b, (select count(*) from a semi join gt using (key)) as common)
    select *, round(common / size_b::DOUBLE * 100, 8) as coverage_pct from n""",
)
def coverage(g: Graphs) -> DataFrame:
    truth = _truth(g)
    out = cm.gt_coverage_pct(g.family_series("FastRP", 0.4), truth)
    return out.withColumn("coverage_pct", F.round("coverage_pct", 8))


@register(
    CATALOG, "c4_comparison_matrix",
    _KEYS + _GT + """, x as (select family, key from k union all select 'Ground Truth', key from gt),
    n as (select family, count(*) as n from x group by family),
    j as (select a.family as row, b.family as col, count(*) as common from x a join x b using (key) group by 1, 2)
    select a.family as "row", b.family as "col", round(100.0 * coalesce(common, 0) / (case when 'Ground Truth' in (a.family, b.family)
    then (select n from n where family = 'Ground Truth') else least(a.n, b.n) end)::DOUBLE, 8) as pct
    from n a cross join n b left join j on j.row = a.family and j.col = b.family""",
)
def matrix(g: Graphs) -> DataFrame:
    truth = _truth(g)  # the graph comes first: its pairs are those of the series
    return cm.comparison_matrix(g.series(), truth, FAMILIES).withColumn("pct", F.round("pct", 8))


@register(
    CATALOG, "c5_probability_summary",
    _SERIES + """ select family, count(*) as predicted_edges, min(timestamp)::BIGINT as min_ts, max(timestamp)::BIGINT as max_ts,
    round(avg(probability), 6) as mean_probability, max(probability) as max_probability from series group by family""",
)
def summary(g: Graphs) -> DataFrame:
    return cm.probability_summary(g.series()).withColumn("mean_probability", F.round("mean_probability", 6))


@register(
    CATALOG, "c6_probability_distribution",
    _SERIES + """ select family, timestamp::BIGINT as timestamp, count(*) as edges, min(probability) as p_min,
    round(quantile_cont(probability, 0.25), 6) as p25, round(quantile_cont(probability, 0.5), 6) as p50,
    round(quantile_cont(probability, 0.75), 6) as p75, max(probability) as p_max, """
    + ", ".join(f"count(case when least(floor(probability * 10), 9) = {b} then 1 end) as bin{b}" for b in range(10))
    + " from series group by 1, 2",
)
def distribution(g: Graphs) -> DataFrame:
    out = cm.probability_distribution(g.series())
    return out.withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p75")})


@register(
    CATALOG, "c7_common_round_range",
    _SERIES + """, r as (select family, min(predicted_timestep) as a, max(predicted_timestep) as b from series
    where predicted_timestep > 0 group by family) select max(a)::BIGINT as lo, min(b)::BIGINT as hi from r having max(a) <= min(b)""",
)
def round_range(g: Graphs) -> DataFrame:
    return cm.common_round_range(g.series())


@register(
    CATALOG, "c8_filter_rounds",
    _SERIES + " select family, s, t, predicted_timestep::BIGINT as predicted_timestep from series where predicted_timestep between 2 and 3",
)
def rounds(g: Graphs) -> DataFrame:
    return cm.filter_rounds(g.series(), 2, 3).select("family", "s", "t", "predicted_timestep")


@register(
    CATALOG, "c9_metrics_table",
    with_graph("trade") + f""", x as (select 'FastRP' as family, 'train' as set, {u60("'a'", "src", "dst")} as p, last_ts from trade
    union all select 'FastRP', 'test', {u60("'b'", "src", "dst")}, last_ts from trade
    union all select 'TGN', 'train', {u60("'c'", "src", "dst")}, last_ts from trade)
    select family, set, count(case when last_ts >= 23975 then 1 end) as count_pos,
    round(avg(case when (p >= 0.5) = (last_ts >= 23975) then 1.0 else 0.0 end), 8) as accuracy from x
    where not (family = 'FastRP' and set = 'train') group by family, set""",
)
def metrics(g: Graphs) -> DataFrame:
    from ..functions.hashing import unit_hash

    def one(family: str, name: str, seed: str) -> DataFrame:
        rows = g.edges("trade").select(
            unit_hash(seed, F.col("src"), F.col("dst")).alias("probability"),
            F.when(F.col("last_ts") >= 23975, 1.0).otherwise(0.0).alias("label"),
        )
        return binary_metrics(rows).select(F.lit(family).alias("family"), F.lit(name).alias("set"), "*")

    parts = [one("FastRP", "train", "a"), one("FastRP", "test", "b"), one("TGN", "train", "c")]
    table = cm.metrics_table(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return table.select("family", "set", "count_pos", F.round("accuracy", 8).alias("accuracy"))
