"""Queries on node features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as ft
from .base import FEATURES_SQL, Graphs, register, with_graph

CATALOG: dict = {}

F_SQL = f"with f as ({FEATURES_SQL})"
# Market segments and part kinds of the tables.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _names(columns: list[str], g: Graphs, what: str = "column") -> DataFrame:
    return g.spark.createDataFrame([(c,) for c in columns], f"{what} string")


def _orders(g: Graphs) -> DataFrame:
    return g.table("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("sparse"),
    )


def _one_hot_sql(column: str, values: list[str], name, null_stays: bool = False) -> str:
    cell = "case when {c} = '{v}' then 1.0 else 0.0 end" if not null_stays else "case when {c} is not null then case when {c} = '{v}' then 1.0 else 0.0 end end"
    return ", ".join(f'({cell.format(c=column, v=v)})::DOUBLE as "{name(v)}"' for v in values)


@register(
    CATALOG, "f1_classify_columns",
    F_SQL + ", long as (" + " union all ".join(
        f"select '{c}' as c, {c}::VARCHAR as v, {'true' if c in ('segment', 'kind', 'size_text') else 'false'} as text from f"
        for c in ("balance", "nation", "segment", "kind", "size", "size_text", "large")
    ) + f"""), n as (select c, text, count(*) as rows, count(v) as present,
    count(case when regexp_matches(v, {NUMBER}) then 1 end) as numeric from long group by c, text)
    select c as "column", rows, present, numeric, case when present = 0 then 'drop_empty' when numeric = present then 'numeric'
    when not text then 'drop_mixed' when present = rows then 'encode' else 'drop_nulls' end as class from n""",
)
def classify_columns(g: Graphs) -> DataFrame:
    return ft.class_report(g.features())


@register(
    CATALOG, "f2_one_hot",
    f"""select o_orderkey::VARCHAR as id, o_totalprice as price,
    {_one_hot_sql("o_orderstatus", ["F", "O", "P"], lambda v: "numeric_status_" + v)},
    {_one_hot_sql("o_orderpriority", PRIORITIES, lambda v: "numeric_priority_" + v.replace("-", "_").replace(" ", "_"))}
    from orders""",
)
def one_hot(g: Graphs) -> DataFrame:
    return ft.one_hot(_orders(g))[0]


@register(
    CATALOG, "f3_one_hot_coverage",
    f"""select o_orderkey::VARCHAR as id, o_totalprice as price,
    {_one_hot_sql("o_orderstatus", ["F", "O", "P"], lambda v: "numeric_status__" + v)},
    {_one_hot_sql("o_orderpriority", PRIORITIES, lambda v: "numeric_priority__" + v.replace("-", "_").replace(" ", "_"))},
    {_one_hot_sql("case when o_orderstatus <> 'P' then o_orderpriority end", PRIORITIES,
                  lambda v: "numeric_sparse__" + v.replace("-", "_").replace(" ", "_"), True)}
    from orders""",
)
def one_hot_coverage(g: Graphs) -> DataFrame:
    return ft.one_hot_named(_orders(g), coverage=0.5)


@register(
    CATALOG, "f4_one_hot_slug",
    f"""select o_orderkey::VARCHAR as id, o_totalprice as price, case when o_orderstatus <> 'P' then o_orderpriority end as sparse,
    {_one_hot_sql("o_orderstatus", ["F", "O", "P"], lambda v: "numeric_status_" + v)},
    {_one_hot_sql("o_orderpriority", PRIORITIES, lambda v: "numeric_priority_" + v.replace("-", "_").replace(" ", "_"))}
    from orders""",
)
def one_hot_slug(g: Graphs) -> DataFrame:
    return ft.one_hot_named(_orders(g), style="slug")


@register(
    CATALOG, "f5_one_hot_vector",
    F_SQL + ", c as (select list_sort(list(distinct segment)) as cats from f where segment is not null) "
    "select id, array_to_string([case when x = coalesce(segment, '') then '1' else '0' end for x in cats], ',') as flags from f, c",
)
def one_hot_vector(g: Graphs) -> DataFrame:
    rows = ft.one_hot_vector(g.features(), "segment")
    flags = F.array_join(F.transform("numeric_segment", lambda x: x.cast("bigint").cast("string")), ",")
    return rows.select("id", flags.alias("flags"))


_COVER = """, n as (select count(*) as n from f), k as (select c, text, count(v) as present,
    count(case when regexp_matches(v, {num}) then 1 end) as numeric from long group by c, text)"""
_LONG = ", long as (" + " union all ".join(
    f"select '{c}' as c, {c}::VARCHAR as v, {'true' if c in ('segment', 'kind', 'size_text') else 'false'} as text from f"
    for c in ("balance", "nation", "segment", "kind", "size", "size_text", "large")
) + ")"


@register(
    CATALOG, "f6_discover",
    F_SQL + _LONG + _COVER.format(num=NUMBER) + """ select 'numeric' as kind, c as "column" from k, n
    where present >= ceil(0.3 * n) and present > 0 and numeric = present union all
    select 'string', c from k, n where present >= ceil(0.3 * n) and present > 0 and numeric = 0 and text""",
)
def discover(g: Graphs) -> DataFrame:
    f = g.features()
    return _names(ft.discover(f, "numeric", coverage=0.3), g).select(F.lit("numeric").alias("kind"), "column").unionByName(
        _names(ft.discover(f, "string", coverage=0.3), g).select(F.lit("string").alias("kind"), "column")
    )


@register(
    CATALOG, "f7_prepare_features",
    """with s as (select list_sort(list(distinct o_orderstatus)) as cats from orders),
    p as (select list_sort(list(distinct o_orderpriority)) as cats from orders)
    select o_orderkey::VARCHAR as id, o_totalprice as price,
    array_to_string([case when x = o_orderstatus then '1' else '0' end for x in s.cats], ',') as status,
    array_to_string([case when x = o_orderpriority then '1' else '0' end for x in p.cats], ',') as priority from orders, s, p""",
)
def prepare_features(g: Graphs) -> DataFrame:
    rows, props = ft.prepare_features(_orders(g))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")
    assert props == ["numeric_priority", "numeric_status", "price"], props
    return rows.select("id", "price", text("numeric_status").alias("status"), text("numeric_priority").alias("priority"))


@register(CATALOG, "f8_purge_non_numeric", F_SQL + " select id, balance, nation, size, size_text, large from f")
def purge_non_numeric(g: Graphs) -> DataFrame:
    return ft.purge_non_numeric(g.features())


@register(CATALOG, "f9_supported_columns")
def supported_columns(g: Graphs) -> DataFrame:
    df = g.table("embeddings").withColumnRenamed("vec_id", "id").withColumn("emb_old", F.lit(1.0))
    df = df.withColumn("pair", F.struct("label", "id"))
    names = ft.drop_embedding_columns(ft.supported_columns(df))
    return df.agg(*[F.count(F.col(c)).alias(c) for c in names])


@register(
    CATALOG, "f10_binary_columns",
    F_SQL + """ select 'large' as "column" from f where large is not null group by 1 having min(large) >= 0 and max(large) <= 1""",
)
def binary_columns(g: Graphs) -> DataFrame:
    return _names(ft.binary_columns(g.features()), g)


@register(
    CATALOG, "f11_join_features",
    with_graph("trade") + f""", f as ({FEATURES_SQL}) select n.id, n.nid::BIGINT as nid, f.balance, f.nation
    from trade_nodes n left join f on n.id = f.id""",
)
def join_features(g: Graphs) -> DataFrame:
    return ft.join_features(g.nodes("trade"), g.features())


@register(
    CATALOG, "f12_normalize_existing",
    f"""select c_custkey::VARCHAR as id, c_acctbal as balance, {_one_hot_sql("c_mktsegment", SEGMENTS, lambda v: "numeric_segment_" + v)}
    from customer""",
)
def normalize_existing(g: Graphs) -> DataFrame:
    nodes = g.table("customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"),
    )
    return ft.normalize_existing(nodes, 100)


@register(
    CATALOG, "f13_degree_feature",
    with_graph("handoff") + """ select id, count(*)::DOUBLE as degree from (
    select src as id, dst as o from handoff union select dst, src from handoff) group by id""",
)
def degree_feature(g: Graphs) -> DataFrame:
    return ft.degree_feature(g.nodes("handoff"), g.edges("handoff"), [])[0]


@register(
    CATALOG, "f14_present_columns",
    F_SQL + _LONG + """ select c as "column" from long where c not in ('segment', 'large') group by c having count(v) > 0""",
)
def present_columns(g: Graphs) -> DataFrame:
    blank = g.features().withColumns({"segment": F.lit(None).cast("string"), "large": F.lit(None).cast("int")})
    return _names(ft.present_columns(blank), g)
