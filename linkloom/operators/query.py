"""Asking the present and the predicted graph the same question.

A question is Spark SQL text with ``{nodes}`` and ``{edges}`` for the two tables and
``:name`` for parameters, or a function of ``(nodes, edges)``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Question = str | Callable[[DataFrame, DataFrame], DataFrame]
Graph = tuple[DataFrame, DataFrame]


def ask(graph: Graph, question: Question, params: dict | None = None) -> DataFrame:
    nodes, edges = graph
    if callable(question):
        return question(nodes, edges)
    used = {k: v for k, v in (params or {}).items() if f":{k}" in question}
    return nodes.sparkSession.sql(question, args=used or None, nodes=nodes, edges=edges)


def path_question(least: int, most: int, start: str = "true", end: str = "true", undirected: bool = True) -> str:
    """Question for paths of ``least`` to ``most`` edges, as recursive SQL over ``{nodes}`` and ``{edges}``.

    ``start`` and ``end`` are SQL conditions on ``id``, the first and last node.  A path uses an edge once, so it ends on
    every cycle; ``most`` bounds it (Spark stops recursion at 100 steps).  Answer: ``nodes`` and ``edges`` (lists of structs,
    for :func:`path_to_graph`) and ``hops``.
    """
    if not 0 <= least <= most <= 99:
        raise ValueError("path lengths must be from 0 to 99, the least first")
    edge = "named_struct('id', concat_ws('|', type, src, dst), 'source', src, 'target', dst, 'type', type)"
    turned = f" union all select dst, src, {edge} from {{edges}} where src <> dst" if undirected else ""
    return f"""with recursive steps(a, b, edge) as (select src, dst, {edge} from {{edges}}{turned}),
        walk(node, nodes, edges, hops) as (
            select id, array(named_struct('id', id)), cast(array() as array<struct<id: string, source: string, target: string, type: string>>), 0
            from {{nodes}} where {start}
            union all
            select s.b, concat(w.nodes, array(named_struct('id', s.b))), concat(w.edges, array(s.edge)), w.hops + 1
            from walk w join steps s on s.a = w.node where w.hops < {most} and not exists(w.edges, x -> x.id = s.edge.id))
        select nodes, edges, hops from (select node as id, nodes, edges, hops from walk) where hops >= {least} and {end}"""


def ask_paths(graph: Graph, least: int, most: int, params: dict | None = None, **options) -> DataFrame:
    """The paths of :func:`path_question`; Spark's limit on the rows of a recursion is lifted, as none may be missing."""
    graph[0].sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return ask(graph, path_question(least, most, **options), params)


def query_present(graph: Graph, question: Question, params: dict | None = None) -> DataFrame:
    return ask(graph, question, params)


def query_future(graph: Graph, question: Question, params: dict | None = None, threshold: float = 0.0) -> DataFrame:
    """``:thr`` is available to the text; it filters nothing by itself."""
    return ask(graph, question, {**(params or {}), "thr": float(threshold)})


def query_both(
    present: Graph,
    future: Graph,
    question: Question,
    params: dict | None = None,
    as_of: float | None = None,
    mode: str = "table",
):
    """``(present, future)`` answers; in graph mode each is a ``(nodes, edges)`` pair seen as of ``as_of``.

    ``:t`` is bound to ``as_of`` in both modes; a table answer is not filtered by it.
    """
    bound = {**(params or {}), "t": as_of}
    answers = tuple(ask(g, question, bound) for g in (present, future))
    if mode == "table":
        return answers
    return tuple(as_of_graph(*rows_to_graph(a), as_of) for a in answers)


def as_of_graph(nodes: DataFrame, edges: DataFrame, t: float | None) -> Graph:
    """Edges that exist at ``t`` (unknown start: visible) and the nodes at their ends."""
    if t is None:
        return nodes, edges
    kept = as_of(edges, t)
    source, target = ("source", "target") if "source" in edges.columns else ("src", "dst")
    ends = kept.select(F.explode(F.array(source, target)).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), kept


def as_of(edges: DataFrame, t: float) -> DataFrame:
    starts = [c for c in ("first_ts", "ts", "timestamp") if c in edges.columns]
    start = F.coalesce(*[F.col(c).cast("double") for c in starts], F.lit(None).cast("double"))
    return edges.filter(F.coalesce(start <= F.lit(float(t)), F.lit(True)))


def _is_node(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and "id" in t.names and not _is_edge(t)


def _is_edge(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and {"source", "target", "type"} <= set(t.names)


def _merge(frames: list[DataFrame]) -> DataFrame | None:
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _found(rows: DataFrame, test: Callable[[T.DataType], bool]) -> DataFrame | None:
    """Structs of one kind from all columns, also inside lists."""
    frames = []
    for f in rows.schema.fields:
        if test(f.dataType):
            frames.append(rows.select(F.col(f"`{f.name}`").alias("x")).filter("x is not null").select("x.*"))
        elif isinstance(f.dataType, T.ArrayType) and test(f.dataType.elementType):
            frames.append(rows.select(F.explode(f"`{f.name}`").alias("x")).filter("x is not null").select("x.*"))
    return _merge(frames)


def edge_id() -> Column:
    return F.concat_ws("|", F.col("type"), F.col("source").cast("string"), F.col("target").cast("string"))


def rows_to_graph(rows: DataFrame) -> Graph:
    """Distinct nodes and edges found in any column of an answer.

    Struct columns with ``source``, ``target`` and ``type`` are edges (keyed by ``id`` or by
    type and ends), other structs with ``id`` are nodes; ends of edges are added as nodes.
    """
    spark = rows.sparkSession
    nodes, edges = _found(rows, _is_node), _found(rows, _is_edge)
    if edges is None:
        edges = spark.createDataFrame([], "id string, source string, target string, type string")
    elif "id" not in edges.columns:
        edges = edges.withColumn("id", edge_id())
    edges = edges.dropDuplicates(["id"])
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    if nodes is None:
        return ends, edges
    nodes = nodes.withColumn("__own", F.lit(1)).unionByName(ends.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in nodes.columns if c not in ("id", "__own")]
    if not columns:
        return nodes.select("id").distinct(), edges
    full = F.max_by(F.struct(*columns), "__own").alias("v")
    return nodes.groupBy("id").agg(full).select("id", "v.*"), edges


def path_to_graph(paths: DataFrame, nodes_col: str = "nodes", edges_col: str = "edges") -> Graph:
    """Distinct nodes and edges of path rows that hold a list of each."""
    nodes = paths.select(F.explode(nodes_col).alias("x")).select("x.*").dropDuplicates(["id"])
    edges = paths.select(F.explode(edges_col).alias("x")).select("x.*")
    if "id" not in edges.columns:
        edges = edges.withColumn("id", edge_id())
    return nodes, edges.dropDuplicates(["id"])


def edge_view(edges: DataFrame) -> DataFrame:
    """Standard edge rows for display: round, probability default by round, whole-number times."""
    has = set(edges.columns)
    level = F.coalesce(*[F.col(c) for c in ("predicted_timestep", "predicted") if c in has], F.lit(0)).cast("bigint")
    last = F.coalesce(*[F.col(c) for c in ("last_ts", "ts") if c in has], F.lit(0.0))
    first = F.coalesce(F.col("first_ts"), last) if "first_ts" in has else last
    probability = F.col("probability").cast("double") if "probability" in has else F.lit(None).cast("double")
    return edges.select(
        F.concat_ws("|", "type", F.col("src").cast("string"), F.col("dst").cast("string")).alias("id"),
        F.col("src").alias("source"), F.col("dst").alias("target"), "type",
        level.alias("predicted"), level.alias("predicted_timestep"),
        F.coalesce(probability, F.when(level == 0, 1.0).otherwise(0.0)).alias("probability"),
        last.cast("bigint").alias("timestamp"), first.cast("bigint").alias("first_ts"), last.cast("bigint").alias("last_ts"),
    )


def diff(present: DataFrame, future: DataFrame) -> DataFrame:
    """Rows of two answers with ``side``: ``present``, ``future`` or ``both``, by multiplicity.

    One grouping over all columns replaces two ``exceptAll`` and one ``intersectAll``.
    """
    columns = present.columns
    tagged = present.select(*columns, F.lit(1).alias("__p"), F.lit(0).alias("__f")).unionByName(
        future.select(*columns, F.lit(0).alias("__p"), F.lit(1).alias("__f"))
    )
    counts = tagged.groupBy(*columns).agg(F.sum("__p").alias("__p"), F.sum("__f").alias("__f"))
    sides = F.array(
        F.struct(F.lit("present").alias("side"), F.greatest(F.col("__p") - F.col("__f"), F.lit(0)).alias("n")),
        F.struct(F.lit("future").alias("side"), F.greatest(F.col("__f") - F.col("__p"), F.lit(0)).alias("n")),
        F.struct(F.lit("both").alias("side"), F.least("__p", "__f").alias("n")),
    )
    out = counts.select(*columns, F.explode(sides).alias("d")).filter("d.n > 0")
    return out.select(*columns, F.col("d.side").alias("side"), F.col("d.n").cast("bigint").alias("copies"))
