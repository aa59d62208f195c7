"""Turning a raw interaction list into canonical undirected temporal edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ordering import global_index
from ..functions.pairs import as_number, canonical, canonical_distinct, distinct_ends, id_order
from ..functions.scratch import cut
from ..functions.skew import keep_ends
from .contraction import components_by_contraction
from .graph import component_sizes

DEFAULT_TYPE = "REL"


def sanitize_type(col: Column | None) -> Column:
    """Letters, digits and ``_`` only; nothing left (or no column) gives ``REL``."""
    if col is None:
        return F.lit(DEFAULT_TYPE)
    kept = F.regexp_replace(col.cast("string"), r"[^\p{L}\p{N}_]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(DEFAULT_TYPE))


def with_type(df: DataFrame, column: str | None = "rel_type") -> DataFrame:
    present = column is not None and column in df.columns
    out = df.withColumn("type", sanitize_type(F.col(column) if present else None))
    return out.drop(column) if present and column != "type" else out


def resolve_timestamp(df: DataFrame, column: str | None, temporal: bool = True) -> DataFrame:
    """Numeric ``ts`` from the column found in any case; any bad value is an error.

    Without ``temporal`` every row gets 0.0, also if a time column exists.
    """
    out, found = _timed(df, column, temporal)
    if found is not None:
        _refuse(found, out.agg(_bad()).first()["bad"])
    return out


def _bad() -> Column:
    """Number of rows without a time after :func:`_timed`."""
    return F.count(F.when(F.col("ts").isNull(), 1)).alias("bad")


def _timed(df: DataFrame, column: str | None, temporal: bool) -> tuple[DataFrame, str | None]:
    """:func:`resolve_timestamp` before its values are looked at (``ts`` is null for a bad one), and the column's name."""
    if not temporal:
        return df.withColumn("ts", F.lit(0.0)), None
    if not column or not column.strip():
        raise ValueError("a temporal load needs the name of the time column")
    found = next((c for c in df.columns if c.lower() == column.strip().lower()), None)
    if found is None:
        raise ValueError(f"no time column '{column}'")
    return df.withColumn("__time", as_number(F.col(found))).drop(found).withColumnRenamed("__time", "ts"), found


def _refuse(found: str, bad: int) -> None:
    if bad:
        raise ValueError(f"time column '{found}' has {bad} non-numeric or missing value(s)")


def drop_null_endpoints(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["src", "dst"])


def drop_self_loops(df: DataFrame) -> DataFrame:
    return distinct_ends(df, "src", "dst")


def canonicalize_direction(df: DataFrame) -> DataFrame:
    return canonical(df, "src", "dst")


def collapse_edges(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per (src, dst, type) with its times and the last non-null property values.

    Exact duplicates of (pair, type, time) are removed first, so a pair with a third of
    all rows is spread over the shuffle before its time list is built.
    """
    keys = ["src", "dst", "type"]
    order = order or [c for c in ("row_idx",) if c in df.columns]
    props = [c for c in df.columns if c not in {*keys, "ts", *order}]
    times = timestamp_rollup(df.select(*keys, "ts"))
    if not props:
        return times
    if not order:
        raise ValueError("property columns need an order: pass 'order' or add 'row_idx'")
    rank = F.struct(*order)
    last = df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in props])
    return times.join(last, keys)


def timestamp_rollup(df: DataFrame) -> DataFrame:
    """Sorted distinct times per (src, dst, type) with first, last and count; ``ts`` is the last."""
    single = df.select("src", "dst", "type", "ts").distinct()
    return _with_bounds(single.groupBy("src", "dst", "type").agg(F.sort_array(F.collect_list("ts")).alias("timestamps")))


def _with_bounds(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "first_ts": F.element_at("timestamps", 1),
            "last_ts": F.element_at("timestamps", -1),
            "ts": F.element_at("timestamps", -1),
            "interaction_count": F.size("timestamps").cast("bigint"),
        }
    )


def clean_pairs(raw: DataFrame, time_column: str | None = None, temporal: bool = True) -> DataFrame:
    """The distinct ``(src, dst)`` of :func:`clean_edges`, with its checks but without types and time lists: one exchange."""
    return canonical_distinct(drop_null_endpoints(resolve_timestamp(raw, time_column, temporal)), "src", "dst").select("src", "dst").distinct()


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges inside the largest component; ties go to the smallest component id."""
    nodes = cut(components_by_contraction(edges), "components")
    biggest = component_sizes(nodes).orderBy(F.col("size").desc(), F.col("component")).limit(1).collect()
    if not biggest:
        return edges
    kept = nodes.filter(F.col("component") == F.lit(biggest[0]["component"])).select("node")
    return keep_ends(edges, kept, ("src",))


def component_report(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edge and node counts before and after keeping one component."""

    def part(df: DataFrame, side: str) -> DataFrame:
        ends = df.select("src", "dst")
        return ends.agg(F.count(F.lit(1)).alias("edges")).select(F.lit(side).alias("side"), "edges").join(
            nodes_from_edges(df).agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(side).alias("side"), "nodes"),
            "side",
        )

    return part(edges, "before").unionByName(part(kept, "after"))


def nodes_from_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


# Columns of an edge that are not properties.
CORE_COLUMNS = ["src", "dst", "type", "rel_type", "row_idx"]


def edge_property_columns(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in CORE_COLUMNS]


def assign_nid(nodes: DataFrame, col: str = "id") -> DataFrame:
    """Dense 0-based ``nid`` in id order (numbers by value, then text)."""
    return global_index(nodes, id_order(col), "nid")


def clean_edges(
    raw: DataFrame,
    time_column: str | None = None,
    temporal: bool = True,
    type_column: str | None = "rel_type",
    order: list[str] | None = None,
    keep_largest: bool = False,
) -> DataFrame:
    """The whole cleaning chain; everything before the collapse is one narrow stage."""
    df = drop_null_endpoints(resolve_timestamp(with_type(raw, type_column), time_column, temporal))
    edges = collapse_edges(canonical_distinct(df, "src", "dst"), order).withColumn("predicted", F.lit(0))
    # the component loop reads the edges many times, the cleaning runs once
    return largest_component(cut(edges, "collapsed")) if keep_largest else edges


def stored_edges(raw: DataFrame, time_column: str, type_column: str | None = "rel_type", label: str = "edges") -> DataFrame:
    """:func:`clean_edges`, written; bad times are counted while the rows pass, so ``raw`` is made only once."""
    timed, found = _timed(with_type(raw, type_column), time_column, True)
    seen = Observation()
    # a bad time is only counted here; the written rows are refused then
    rows = drop_null_endpoints(timed.observe(seen, _bad()).na.fill(0.0, ["ts"]))
    stored = cut(collapse_edges(canonical_distinct(rows, "src", "dst")).withColumn("predicted", F.lit(0)), label)
    _refuse(found, seen.get["bad"])
    return stored
