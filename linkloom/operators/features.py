"""Node features: column classes, one-hot columns, projectable properties."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pairs import as_number
from ..sources.snapshots import FAMILIES, merge_props
from .graph import degree

MAX_CATEGORIES = 256
# Names and prefixes of properties that hold embeddings.
EMBEDDING_NAMES = {
    "FastRP", "Node2Vec", "GraphSAGE", "HashGNN", "TGN",
    "fastrp", "node2vec", "graphsage", "hashgnn", "tgn",
    "embedding_n2v_128", "embedding_fastrp_256", "embedding_sage_64", "embedding_hash_128",
}
EMBEDDING_PREFIXES = ("fastrp_", "node2vec_", "graphsage_", "hashgnn_", "tgn_", "emb_", "embedding_")


def _numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _profile(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column: rows, present, numeric-coercible and not 0/1 counts, in one aggregate pass."""
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        col, kind = F.col(f"`{c}`"), types[c]
        if isinstance(kind, T.ArrayType):
            inner = isinstance(kind.elementType, T.NumericType)
            number = F.lit(inner)
            binary = F.forall(col, lambda x: x.isNull() | x.isin(0, 1)) if inner else F.lit(False)
        elif isinstance(kind, T.BooleanType):
            number, binary = F.lit(False), F.lit(False)
        else:
            value = col.cast("double") if _numeric_type(kind) else as_number(col)
            number, binary = value.isNotNull(), value.isin(0.0, 1.0)
        aggs += [
            F.count(col).alias(f"p{i}"),
            F.count_if(col.isNotNull() & number).alias(f"n{i}"),
            F.count_if(col.isNotNull() & ~F.coalesce(binary, F.lit(False))).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        c: {
            "rows": row["rows"], "present": row[f"p{i}"], "numeric": row[f"n{i}"], "not_binary": row[f"b{i}"],
            "text": isinstance(types[c], T.StringType),
        }
        for i, c in enumerate(columns)
    }


def _class_of(p: dict) -> str:
    if p["present"] == 0:
        return "drop_empty"
    if p["numeric"] == p["present"]:
        return "numeric"
    if p["text"]:
        return "encode" if p["present"] == p["rows"] else "drop_nulls"
    return "drop_mixed"


def classify_columns(df: DataFrame, key: str = "id") -> dict[str, str]:
    """Class per column: ``numeric``, ``encode`` or one of the ``drop_*`` reasons.

    A text column with numbers in some rows only is text; non-text columns that are not
    numeric (booleans, arrays of text) are dropped as mixed.
    """
    return {c: _class_of(p) for c, p in _profile(df, [c for c in df.columns if c != key]).items()}


def class_report(df: DataFrame, key: str = "id") -> DataFrame:
    """The classes as rows, from one aggregate over the whole table."""
    columns = [c for c in df.columns if c != key]
    profile = _profile(df, columns)
    rows = [(c, profile[c]["rows"], profile[c]["present"], profile[c]["numeric"], _class_of(profile[c])) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, rows bigint, present bigint, numeric bigint, class string")


def categories(df: DataFrame, columns: list[str], limit: int = MAX_CATEGORIES) -> dict[str, list]:
    """Sorted distinct values per column; a column with more than ``limit`` maps to ``None``.

    At most ``limit + 1`` values per column reach the driver.
    """
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])).alias("cell")
    # one pass for all columns; a column keeps its first limit + 1 values, also before the shuffle
    found = df.select(cells).select("cell.*").filter("v is not null").distinct()
    first = Window.partitionBy("i").orderBy("v")
    rows = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= limit + 1).collect()
    out: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        out[columns[r["i"]]].append(r["v"])
    return {c: sorted(v) if len(v) <= limit else None for c, v in out.items()}


def _safe_suffix(value) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", str(value)).strip("_") or "val"


def _coverage_suffix(value) -> str:
    text = re.sub(r"[^A-Za-z0-9_]", "_", re.sub(r"\s+", "_", str(value).strip()))
    return (text or "cat")[:64]


def _slug_suffix(value) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in str(value)).strip("_") or "val"


def one_hot(df: DataFrame, key: str = "id", max_categories: int = MAX_CATEGORIES) -> tuple[DataFrame, dict]:
    """Numeric columns as double, clean text columns as ``numeric_<col>_<category>`` in {0.0, 1.0}.

    Names that collide get ``_2``, ``_3``; columns with too many categories are dropped and reported.
    """
    classes = classify_columns(df, key)
    stale = {
        c
        for c in df.columns
        for text in (x for x, k in classes.items() if k == "encode")
        if c != text and c.startswith(f"numeric_{text}_")
    }
    encode = [c for c, k in classes.items() if k == "encode" and c not in stale]
    values = categories(df, encode, max_categories)
    out, taken = [F.col(key)], {key}
    report = {"numeric": [], "encoded": {}, "too_many": [], "dropped": []}
    for c, kind in classes.items():
        if c in stale:
            continue
        if kind == "numeric":
            plain = _numeric_type(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.ArrayType)
            out.append((F.col(f"`{c}`") if plain else as_number(F.col(f"`{c}`"))).alias(c))
            taken.add(c)
            report["numeric"].append(c)
    for c in [c for c in classes if c not in stale and classes[c] != "numeric"]:
        if classes[c] != "encode":
            report["dropped"].append(c)
        elif values[c] is None:
            report["too_many"].append(c)
        else:
            made = []
            for v in values[c]:
                name = base = f"numeric_{c}_{_safe_suffix(v)}"
                n = 1
                while name in taken:
                    n += 1
                    name = f"{base}_{n}"
                taken.add(name)
                made.append(name)
                out.append((F.col(f"`{c}`") == F.lit(v)).cast("double").alias(name))
            report["encoded"][c] = made
    return df.select(*out), report


def _covered_text(df: DataFrame, key: str, coverage: float, pure: bool) -> list[str]:
    columns = [c for c in df.columns if c != key and c not in FAMILIES and not c.startswith("numeric_")]
    out = []
    for c, p in _profile(df, columns).items():
        enough = p["present"] > 0 and p["present"] >= math.ceil(coverage * p["rows"])
        if enough and p["text"] and not (pure and p["numeric"]):
            out.append(c)
    return sorted(out)


def one_hot_named(
    df: DataFrame, key: str = "id", coverage: float = 1.0, max_categories: int = MAX_CATEGORIES, style: str = "coverage"
) -> DataFrame:
    """Variants by naming: ``coverage`` gives ``numeric_<col>__<suffix>``, ``slug`` ``numeric_<col>_<slug>``.

    Only text columns present on at least ``ceil(coverage * N)`` rows; nulls stay null; the
    original columns are dropped.  Two categories with one name: the later one (in order) wins.
    """
    names = _covered_text(df, key, coverage, pure=False)
    values = categories(df, names, max_categories)
    drop, made = [], {}
    for c in names:
        if not values[c]:
            continue
        drop.append(c)
        for v in values[c]:
            label = f"numeric_{c}__{_coverage_suffix(v)}" if style == "coverage" else f"numeric_{c}_{_slug_suffix(v)}"
            made[label] = F.when(F.col(f"`{c}`").isNotNull(), (F.col(f"`{c}`") == F.lit(v)).cast("double")).alias(label)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in drop and c not in made]
    return df.select(*keep, *made.values())


def one_hot_vector(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """``numeric_<column>`` as an array of 0/1 over the sorted categories; null gives all zeros."""
    values = categories(df, [column], max_categories)[column]
    if not values:
        return df
    vector = F.transform(
        F.array(*[F.lit(v) for v in values]),
        lambda v: F.coalesce((v == F.col(f"`{column}`")).cast("double"), F.lit(0.0)),
    )
    return df.withColumn(f"numeric_{column}", vector)


def discover(df: DataFrame, kind: str, key: str = "id", coverage: float = 1.0) -> list[str]:
    """Columns with enough coverage whose values are all numbers (``numeric``) or none is (``string``)."""
    columns = [c for c in df.columns if c != key and c not in FAMILIES]
    if kind == "string":
        columns = [c for c in columns if not c.startswith("numeric_")]
    out = []
    for c, p in _profile(df, columns).items():
        if p["present"] == 0 or p["present"] < math.ceil(coverage * p["rows"]):
            continue
        if kind == "numeric" and (p["numeric"] == p["present"] or c.startswith("numeric_")):
            out.append(c)
        if kind == "string" and p["numeric"] == 0 and p["text"]:
            out.append(c)
    return sorted(out)


def prepare_features(
    df: DataFrame, key: str = "id", coverage: float = 1.0, max_categories: int = MAX_CATEGORIES
) -> tuple[DataFrame, list[str]]:
    """Full-coverage text becomes 0/1 vectors; returns the frame with the projectable columns."""
    for c in discover(df, "string", key, coverage):
        df = one_hot_vector(df, c, max_categories)
    props = discover(df, "numeric", key, coverage)
    return df.select(key, *[F.col(f"`{c}`") for c in props]), props


def purge_non_numeric(df: DataFrame, keep: tuple[str, ...] = ("id",), keep_bool: bool = False) -> DataFrame:
    """Drop every column with any non-numeric value; ``numeric_*`` and embeddings stay."""
    safe = lambda c: c in keep or c in FAMILIES or c.startswith("numeric_")
    bools = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)} if keep_bool else set()
    checked = [c for c in df.columns if not safe(c) and c not in bools]
    bad = [c for c, p in _profile(df, checked).items() if p["numeric"] < p["present"]]
    return df.drop(*bad)


def drop_embedding_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in EMBEDDING_NAMES and not c.startswith(EMBEDDING_PREFIXES)]


def supported_columns(df: DataFrame, key: str = "id", fallback: bool = True) -> list[str]:
    """Scalar or numeric-list columns; all columns if none is left and ``fallback`` is set."""

    def ok(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return isinstance(t.elementType, T.NumericType)
        return isinstance(t, (T.NumericType, T.BooleanType, T.StringType))

    columns = [f.name for f in df.schema.fields if f.name != key]
    good = [f.name for f in df.schema.fields if f.name != key and ok(f.dataType)]
    return good or (columns if fallback else [])


def binary_columns(df: DataFrame, key: str = "id") -> list[str]:
    """Columns whose non-null values are all 0 or 1."""
    columns = [c for c in df.columns if c != key and c not in FAMILIES]
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if not isinstance(types[c], T.StringType)]
    return [c for c, p in _profile(df, numeric).items() if p["not_binary"] == 0]


def join_features(nodes: DataFrame, features: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Features of kept nodes only, encoded after the restriction, joined to all nodes."""
    kept = features.join(nodes.select("id"), "id", "left_semi")
    return nodes.join(one_hot(kept, "id", max_categories)[0], "id", "left")


def normalize_existing(nodes: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Encode stored node properties, write them over the old ones and purge the rest."""
    encoded, _ = one_hot(nodes, "id", max_categories)
    # properties that could not be encoded stay on the node until the purge removes them
    return purge_non_numeric(merge_props(nodes, encoded))


def degree_feature(nodes: DataFrame, edges: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """The degree as the only feature where no numeric feature exists."""
    if features:
        return nodes.select("id", *features), features
    d = degree(edges).select(F.col("node").alias("id"), F.col("degree").cast("double").alias("degree"))
    return nodes.select("id").join(d, "id", "left").na.fill(0.0, ["degree"]), ["degree"]


def present_columns(df: DataFrame, key: str = "id") -> list[str]:
    """Columns with any non-null value, from a full pass."""
    return sorted(c for c, p in _profile(df, [c for c in df.columns if c != key]).items() if p["present"] > 0)


def feature_vector(columns: list[str], df: DataFrame) -> Column:
    """One ``array<double>`` of scalar and list features; nulls become zero."""
    parts = []
    for c in columns:
        col = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, T.ArrayType):
            parts.append(F.transform(col, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))
        else:
            parts.append(F.array(F.coalesce(col.cast("double"), F.lit(0.0))))
    return F.concat(*parts)
