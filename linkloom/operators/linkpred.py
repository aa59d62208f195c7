"""Link prediction: sampled non-edges, pair features, logistic model, selection.

Pairs are ``(s, t)`` in canonical order; ``nodes`` has ``id`` and the dense ``nid``.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import first_rows, running_sums
from ..functions.scratch import cut, scratch_path
from ..functions.skew import find_hot, salted_join
from . import products
from .nonedges import open_pairs
from .products import products_in_cells, vectors_size


def edge_start() -> Column:
    """Time from which an edge exists."""
    return F.coalesce("first_ts", "ts", F.lit(0.0))


def sample_negatives(
    nodes: DataFrame,
    edges: DataFrame,
    k: int,
    as_of: float | None = None,
    seed: int | str = 42,
) -> DataFrame:
    """The first ``k`` non-edges ``(s, t, draw)`` of a keyed permutation of all of them; fewer only if there are no more.

    Edges that begin after ``as_of`` do not count.  Nodes may come with dense numbers ``nid`` or without; for the
    later rounds pass the nodes that have an embedding.  Every draw is an open pair, so none is turned round or wasted.
    """
    known = edges if as_of is None else edges.filter(edge_start() <= F.lit(float(as_of)))
    return open_pairs(nodes, known).first(k, seed)


def candidate_pool(
    nodes: DataFrame, edges: DataFrame, size: int, seed: int | str = "pool", version: int = 1
) -> DataFrame:
    """Ordered non-edges ``(s, t, pool_pos)``, the same for one graph, seed and version.

    A larger pool extends a smaller one: both are starts of the same permutation.
    """
    return open_pairs(nodes, edges).first(max(1, int(size)), f"{seed}|{version}").withColumnRenamed("draw", "pool_pos")


def pool_size(remaining: int) -> int:
    return max(3 * remaining, remaining + 200)


def family_pool(
    nodes: DataFrame, edges: DataFrame, used: DataFrame, remaining: int, seed: int | str = "pool", version: int = 1
) -> DataFrame:
    """Pool for one family, grown to ``max(3r, r + 200)``, without the pairs chosen before."""
    return unused(candidate_pool(nodes, edges, pool_size(remaining), seed, version), used)


def unused(pool: DataFrame, used: DataFrame) -> DataFrame:
    return pool.join(used.select("s", "t"), ["s", "t"], "left_anti")


def snapshot_cutoff(pairs: DataFrame, edges: DataFrame) -> float:
    """Latest start time of the original edges of the given pairs; 0 without any."""
    starts = edges.select(F.col("src").alias("s"), F.col("dst").alias("t"), edge_start().alias("v"))
    row = starts.join(pairs.select("s", "t"), ["s", "t"], "left_semi").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))
    return float(row.first()["v"])


def hadamard(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """Element-wise product of the two vectors in doubles; pairs without both vectors are dropped.

    Vectors travel in their own type, so those of a table of floats take half the room.  Few are joined to the pairs,
    many meet them in cells.
    """
    pairs = cut(pairs, "pairs")
    rows, dim = vectors_size(emb)
    if rows * dim > products.FEW_VALUES:
        return products_in_cells(pairs, emb, dim)
    left = F.broadcast(emb.select(F.col("node").alias("s"), F.col("vec").alias("__vs")))
    right = F.broadcast(emb.select(F.col("node").alias("t"), F.col("vec").alias("__vt")))
    one = salted_join(pairs, left, ["s"], find_hot(pairs, "s"))
    two = salted_join(one, right, ["t"], find_hot(pairs, "t"))
    product = F.zip_with("__vs", "__vt", lambda a, b: a.cast("double") * b.cast("double"))
    return two.select(*pairs.columns, product.alias("features"))


def negative_count(positives: int, ratio: float) -> int:
    return math.ceil(positives * max(0.0, min(10.0, float(ratio))))


def training_set(
    positives: DataFrame,
    emb: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    ratio: float = 1.0,
    as_of: float | None = None,
    seed: int | str = 42,
) -> DataFrame:
    """``(s, t, label, features)``: usable positives and as many sampled non-edges per positive."""
    pos = hadamard(positives.select("s", "t"), emb)
    want = negative_count(pos.count(), ratio)
    neg = hadamard(sample_negatives(nodes, edges, want, as_of, seed).select("s", "t"), emb)
    label = lambda df, v: df.select("s", "t", F.lit(v).alias("label"), "features")
    return label(pos, 1.0).unionByName(label(neg, 0.0))


def fit_logistic(train: DataFrame, max_iter: int = 200) -> LogisticRegressionModel:
    """L2-penalised logistic regression with weight 1 on the sum of losses and a free intercept.

    The model is stored and read back: a fitted one keeps a summary of its training that holds the session, and tasks
    cannot take it.
    """
    # the solver keeps its own blocks of rows, in memory and on disk; a second copy of the rows would double them
    rows = train.select("label", array_to_vector("features").alias("features"))
    fitted = LogisticRegression(
        regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9
    ).fit(rows)
    path = scratch_path(train.sparkSession, "model")
    fitted.save(path)
    return LogisticRegressionModel.load(path)


def score(pairs: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Adds ``probability`` of an edge; all pairs in one distributed transform."""
    keep = [c for c in pairs.columns if c != "features"]
    vectors = pairs.withColumn("features", array_to_vector("features"))
    out = model.transform(vectors)
    return out.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5, by: str | None = None) -> DataFrame:
    """One row (per value of ``by``): counts, AUC, average precision, accuracy, precision, recall, F1.

    Exact: rows are first counted per distinct score, then running counts in score order
    give the rank sums; no binning.  Null where a class is missing, 0 on a zero division.
    """
    is_pos = F.col("label") == 1
    group = F.lit("all") if by is None else F.col(by)
    counts = scored.groupBy(group.alias("__by"), "probability").agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")
    )
    order = [F.col("__by").asc(), F.col("probability").desc()]
    steps = running_sums(counts, order, {"cum_pos": "pos", "cum_neg": "neg"})
    # one row per group: what the groups before it have summed up
    before = steps.groupBy("__by").agg(
        F.min(F.col("cum_pos") - F.col("pos")).alias("from_pos"), F.min(F.col("cum_neg") - F.col("neg")).alias("from_neg")
    )
    # without ``by`` this is one row
    steps = steps.join(before if by is not None else F.broadcast(before), "__by").withColumns(
        {"cum_pos": F.col("cum_pos") - F.col("from_pos"), "cum_neg": F.col("cum_neg") - F.col("from_neg")}
    )
    high = F.col("probability") >= F.lit(float(threshold))
    pos, neg, cum = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("cum_pos").cast("double")
    grouped = steps.groupBy("__by") if by is not None else steps
    sums = grouped.agg(
        F.sum("pos").alias("count_pos"),
        F.sum("neg").alias("count_neg"),
        F.sum(neg * (cum - pos) + neg * pos / 2).alias("__rank"),
        F.sum(pos * cum / (F.col("cum_pos") + F.col("cum_neg"))).alias("__step"),
        F.coalesce(F.sum(F.when(high, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(high, F.col("neg"))), F.lit(0)).alias("fp"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    total = F.col("count_pos") + F.col("count_neg")
    out = sums.select(
        *([F.col("__by").alias(by)] if by is not None else []), "count_pos", "count_neg",
        F.when((F.col("count_pos") > 0) & (F.col("count_neg") > 0), F.col("__rank") / (F.col("count_pos") * F.col("count_neg"))).alias("auc"),
        F.when(F.col("count_pos") > 0, F.col("__step") / F.col("count_pos")).alias("ap"),
        F.when(total > 0, (F.col("tp") + F.col("count_neg") - F.col("fp")) / total).alias("accuracy"),
        F.when(total > 0, ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(total > 0, ratio(F.col("tp"), F.col("count_pos"))).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def select_threshold_first(
    scored: DataFrame, k: int, threshold: float, avoid: DataFrame | None = None, fill_below: bool = True
) -> DataFrame:
    """The first ``k`` in pool order with p >= threshold, then (if allowed) the best below it."""
    rows = scored if avoid is None else scored.join(avoid.select("s", "t"), ["s", "t"], "left_anti")
    above = F.col("probability") >= F.lit(float(threshold))
    if not fill_below:
        rows = rows.filter(above)
    order = [
        above.desc(), F.when(above, F.col("pool_pos")).asc_nulls_last(), F.col("probability").desc(),
        F.col("s").asc(), F.col("t").asc(),
    ]
    return first_rows(rows, order, max(1, int(k)))


def select_top_k(scored: DataFrame, k: int, threshold: float) -> DataFrame:
    """Best ``k`` by probability; pairs above the threshold come first by the same order."""
    order = [F.col("probability").desc(), F.col("s").asc(), F.col("t").asc()]
    return first_rows(scored, order, max(1, int(k)))


def selection_report(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_scored"),
        F.count_if(F.col("probability") >= F.lit(float(threshold))).alias("above_threshold"),
    )


def select_test_first(scored_test: DataFrame, scored_pool: DataFrame, k: int, threshold: float) -> DataFrame:
    """Test pairs >= threshold in their order, then the pool's selection for what is left."""
    test = scored_test.filter(F.col("probability") >= F.lit(float(threshold)))
    rest = scored_pool.join(test.select("s", "t"), ["s", "t"], "left_anti")
    columns = ["s", "t", "probability", "pool_pos"]
    rows = test.select(F.lit(0).alias("stage"), *columns).unionByName(rest.select(F.lit(1).alias("stage"), *columns))
    above = (F.col("probability") >= F.lit(float(threshold))) | (F.col("stage") == 0)
    order = [
        F.col("stage"), above.desc(), F.when(above, F.col("pool_pos")).asc_nulls_last(),
        F.col("probability").desc(), F.col("s"), F.col("t"),
    ]
    return first_rows(rows, order, max(1, int(k)))


def select_at_least_k(scored: DataFrame, k: int, threshold: float, avoid: DataFrame | None = None) -> DataFrame:
    """As the threshold-first selector, over distinct pairs (first pool position wins)."""
    single = scored.groupBy("s", "t").agg(F.min("pool_pos").alias("pool_pos"), F.min_by("probability", "pool_pos").alias("probability"))
    return select_threshold_first(single, k, threshold, avoid)


def recognized_test_pairs(scored_test: DataFrame, threshold: float) -> DataFrame:
    """All test pairs with p >= threshold, independent of any ``k``."""
    return scored_test.filter(F.col("probability") >= F.lit(float(threshold)))


def avoid_set(predicted: DataFrame, *sets: DataFrame) -> DataFrame:
    """Earlier predicted pairs and all known pairs, each once."""
    out = predicted.select("s", "t")
    for pairs in sets:
        out = out.unionByName(pairs.select("s", "t"))
    return out.distinct()
