import math

import pytest
from pyspark.sql import functions as F

from linkloom.operators import linkpred, products


def rows_of(df):
    return sorted(map(repr, df.collect()))


def odd_vectors(spark, kind):
    """A node twice, one without a vector, a shorter one, one with a missing entry, one that no pair has; ids that are null."""
    rows = [(str(i), [float(i) / 8, 0.1 * i, -1.5]) for i in range(12)]
    rows += [("3", [1.0, 2.0, 3.0]), ("4", None), ("5x", [0.5, 0.25]), ("6x", [None, 1.0, math.inf]), (None, [1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, f"node string, vec array<{kind}>")


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("most", [32_000_000, 6])
def test_cells_give_what_joins_give(spark, monkeypatch, kind, most):
    """Vectors that repeat, are missing, ragged or hold nulls; pairs that repeat, and cells that are parted."""
    emb = odd_vectors(spark, kind)
    pairs = [(str(a), str(b), a * b) for a in range(12) for b in range(a, 12)] + [("1", "2", 7)] * 3
    pairs += [("5x", "1", 1), ("2", "6x", 2), ("5x", "6x", 3), ("1", "gone", 4), (None, "1", 5), ("1", None, 6)]
    df = spark.createDataFrame(pairs, "s string, t string, pool_pos bigint")
    want = rows_of(linkpred.hadamard(df, emb))
    monkeypatch.setattr(products, "FEW_VALUES", 0)
    monkeypatch.setattr(products, "CELL_VALUES", most)
    got = linkpred.hadamard(df, emb)
    assert rows_of(got) == want and rows_of(got.select("features", "s", "t", "pool_pos").select(*df.columns, "features")) == want
    plain = emb.filter("node in ('1', '2', '7')")
    assert linkpred.hadamard(df, plain).count() == 9 and linkpred.hadamard(df, emb.limit(0)).count() == 0


def test_training_set_and_fit_in_cells(spark, monkeypatch):
    """The same rows and model either way; a fit keeps no copy of the products, and running through them again moves no row."""
    emb = spark.range(40).select(F.col("id").cast("string").alias("node"), F.array(*[F.sin(F.col("id") * (j + 1)).cast("float") for j in range(3)]).alias("vec"))
    nodes = spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").alias("nid"))
    edges = spark.range(200).select((F.col("id") * 7 % 40).cast("string").alias("src"), (F.col("id") * 11 % 37).cast("string").alias("dst")).filter("src <> dst").distinct()
    edges = edges.withColumns({"first_ts": F.lit(1.0), "ts": F.lit(1.0)}).localCheckpoint()
    positives = edges.select(F.col("src").alias("s"), F.col("dst").alias("t"))
    make = lambda: linkpred.training_set(positives, emb, nodes, edges)
    joined = make()
    monkeypatch.setattr(products, "FEW_VALUES", 0)
    celled = make()
    assert rows_of(celled) == rows_of(joined)
    plan = celled._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan
    kept = []
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: kept.append(1) or self)
    a, b = linkpred.fit_logistic(joined), linkpred.fit_logistic(celled)
    assert not kept and abs(a.intercept - b.intercept) < 1e-9 and abs(a.coefficients.toArray() - b.coefficients.toArray()).max() < 1e-9
