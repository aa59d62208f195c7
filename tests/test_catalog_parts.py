"""What the registered queries build: no more of the graphs and series than they ask for."""

import pytest
from pyspark.sql import functions as F

from linkloom.catalog import base

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def fresh(spark, monkeypatch):
    monkeypatch.setattr(base, "_STORED", {})
    return base.Graphs(spark, FOLDER)


def test_one_family_does_not_make_the_series(spark, fresh):
    chosen = set(fresh.chosen().collect())
    tgn = set(fresh.family_series("TGN", 0.95).collect())
    ends = set(fresh.both_nodes().collect())
    assert not any(fresh.has_stored(x) for x in ("series", "supply_edges", "trade_edges", "supply_nodes", "trade_nodes"))
    rows = fresh.series()
    assert chosen == set(rows.filter("family = 'FastRP' and probability >= 0.9").select("s", "t", "probability").collect()) and chosen
    assert tgn == set(rows.filter("family = 'TGN' and probability >= 0.95").collect()) == set(fresh.family_series("TGN", 0.95).collect())
    for name in ("trade", "supply"):
        bare = fresh.bare_pairs(name).collect()
        assert len(bare) == len(set(bare)) and set(bare) == set(fresh.pairs(name).collect()) == set(fresh.bare_pairs(name).collect())
    assert ends == set(fresh.nodes("trade").select("id").unionByName(fresh.nodes("supply").select("id")).collect())


def test_bare_pairs_keep_the_checks_of_the_cleaning(spark):
    raw = spark.createDataFrame([("b", "a", "1"), ("a", "b", "2"), ("a", "a", "1"), (None, "c", "1"), ("10", "9", "3")], "src string, dst string, ts string")
    assert {tuple(r) for r in base.clean.clean_pairs(raw, "ts").collect()} == {("a", "b"), ("9", "10")}
    with pytest.raises(ValueError):
        base.clean.clean_pairs(raw.withColumn("ts", F.lit("late")), "ts")


def test_matrix_needs_one_exchange_of_the_pairs(spark):
    """Repeated and turned pairs count once, without an exchange for a distinct step."""
    from linkloom.operators import compare

    rows = [("A", "1", "2"), ("A", "2", "1"), ("A", "1", "2"), ("A", "3", "4"), ("B", "1", "2"), ("C", "9", "9")]
    pairs = spark.createDataFrame(rows, "family string, s string, t string")
    truth = spark.createDataFrame([("2", "1"), ("1", "2"), ("5", "6")], "s string, t string")
    out = compare.comparison_matrix(pairs, truth, ["A", "B"])
    got = {(r.row, r.col): r.pct for r in out.collect()}
    assert got[("A", "B")] == 100.0 and got[("A", compare.GROUND_TRUTH)] == 50.0 and got[("B", "B")] == 100.0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_products_of_floats_are_doubles(spark, monkeypatch):
    """Vectors go through the joins as they are; the product is that of the doubles."""
    from linkloom.operators import linkpred

    emb = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [0.3, -0.7])], "node string, vec array<float>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "none")], "s string, t string")
    sides, real = [], linkpred.salted_join
    monkeypatch.setattr(linkpred, "salted_join", lambda big, other, *rest: sides.append(dict(other.dtypes)) or real(big, other, *rest))
    wide = emb.withColumn("vec", F.col("vec").cast("array<double>"))
    got = linkpred.hadamard(pairs, emb)
    assert got.collect() == linkpred.hadamard(pairs, wide).collect() and dict(got.dtypes)["features"] == "array<double>"
    assert sides[0]["__vs"] == sides[1]["__vt"] == "array<float>"


def test_score_joins_the_vectors_once_a_set(spark, fresh, monkeypatch):
    """The scored pairs are the positives of the training set: their products are not made a second time."""
    from linkloom.catalog import prediction

    calls, real = [], prediction.lp.hadamard
    monkeypatch.setattr(prediction.lp, "hadamard", lambda *a: calls.append(1) or real(*a))
    out = prediction.score(fresh)
    assert len(calls) == 2
    usable = real(fresh.pairs("handoff"), prediction._table_vectors(fresh)).select("s", "t")
    assert set(out.select("s", "t").collect()) == set(usable.collect())
