import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import ordering
from linkloom.functions.hashing import shuffled_index
from linkloom.functions.ordering import first_rows, previous_row, running_sums
from linkloom.operators import clean, compare, features, linkpred, nonedges, predicted, query
from linkloom.operators.embeddings import store
from linkloom.operators.embeddings.families import embed
from linkloom.operators.nonedges import open_pairs, pair_at, pair_place
from linkloom.operators.splits import execute_split
from linkloom.plans import prediction as plan
from linkloom.sources.snapshots import RUN_LOG_COLUMNS, SnapshotStore


@pytest.fixture(scope="module")
def community(spark):
    """Two groups of 20 with dense links inside and few between, links spread over ten times."""
    rng = np.random.default_rng(1)
    rows = []
    for a in range(40):
        for b in range(a + 1, 40):
            if rng.random() < (0.5 if a // 20 == b // 20 else 0.02):
                rows.append((str(a), str(b), str(int(rng.integers(0, 10)))))
    raw = spark.createDataFrame(rows, "src string, dst string, ts string")
    edges = clean.clean_edges(raw, "ts").persist()
    nodes = clean.assign_nid(clean.nodes_from_edges(edges)).persist()
    return nodes, edges


def known(edges):
    return {(r["src"], r["dst"]) for r in edges.select("src", "dst").collect()}


def test_negatives_are_no_edges(spark, community):
    nodes, edges = community
    out = [(r["s"], r["t"]) for r in linkpred.sample_negatives(nodes, edges, 100, seed=3).collect()]
    assert len(out) == 100 and len(set(out)) == len(out)
    assert not set(out) & known(edges) and all(int(a) < int(b) for a, b in out)
    later = linkpred.sample_negatives(nodes, edges, 100, as_of=-1.0, seed=3)
    assert later.count() >= len(out)


def test_small_pool_lists_every_open_pair(spark, community):
    nodes, edges = community
    pool = linkpred.candidate_pool(nodes, edges, 5000).collect()
    pairs = {(r["s"], r["t"]) for r in pool}
    every = {(str(a), str(b)) for a in range(40) for b in range(a + 1, 40)}
    assert pairs == every - known(edges) and len(pool) == len(pairs)


def test_larger_pool_extends_the_smaller(spark):
    nodes = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("nid"))
    edges = spark.createDataFrame([("1", "2", 1.0, 1.0)], "src string, dst string, first_ts double, ts double")
    small = [(r["s"], r["t"]) for r in linkpred.candidate_pool(nodes, edges, 50).orderBy("pool_pos").collect()]
    large = [(r["s"], r["t"]) for r in linkpred.candidate_pool(nodes, edges, 80).orderBy("pool_pos").collect()]
    assert len(small) == 50 and large[:50] == small


def newton(x, y, rounds=50):
    w = np.zeros(x.shape[1] + 1)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(len(w))
    penalty[-1, -1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x1 @ w))
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (p - y) + penalty @ w)
    return w


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x @ [1, -2, 0.5, 0] + rng.normal(size=300) > 0.3).astype(float)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, features array<double>")
    model = linkpred.fit_logistic(df)
    w = newton(x, y)
    assert np.allclose(model.coefficients.toArray(), w[:-1], atol=1e-5) and abs(model.intercept - w[-1]) < 1e-5
    scored = linkpred.score(df.withColumn("s", F.lit("a")), model).collect()
    assert len(scored) == 300 and all(0 < r["probability"] < 1 for r in scored)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_metrics_with_ties_and_missing_classes(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(400), 1), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, probability double")
    m = linkpred.binary_metrics(df).first()
    assert abs(m["auc"] - brute_auc(y, p)) < 1e-12
    assert abs(m["accuracy"] - ((p >= 0.5) == y).mean()) < 1e-12
    steps, ap, last = sorted(set(p), reverse=True), 0.0, 0.0
    for s in steps:
        recall = ((p >= s) & (y == 1)).sum() / y.sum()
        ap, last = ap + (recall - last) * ((p >= s) & (y == 1)).sum() / (p >= s).sum(), recall
    assert abs(m["ap"] - ap) < 1e-12
    only = linkpred.binary_metrics(df.filter("label = 1")).first()
    assert only["auc"] is None and only["count_neg"] == 0
    none = linkpred.binary_metrics(df.filter("label > 5")).first()
    assert none["ap"] is None and none["f1"] in (None, 0.0)


def test_running_sums_and_previous_row(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    sums = {r["v"]: r["total"] for r in running_sums(df, [F.col("v").asc()], {"total": "v"}).collect()}
    assert sums[49] == sum(range(50)) and sums[10] == 55
    prev = {r["v"]: r["p"] for r in previous_row(df, ["g"], [F.col("v").asc()], {"p": "v"}).collect()}
    assert prev[0] is None and prev[2] is None and prev[3] == 0 and prev[49] == 46


@pytest.mark.parametrize("k", [0, 1, 20, 99, 100, 500])
def test_first_rows(spark, k):
    df = spark.range(100)
    assert sorted(r["id"] for r in first_rows(df, [F.col("id").desc()], k).collect()) == list(range(max(0, 100 - k), 100))


def test_negatives_are_topped_up(spark, community):
    nodes, edges = community
    every = {(str(a), str(b)) for a in range(40) for b in range(a + 1, 40)} - known(edges)
    got = [(r["s"], r["t"]) for r in linkpred.sample_negatives(nodes, edges, 10_000, seed=1).collect()]
    assert len(got) == len(every) and set(got) == every
    assert linkpred.sample_negatives(nodes, edges, len(every) - 3, seed=1).count() == len(every) - 3


@pytest.mark.parametrize("numbers", [None, "sparse", "repeated"])
def test_open_pairs_by_rank(spark, numbers):
    """Nearly complete, nearly empty and starlike graphs; numbers that are not dense, rows and edges twice and either way round."""
    n = 9
    every = [(a, b) for a in range(n) for b in range(a + 1, n)]
    rows = [(str(i), 2 * i) if numbers == "sparse" else (str(i), i) for i in range(n)] + ([("3", 3)] if numbers == "repeated" else [])
    nodes = spark.createDataFrame(rows, "id string, nid bigint")
    nodes = nodes.select("id") if numbers is None else nodes
    shapes = ([], every, every[:-1], every[1:], every[:8], every[::3]) if numbers is None else (every[::3],)
    for linked in shapes:
        both = [(str(a), str(b)) for a, b in linked] + [(str(b), str(a)) for a, b in linked[::2]] + [("0", "0"), ("0", "stranger")]
        found = open_pairs(nodes, spark.createDataFrame(both, "src string, dst string"))
        got = [(int(r.s), int(r.t), r.draw) for r in found.first(10**9, 5).collect()]
        want = set(every) - set(linked)
        assert found.missing == len(want) == len(got) and {(s, t) for s, t, _ in got} == want and sorted(d for *_, d in got) == list(range(len(want)))
        assert {(int(r.s), int(r.t), r.draw) for r in found.first(4, 5).collect()} == {x for x in got if x[2] < 4}


def test_pair_places(spark):
    n = 3_900_000_000
    last = n * (n - 1) // 2 - 1
    places = [0, 1, n - 2, n - 1, 10**18 + 7, last - 3, last - 1, last, *[last * i // 97 for i in range(97)]]
    a, b = pair_at(F.col("p"), n)
    rows = spark.createDataFrame([(p,) for p in places], "p bigint").select("p", a.alias("a"), b.alias("b")).withColumn("back", pair_place(F.col("a"), F.col("b"), n))
    for r in rows.collect():
        assert 0 <= r.a < r.b < n and r.p == r.back == last - (n - 2 - r.a) * (n - 1 - r.a) // 2 - (n - 1 - r.b)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 1000])
def test_permutation(spark, size):
    places = [r[0] for r in spark.range(size).select(shuffled_index(F.col("id"), size, "x")).collect()]
    assert sorted(places) == list(range(size)) and (size < 64 or places != sorted(places))


def test_selectors(spark):
    rows = [("a", "b", 0, 0.4), ("a", "c", 1, 0.6), ("a", "d", 2, 0.9), ("a", "e", 3, 0.45), ("a", "f", 4, 0.7)]
    df = spark.createDataFrame(rows, "s string, t string, pool_pos long, probability double")
    pick = lambda out: [r["t"] for r in out.collect()]
    assert pick(linkpred.select_threshold_first(df, 2, 0.5)) == ["c", "d"]
    assert pick(linkpred.select_threshold_first(df, 4, 0.5)) == ["c", "d", "f", "e"]
    assert pick(linkpred.select_threshold_first(df, 4, 0.5, fill_below=False)) == ["c", "d", "f"]
    assert pick(linkpred.select_threshold_first(df, 9, 0.5)) == ["c", "d", "f", "e", "b"]
    assert pick(linkpred.select_top_k(df, 2, 0.95)) == ["d", "f"]
    avoid = df.filter("t = 'c'")
    assert pick(linkpred.select_threshold_first(df, 1, 0.5, avoid)) == ["d"]


@pytest.mark.parametrize(
    ("family", "options"),
    [
        ("FastRP", {}),
        ("HashGNN", {"iterations": 2, "density": 4}),
        ("TGN", {"time_dim": 8}),
        ("Node2Vec", {"walk_length": 10, "walks_per_node": 4}),
        ("GraphSAGE", {"epochs": 10}),
    ],
)
def test_families_give_a_vector_per_node(spark, community, family, options):
    nodes, edges = community
    emb = embed(family, nodes, edges, 16, **options)
    rows = emb.collect()
    assert len(rows) == nodes.count() and {len(r["vec"]) for r in rows} == {16}
    again = {r["node"]: r["vec"] for r in embed(family, nodes, edges, 16, **options).collect()}
    assert all(np.allclose(r["vec"], again[r["node"]], atol=1e-6) for r in rows)
    v = {int(r["node"]): np.array(r["vec"]) for r in rows}
    if family in ("FastRP", "Node2Vec"):
        unit = {k: x / max(np.linalg.norm(x), 1e-9) for k, x in v.items()}
        inside = np.mean([unit[a] @ unit[b] for a in v for b in v if a < b and a // 20 == b // 20])
        across = np.mean([unit[a] @ unit[b] for a in v for b in v if a < b and a // 20 != b // 20])
        assert inside > across + 0.05


def test_whole_run_and_rounds(spark, community, tmp_path):
    nodes, edges = community
    split = execute_split(edges, nodes, "connected", 0.1, 0.1, 5)
    emb = embed("FastRP", nodes, split.part("train"), 16)
    run = plan.run_link_prediction(nodes, edges, split, emb, k=12)
    metrics = {r["set"]: r for r in run.metrics.collect()}
    assert metrics["train"]["auc"] > 0.6 and metrics["test"]["count_pos"] > 0
    chosen = {(r["s"], r["t"]) for r in run.chosen.collect()}
    assert len(chosen) == 12 and not chosen & known(edges)
    s = SnapshotStore(spark, str(tmp_path / "store"))
    name = plan.materialize_predicted(s, "base", "FastRP", run)
    assert name == "base-predicted-FastRP"
    rows = s.edges(name)
    assert rows.filter("predicted = 1").count() == 12
    assert rows.filter("predicted = 1").select("ts").distinct().first()["ts"] == predicted.max_timestamp(edges) + 1
    reports = plan.iterate(s, "base", "FastRP", rounds=2, k=7, dim=16)
    assert [r["round"] for r in reports] == [2, 3] and reports[1]["ts"] == reports[0]["ts"] + 1
    per_round = {r["predicted"]: r["n"] for r in s.edges(name).groupBy("predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_round[1] == 12 and per_round[2] == 7 and per_round[3] == 7
    assert s.edges(name).select("src", "dst").distinct().count() == s.edges(name).count()
    with pytest.raises(ValueError, match="no predicted snapshot"):
        plan.iterate(s, "other", "FastRP")


def test_recorded_run(spark, community, tmp_path):
    nodes, edges = community
    s = SnapshotStore(spark, str(tmp_path / "store"))
    first = plan.recorded_run(s, "base", nodes, edges, mode="random", k=8, dim=12, multiplier=5)
    again = plan.recorded_run(s, "base", nodes, edges, mode="random", k=8, dim=12, multiplier=5)
    name = "base-predicted-FastRP"
    pairs = lambda df: {(r["s"], r["t"]) for r in df.collect()}
    assert not pairs(first.chosen) & pairs(again.chosen) and pairs(s.read(name, "known")) == pairs(first.chosen) | pairs(again.chosen)
    assert len(s._versions("base-split", "edges")) == 1 and len(s._versions("base", "pool-42-pool-1")) == 1
    assert pairs(s.read(name, "test_pairs")) == pairs(plan.pairs_of(s.edges("base-split"), "test"))
    log = s.run_log().collect()
    assert len(log) == 2 and all(r["split_seconds"] > 0 and r["embedding_seconds"] > 0 and r["test_auc"] is not None for r in log)
    with pytest.raises(ValueError, match="other settings"):
        plan.recorded_run(s, "base", nodes, edges, mode="random", test=0.2)
    plan.iterate(s, "base", "FastRP", k=3)
    assert s.edges(name).filter("predicted = 2").count() == 3


def test_empty_test_set_gives_null_metrics(spark, community):
    nodes, edges = community
    split = execute_split(edges, nodes, "random", 0.0, 0.0)
    run = plan.run_link_prediction(nodes, edges, split, embed("FastRP", nodes, edges, 8), k=3)
    metrics = {r["set"]: r for r in run.metrics.collect()}
    assert metrics["test"]["auc"] is None and metrics["train"]["auc"] is not None


def test_snapshot_names_and_upserts(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    assert s.create() == "dataset-1" and s.create() == "dataset-2" and s.create(name=" Mine ") == "mine"
    for bad in ("mine", " "):
        with pytest.raises(ValueError):
            s.create(name=bad)
    s.use("mine")
    with pytest.raises(ValueError, match="in use"):
        s.drop("mine")
    with pytest.raises(ValueError, match="reserved"):
        s.drop("system")
    assert s.drop("dataset-2") and not s.drop("dataset-2") and s.create() == "dataset-2"
    s.write_nodes("mine", spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, n int, t string"))
    s.write_nodes("mine", spark.createDataFrame([("a", "y", 5.0), ("c", "z", 6.0)], "id string, t string, v double"))
    got = {r["id"]: (r["n"], r["t"], r["v"]) for r in s.nodes("mine").collect()}
    assert got == {"a": (1, "y", 5.0), "b": (2, "x", None), "c": (None, "z", 6.0)}


def test_run_log_and_split_memory(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    s.append_run_log({"base_db": "b", "test_auc": 0.12345678, "predict_k": 5})
    s.append_run_log({"base_db": "c"})
    rows = {r["base_db"]: r for r in s.run_log().collect()}
    assert len(rows["b"]) == len(RUN_LOG_COLUMNS) == 23
    assert rows["b"]["test_auc"] == 0.123457 and rows["c"]["test_auc"] is None
    assert s.reuse_split("b", True, 0.1, 0.1) == ("rebuild", None)
    s.create(name="sp")
    s.remember_split("b", True, 0.1, 0.1000000001, "sp")
    assert s.reuse_split("b", True, 0.1, 0.1) == ("reuse", "sp")
    assert s.reuse_split("b", False, 0.1, 0.1) == ("locked", "sp")
    s.drop("sp")
    assert s.reuse_split("b", True, 0.1, 0.1) == ("rebuild", None)


def test_feature_rules(spark):
    many = [(str(i), f"v{i}", "a b" if i % 2 else "a-b", None if i == 3 else "x", float(i), str(i), None, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(many, "id string, many string, clash string, hole string, num double, text_num string, empty string, flag boolean")
    kinds = features.classify_columns(df)
    assert kinds == {
        "many": "encode", "clash": "encode", "hole": "drop_nulls", "num": "numeric", "text_num": "numeric", "empty": "drop_empty", "flag": "drop_mixed",
    }
    out, report = features.one_hot(df)
    assert report["too_many"] == ["many"] and report["encoded"]["clash"] == ["numeric_clash_a_b", "numeric_clash_a_b_2"]
    assert out.columns == ["id", "num", "text_num", "numeric_clash_a_b", "numeric_clash_a_b_2"]
    row = out.filter("id = '1'").first()
    assert (row["numeric_clash_a_b"], row["numeric_clash_a_b_2"], row["text_num"]) == (1.0, 0.0, 1.0)
    assert features.purge_non_numeric(df).columns == ["id", "num", "text_num", "empty"]
    assert features.purge_non_numeric(df, keep_bool=True).columns == ["id", "num", "text_num", "empty", "flag"]
    assert features.drop_embedding_columns(["FastRP", "emb_x", "age", "tgn_1"]) == ["age"]
    stale = spark.createDataFrame([("1", "x", 0.5)], "id string, c string, numeric_c_old double")
    assert features.one_hot(stale)[0].columns == ["id", "numeric_c_x"]


def test_questions_and_graph_answers(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    e = "src string, dst string, type string, first_ts double"
    now = spark.createDataFrame([("a", "b", "R", 1.0)], e)
    later = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "c", "PREDICTED", 5.0), ("a", "c", "R", None)], e)
    text = "select struct(e.src as source, e.dst as target, e.type, e.first_ts) r, struct(n.id, n.n) x from {edges} e join {nodes} n on n.id = e.src"
    (pn, pe), (fn, fe) = query.query_both((nodes, now), (nodes, later), text, as_of=4.0, mode="graph")
    assert [r["id"] for r in pe.collect()] == ["R|a|b"] and {r["id"]: r["n"] for r in pn.collect()} == {"a": 1, "b": None}
    assert {r["id"] for r in fe.collect()} == {"R|a|b", "R|a|c"} and {r["id"] for r in fn.collect()} == {"a", "b", "c"}
    d = {(r["dst"], r["side"]): r["copies"] for r in query.diff(now.select("dst"), later.select("dst")).collect()}
    assert d == {("b", "both"): 1, ("c", "future"): 2}
    asked = query.query_future((nodes, later), "select count(*) n from {edges} where first_ts > :thr", threshold=2.0)
    assert asked.first()["n"] == 1
    assert query.ask((nodes, now), lambda n, x: n.join(x, n.id == x.src)).count() == 1


def test_comparisons(spark):
    p = spark.createDataFrame([("A", "1", "2"), ("A", "2", "3"), ("B", "2", "1")], "family string, s string, t string")
    truth = spark.createDataFrame([("3", "2"), ("7", "8")], "s string, t string")
    cells = {(r["row"], r["col"]): r["pct"] for r in compare.comparison_matrix(p, truth, ["A", "B", "C"]).collect()}
    assert cells["A", "B"] == 100.0 and cells["A", "C"] == 0.0 and cells["A", "Ground Truth"] == 50.0
    assert cells["Ground Truth", "Ground Truth"] == 100.0 and cells["C", "C"] == 0.0
    assert compare.overlap_pct(p.filter("family = 'A'"), p.filter("family = 'C'")).first()["overlap_pct"] == 0.0


def test_embedding_names_and_store(spark, tmp_path):
    names = spark.createDataFrame([(x,) for x in ("emb_N2V_1", "my sage", "hash-x-gnn", "tgn", "a b!", "!!")], "x string")
    assert [r["f"] for r in names.select(store.family_column(F.col("x")).alias("f")).collect()] == [
        "Node2Vec", "GraphSAGE", "HashGNN", "TGN", "a_b", "Embedding",
    ]
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "node string, vec array<double>")
    store.write_embeddings(str(tmp_path), df, "TGN")
    assert store.load_embeddings(spark, str(tmp_path), "TGN").count() == 1
    assert store.infer_dim(df) == 2 and store.infer_dim(df.limit(0)) == 128
    with pytest.raises(ValueError):
        store.load_embeddings(spark, str(tmp_path), "FastRP")


def test_all_open_pairs_without_a_sort(spark, monkeypatch):
    """If every open pair is wanted, the pairs are neither drawn nor sorted and stored; ids of all kinds stand in their order."""
    ids = ["7", "10", "9", "10a", "9a", "b", "1.0", "1e3", "-4", " 8", "99999999999999999999", "99999999999999999998"]
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    edges = spark.createDataFrame([("9", "10"), ("b", "7"), ("10a", "9a"), ("10a", "b")], "src string, dst string")
    found = open_pairs(nodes, edges)
    drawn = {(r.s, r.t, r.draw) for r in found.first(found.missing - 1, "z").collect()}
    calls = []
    monkeypatch.setattr(ordering, "cut", lambda df, label="t": calls.append(label) or df)
    every = found.first(found.missing, "z").collect()
    assert not calls and len(every) == found.missing == len(ids) * (len(ids) - 1) // 2 - 4
    assert {(r.s, r.t, r.draw) for r in every if r.draw < found.missing - 1} == drawn
    monkeypatch.setattr(nonedges, "GAP_PAIRS", 2)
    monkeypatch.setattr(nonedges, "SENT_NODES", 3)
    assert set(found.first(found.missing, "z").collect()) == set(every)


def test_fitted_model_goes_to_tasks(spark, community):
    """A fitted model has no summary of its training, which holds the session, and a plan with it runs and is written."""
    nodes, edges = community
    emb = embed("FastRP", nodes, edges, 8)
    rows = linkpred.training_set(edges.select(F.col("src").alias("s"), F.col("dst").alias("t")), emb, nodes, edges)
    model = linkpred.fit_logistic(rows)
    assert not model.hasSummary and model.numFeatures == 8
    scored = linkpred.score(rows.filter("label = 1"), model).select("s", "t", "probability").collect()
    w, b = model.coefficients.toArray(), model.intercept
    want = {(r.s, r.t): 1 / (1 + np.exp(-np.dot(w, r.features) - b)) for r in rows.filter("label = 1").collect()}
    assert {(r.s, r.t) for r in scored} == set(want) == known(edges)
    assert all(abs(r.probability - want[r.s, r.t]) < 1e-12 for r in scored)


def test_rounds_on_a_stored_snapshot(spark, community, tmp_path):
    """Both kinds of rounds fit, score and write their rows."""
    nodes, edges = community
    for mode in ("latest", "connected"):
        s = SnapshotStore(spark, str(tmp_path / mode))
        name = s.predicted_name("base", "FastRP")
        s.write(name, "nodes", nodes)
        s.write(name, "edges", predicted.observed_rows(edges), partition_by="predicted")
        plan.iterate(s, "base", "FastRP", 1, k=3, dim=4, mode=mode)
        added = s.edges(name).filter("predicted = 1").collect()
        assert len(added) == 3 and not {(r.src, r.dst) for r in added} & known(edges)


@pytest.mark.parametrize("pairs_of_cell", [50_000_000, 7])
def test_all_open_pairs_of_many_nodes_move_no_pair(spark, monkeypatch, pairs_of_cell):
    """With more nodes than go to all tasks, names go to cells in blocks: nothing is shuffled after pairs are written out."""
    nodes = spark.range(37).select(F.concat(F.lit("n"), "id").alias("id"))
    edges = spark.range(300).select(F.concat(F.lit("n"), F.col("id") * 5 % 37).alias("src"), F.concat(F.lit("n"), F.col("id") * 3 % 29).alias("dst"))
    found = open_pairs(nodes, edges)
    want = set(found.first(10**9, "z").collect())
    for name, value in (("SENT_NODES", 3), ("GAP_PAIRS", 10), ("CELL_PAIRS", pairs_of_cell)):
        monkeypatch.setattr(nonedges, name, value)
    every = found.first(10**9, "z")
    lines = every._jdf.queryExecution().optimizedPlan().toString().splitlines()
    opened = next(i for i, line in enumerate(lines) if "posexplode" in line)
    assert not any("Join" in line or "Repartition" in line or "sequence(low" in line for line in lines[:opened])
    rows = every.collect()
    assert set(rows) == want and len(rows) == found.missing == len(want)


def test_keys_of_draws_are_made_once(spark, community, monkeypatch):
    """A key takes many hashes; the order that is cut into ranges reads stored ones, also for its bounds."""
    nodes, edges = community
    want = set(linkpred.sample_negatives(nodes, edges, 50, seed=3).collect())
    plans, real = [], ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df, label="t": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    assert set(linkpred.sample_negatives(nodes, edges, 50, seed=3).collect()) == want
    assert plans and not any("md5" in p for p in plans)
