"""Adjacency dealt by node, searches on it, and spanning forests by contraction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import skew
from linkloom.operators import contraction, graph, splits
from linkloom.operators.embeddings.fastrp import fastrp
from linkloom.sources.adjacency import Adjacency, adjacency, attach, bucketed, table_name
from linkloom.sources.snapshots import SnapshotStore


def random_pairs(n, share, seed=0):
    rng = np.random.default_rng(seed)
    return [(f"{a:03}", f"{b:03}") for a in range(n) for b in range(a + 1, n) if rng.random() < share]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def adjacency_is_not_dealt(text):
    """From each bucketed scan upwards there are only row-wise steps and sorts before the next join."""
    lines = text.splitlines()
    scans = [i for i, line in enumerate(lines) if "Scan parquet" in line and "Bucketed: true" in line]
    for i in scans:
        while any(step in lines[i - 1] for step in (" Sort ", " Filter ", " ColumnarToRow", " Project ")):
            i -= 1
        if "Exchange" in lines[i - 1] and "Reused" not in lines[i - 1]:
            return False
    return len(scans) == 2


@pytest.mark.parametrize("hot", [10**6, 4])
def test_two_hops_without_an_exchange_of_the_adjacency(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    pairs = random_pairs(40, 0.1)
    adj = adjacency(spark.createDataFrame(pairs, "src string, dst string"))
    assert (adj.hot is not None) == (hot == 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        start = spark.createDataFrame([("003",), ("011",)], "src string")
        one = adj.reach(start).select(F.col("dst").alias("src"))
        two = adj.reach(one).select("src", "dst")
        assert adjacency_is_not_dealt(plan(two))
        got = sorted((r.src, r.dst) for r in two.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    assert got == sorted((m, x) for s in ("003", "011") for m in near.get(s, []) for x in near[m])


def test_attach_reads_the_files_of_another_session(spark, tmp_path):
    rows = spark.createDataFrame(random_pairs(20, 0.3), "src string, dst string")
    path = str(tmp_path / "adj")
    want = sorted(map(tuple, bucketed(rows, ["src"], path).collect()))
    spark.sql(f"drop table {table_name(path)}")  # an external table: its files stay
    again = attach(spark, path, "src string, dst string", ["src"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert sorted(map(tuple, again.collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = Adjacency(again).reach(rows.select("src").distinct())
        assert joined.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot", [10**6, 4])
def test_projection_of_a_snapshot(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    pairs = random_pairs(15, 0.3)
    store.write("g", "edges", spark.createDataFrame([(a, b, "REL" if a < "008" else "NEW") for a, b in pairs], "src string, dst string, type string"))
    made = store.project_adjacency("g", ["REL"])
    spark.sql(f"drop table {table_name(f'{tmp_path}/store/g/_adjacency/000001/steps')}")
    read = store.adjacency("g")
    kept = [(a, b) for a, b in pairs if a < "008"]
    assert sorted(map(tuple, read.pairs.collect())) == sorted([*kept, *[(b, a) for a, b in kept]])
    assert (read.hot is None) == (made.hot is None) == (hot > 4)
    ends = spark.createDataFrame([(x,) for x in {y for p in kept for y in p}], "src string")
    assert read.reach(ends).count() == 2 * len(kept)


def distances(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        seen, edge, d = {s: 0}, [s], 0
        while edge:
            d += 1
            edge = sorted({y for x in edge for y in near[x]} - seen.keys())
            seen.update((y, d) for y in edge)
        out[s] = seen
    return near, out


@pytest.mark.parametrize("hot", [10**6, 3])
def test_shortest_paths(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    pairs = [(f"{i:02}", f"{i + 1:02}") for i in range(7)] + [("02", "06"), ("06", "20"), ("20", "21"), ("30", "31")]
    near, far = distances(pairs)
    adj = adjacency(spark.createDataFrame(pairs, "src string, dst string"))
    for a, b, hops in [("00", "07", 10), ("00", "21", 10), ("21", "00", 10), ("00", "01", 1), ("00", "21", 4), ("00", "30", 10), ("05", "05", 3), ("00", "zz", 5)]:
        path = [r.node for r in graph.shortest_path(adj, a, b, hops).orderBy("step").collect()]
        length = 0 if a == b else far[a].get(b)
        if length is None or length > hops:
            assert path == []
        else:
            assert len(path) == length + 1 and path[0] == a and path[-1] == b and all(y in near[x] for x, y in zip(path, path[1:]))


def test_loops_give_the_same_on_edges_and_adjacency(spark):
    edges = spark.createDataFrame(random_pairs(30, 0.12, 2), "src string, dst string")
    adj = adjacency(edges)
    start = spark.createDataFrame([("001",)], "n string")
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(graph.bfs(edges, start).select("node", "parent", "depth")) == flat(graph.bfs(adj, start).select("node", "parent", "depth"))
    pairs = edges.select(F.col("src").alias("s"), F.col("dst").alias("t")).limit(20)
    assert flat(graph.common_neighbor_counts(edges, pairs)) == flat(graph.common_neighbor_counts(adj, pairs))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rounded = lambda e: flat(fastrp(nodes, e, 4).select("node", F.transform("vec", lambda x: F.round(x, 9)).alias("v")))
    assert rounded(edges) == rounded(adj)


def kruskal(rows):
    """Forest of ``(src, dst, e)`` in the order of ``e``."""
    top, out = {}, set()

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b, _ in sorted(rows, key=lambda r: r[2]):
        if find(a) != find(b):
            top[find(a)] = find(b)
            out.add((a, b))
    return out


SHAPES = {
    "path": [(f"{i:03}", f"{i + 1:03}") for i in range(150)],
    "star": [("000", f"{i:03}") for i in range(1, 60)],
    "parts": random_pairs(60, 0.03, 5),
    "dense": random_pairs(25, 0.9, 6),
    "loops": [("a", "a"), ("b", "c"), ("b", "c"), ("d", "d")],
}


@pytest.mark.parametrize("hot", [10**6, 5])
def test_drawn_forest_is_the_least(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    edges = spark.createDataFrame([(name + a, name + b) for name, pairs in SHAPES.items() for a, b in pairs], "src string, dst string")
    ranked, forest = splits.drawn_forest(edges, 3)
    rows = [tuple(r) for r in ranked.collect()]
    assert {(r.src, r.dst) for r in forest.collect()} == kruskal([r for r in rows if r[0] != r[1]])
    got = sorted(map(tuple, contraction.components_by_contraction(edges).collect()))
    assert got == sorted(map(tuple, graph.connected_components(edges).collect()))


def test_nothing_to_contract(spark):
    for pairs in ([], [("a", "a")]):
        edges = spark.createDataFrame(pairs, "src string, dst string")
        assert splits.drawn_forest(edges)[1].count() == 0
        assert contraction.components_by_contraction(edges).count() == len(pairs)


def test_rounds_on_a_long_path(spark, monkeypatch):
    """Each round leaves at most half of the nodes, on a path in random order of draws a third."""
    tables = []
    real = contraction.cut
    monkeypatch.setattr(contraction, "cut", lambda df, label: tables.append(label) or real(df, label))
    path = spark.range(1_999).select(F.format_string("%06d", "id").alias("src"), F.format_string("%06d", F.col("id") + 1).alias("dst"))
    ranked, forest = splits.drawn_forest(path, 1)
    assert forest.count() == 1_999
    assert tables.count("named") <= 8 and len(tables) <= 35


def test_split_by_drawn_forest_keeps_train_connected(spark):
    edges = spark.createDataFrame(random_pairs(40, 0.2, 9), "src string, dst string")
    for kind in ("drawn", "levels"):
        made = splits.connected_split(edges, 0.2, 0.1, 5, forest=kind).persist()
        train = made.filter("set = 'train'")
        assert graph.connected_components(train).select("component").distinct().count() == graph.connected_components(edges).select("component").distinct().count()
        n = edges.count()
        assert made.count() == n and made.filter("set = 'test'").count() == int(n * 0.2) and made.filter("set = 'val'").count() == int(n * 0.1)
