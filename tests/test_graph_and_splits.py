import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import skew
from linkloom.functions.pairs import canonical
from linkloom.operators import graph, splits

EDGE = "src string, dst string, type string, timestamps array<double>, first_ts double, last_ts double, ts double, interaction_count long"
some_edges = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda p: p[0] != p[1]), min_size=1, max_size=25)


def frame(spark, pairs):
    return spark.createDataFrame(sorted({(f"{min(p):02d}", f"{max(p):02d}") for p in pairs}), "src string, dst string")


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(parent)}


relaxed = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@relaxed
@given(some_edges)
def test_components_and_forest(spark, data):
    df = frame(spark, data)
    pairs = {(r["src"], r["dst"]) for r in df.collect()}
    want = union_find(sorted(pairs))
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == want
    forest = {(r["src"], r["dst"]) for r in splits.spanning_forest(df).collect()}
    assert forest <= pairs and len(forest) == len(want) - len(set(want.values()))
    assert union_find(sorted(forest)) == {n: c for n, c in want.items()}


def test_long_path_settles(spark):
    df = frame(spark, [(i, i + 1) for i in range(60)])
    assert graph.connected_components(df).select("component").distinct().count() == 1
    assert graph.bfs(df, spark.createDataFrame([("00",)], "n string"), 100).agg(F.max("depth")).first()[0] == 60


@pytest.mark.parametrize("split", [splits.random_split, splits.connected_split])
def test_splits_are_disjoint_and_cover(spark, split):
    df = frame(spark, [(a, b) for a in range(12) for b in range(a + 1, 12)])
    out = split(df, 0.25, 0.1, 3).collect()
    assert len(out) == len({(r["src"], r["dst"]) for r in out}) == 66
    sizes = {s: sum(r["set"] == s for r in out) for s in splits.SETS}
    assert sizes == {"test": 16, "val": 6, "train": 44}
    if split is splits.connected_split:
        train = [(r["src"], r["dst"]) for r in out if r["set"] == "train"]
        assert len(set(union_find(train).values())) == 1 and len(union_find(train)) == 12


def test_connected_split_shrinks_where_only_the_forest_is_left(spark):
    df = frame(spark, [(i, i + 1) for i in range(9)])
    assert {r["set"] for r in splits.connected_split(df, 0.5, 0.2, 1).collect()} == {"train"}


def edge(spark, *rows):
    data = [(a, b, t, ts, ts[0], ts[-1], ts[-1], len(ts)) for a, b, t, ts in rows]
    return spark.createDataFrame(data, EDGE)


def test_time_slices_of_one_pair(spark):
    df = edge(spark, ("a", "b", "X", [1.0, 2.0, 3.0, 4.0, 5.0]))
    out = {r["set"]: r["timestamps"] for r in splits.temporal_split(df, 0.2, 0.2).collect()}
    assert out == {"train": [1.0, 2.0, 3.0], "val": [4.0], "test": [5.0]}
    out = {r["set"]: r["timestamps"] for r in splits.temporal_split(df, test_times=[2.0, 5.0, 7.0], val_times=[5.0, 1.0]).collect()}
    assert out == {"train": [3.0, 4.0], "val": [1.0], "test": [2.0, 5.0]}
    out = {r["set"]: r["timestamps"] for r in splits.temporal_split(df, test_times=[5.0], val=0.4).collect()}
    assert out == {"train": [1.0, 2.0], "val": [3.0, 4.0], "test": [5.0]}
    assert [r["set"] for r in splits.temporal_split(df, 0.2, 0.2, new_pairs_only=True).collect()] == ["train"]
    assert [r["set"] for r in splits.temporal_split(df, 0.0, 0.0).collect()] == ["train"]


def test_types_of_a_pair_are_joined_and_sizes_round_up(spark):
    df = edge(spark, ("a", "b", "X", [1.0, 3.0]), ("a", "b", "Y", [2.0, 3.0]), ("a", "c", "X", [4.0]))
    out = {(r["dst"], r["set"]): r["timestamps"] for r in splits.temporal_split(df, 0.3, 0.1).collect()}
    # four times: ceil(1.2) = 2 test, ceil(0.4) = 1 validation
    assert out == {("b", "train"): [1.0], ("b", "val"): [2.0], ("b", "test"): [3.0], ("c", "test"): [4.0]}


def test_stitched_edges_meet_in_the_largest_component(spark, edges):
    assert [tuple(r) for r in splits.stitch_components(edges).collect()] == [("1", "8", True)]


def test_hot_keys_give_the_same_rows(spark, monkeypatch):
    star = [(0, i) for i in range(1, 41)] + [(i, i + 1) for i in range(1, 30)]
    df = frame(spark, star)
    pairs = df.select(F.col("src").alias("s"), F.col("dst").alias("t"))

    def answers():
        return (
            sorted(map(tuple, graph.connected_components(df).collect())),
            sorted(map(tuple, graph.bfs(df, spark.createDataFrame([("05",)], "n string")).collect())),
            sorted(map(tuple, graph.common_neighbor_counts(df, pairs).collect())),
        )

    plain = answers()
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "SALTS", 3)
    assert [r[0] for r in skew.find_hot(df, "src").collect()] == ["00"]
    assert answers() == plain


def test_bfs_runs_to_the_end_unless_told(spark):
    chain = spark.range(80).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0,)], "n long")
    assert graph.bfs(chain, start).count() == 81
    assert graph.bfs(chain, start, 5).count() == 6


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_partitioning_does_not_change_results(spark, edges, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, splits.random_split(edges, 0.4, 0.2, 5).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert sorted(map(tuple, splits.random_split(edges, 0.4, 0.2, 5).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _ids(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("ids", [["7", "10", "9", "100", "70", "1"], ["07", "7", "a", "10", "b1", ""], ["1" * 18, "2", "10" * 9, "0", "00", "9"]])
@pytest.mark.parametrize("turned", [False, True])
def test_forest_of_texts_in_text_order(spark, monkeypatch, ids, turned):
    """Levels from the smallest text, whatever the way of numbering; texts of digits need no table of numbers."""
    chain = list(zip(ids, ids[1:])) + [(ids[0], ids[3]), ("zz" if "a" in ids else "55", "56")]
    df = canonical(_ids(spark, chain))
    df = df.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else df
    pairs = {(r["src"], r["dst"]) for r in df.collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, seen = set(), set()
    for root in sorted(near):
        if root in seen:
            continue
        level, _ = {root}, seen.add(root)
        while level:
            found = {n: min(level & near[n]) for m in level for n in near[m] - seen}
            want |= {(n, p) if (n, p) in pairs else (p, n) for n, p in found.items()}
            seen |= set(found)
            level = set(found)
    if all(x.isdigit() for p in pairs for x in p):
        monkeypatch.setattr(splits, "numbered", lambda *_: pytest.fail("a table of numbers was made"))
    assert {(r["src"], r["dst"]) for r in splits.spanning_forest(df).collect()} == want


def test_smallest_nodes_are_carried_up(spark):
    from linkloom.operators import contraction

    pairs = [(i, i + 1) for i in range(40)] + [(90, 95), (95, 91), (7, 7), (60, 60)]
    edges = contraction.numbered_pairs(spark.createDataFrame(pairs, "src long, dst long"))
    steps = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    for found in (contraction.contract(edges), contraction.contract(edges, steps)):
        assert sorted(r["least"] for r in found.smallest().collect()) == [0, 90]
    assert contraction.contract(edges.filter("a = b")).smallest() is None


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_previous_row_crosses_partitions(spark, partitions):
    from linkloom.functions.ordering import previous_row

    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(None if i % 3 == 2 else i % 3, i * 7 % 50, f"v{i}" if i % 5 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, o int, v string").repartition(4)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for group in ([], ["g"]):
            got = {(r["g"], r["o"]): r["b"] for r in previous_row(df, group, [F.col("o").asc()], {"b": "v"}).collect()}
            want = {}
            for g in {r[0] for r in rows} if group else {"all"}:
                inside = sorted((r for r in rows if not group or r[0] == g), key=lambda r: r[1])
                want |= {(r[0], r[1]): p[2] if p else None for p, r in zip([None, *inside], inside)}
            assert got == want
        assert previous_row(df.limit(0), ["g"], [F.col("o").asc()], {"b": "v"}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
