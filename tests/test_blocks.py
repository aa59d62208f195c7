"""Ways of two hops and shared neighbours by blocks of nodes, against ways that are opened one by one."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkloom.functions import skew
from linkloom.operators import blocks, graph
from linkloom.sources.adjacency import adjacency

RNG = np.random.default_rng(3)
PAIRS = sorted({(f"{min(p):03}", f"{max(p):03}") for p in RNG.integers(0, 60, (260, 2)).tolist() if p[0] != p[1]} | {("000", f"{i:03}") for i in range(1, 45)})
NEAR: dict = {}
for _a, _b in PAIRS:
    NEAR.setdefault(_a, set()).add(_b)
    NEAR.setdefault(_b, set()).add(_a)


def ways(near):
    return sorted((n, sum(len(near[x]) for x in near[n]), len(set().union(*(near[x] for x in near[n])))) for n in near)


@pytest.mark.parametrize("hot", [10**6, 4])
def test_two_hop_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "SALTS", 3)
    monkeypatch.setattr(blocks, "CELL_EDGES", 70)
    edges = spark.createDataFrame(PAIRS, "src string, dst string")
    assert blocks.blocks_for(2 * len(PAIRS)) > blocks.BLOCKS
    for given in (edges, adjacency(edges)):
        assert sorted(map(tuple, blocks.two_hop_counts(given).collect())) == ways(NEAR)


def test_a_cell_in_small_steps(monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 5)
    lists = [(sorted(RNG.choice(9, 4, False).tolist()), sorted(RNG.choice(20, 3, False).tolist())) for _ in range(6)]
    out = blocks._two_hops(pa.table({"ends": [a for a, _ in lists], "far": [b for _, b in lists]}), 2, 10).to_pylist()
    want = {}
    for ends, far in lists:
        for e in ends:
            want.setdefault(e * 10 + 2, []).extend(far)
    assert {r["n"]: (r["walks"], r["reached"]) for r in out} == {n: (len(x), len(set(x))) for n, x in want.items()}


@pytest.mark.parametrize("hot", [10**6, 4])
def test_shared_counts_of_given_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "SALTS", 3)
    nodes = [*sorted(NEAR), "strange"]
    pairs = [(nodes[i], nodes[j]) for i, j in RNG.integers(0, len(nodes), (400, 2)).tolist()]
    want = sorted((s, t, len(NEAR[s] & NEAR[t])) for s, t in set(pairs) if "strange" not in (s, t) and NEAR[s] & NEAR[t])
    edges = spark.createDataFrame(PAIRS, "src string, dst string")
    # a pair that is given several times is one pair: its number is not multiplied
    assert max(Counter(pairs).values()) > 1
    for given in (edges, adjacency(edges)):
        assert sorted(map(tuple, graph.common_neighbor_counts(given, spark.createDataFrame(pairs, "s string, t string")).collect())) == want


def test_lists_are_marked_in_small_steps(monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 4)
    near = {n: sorted(RNG.choice(15, 1 + n, False).tolist()) for n in range(8)}
    pairs = [(a, b) for a in range(9) for b in range(9) if a != b]
    rows = [(n, part) for n, x in near.items() for part in (x[::2], x[1::2]) if part]
    table = pa.table({"s": [f"s{a}" for a, _ in pairs], "t": [f"t{b}" for _, b in pairs], "a": [a for a, _ in pairs], "b": [b for _, b in pairs]})
    out = blocks._shared(table, pa.table({"n": [n for n, _ in rows], "part": [x for _, x in rows]})).to_pylist()
    want = {(f"s{a}", f"t{b}"): len(set(near[a]) & set(near[b])) for a, b in pairs if a in near and b in near and set(near[a]) & set(near[b])}
    assert {(r["s"], r["t"]): r["common"] for r in out} == want


def test_no_pairs_and_no_edges(spark):
    edges = spark.createDataFrame(PAIRS, "src string, dst string")
    none = spark.createDataFrame([], "s string, t string")
    assert blocks.shared_counts(edges, none).count() == 0
    assert blocks.shared_counts(edges.limit(0), edges.selectExpr("src s", "dst t")).count() == 0
    assert blocks.two_hop_counts(edges.limit(0)).count() == 0


def test_the_forest_of_a_connected_split_tells_its_components(spark, monkeypatch):
    from linkloom.operators import splits

    both = [*PAIRS, *((f"x{a}", f"x{b}") for a, b in PAIRS[:40]), ("y1", "y2")]
    df = spark.createDataFrame([(a, b, "REL", [1.0], 1.0, 1.0) for a, b in both], "src string, dst string, type string, timestamps array<double>, first_ts double, last_ts double")
    nodes = df.selectExpr("explode(array(src, dst)) as id").distinct()
    made = splits.execute_split(df, nodes, "connected", 0.2, 0.1, 5)
    slow = splits.split_report(made.edges)
    assert sorted(map(str, made.report.collect())) == sorted(map(str, slow.collect()))

    def never(_):
        raise AssertionError("contracted twice")

    # the report is read from the forest, the train pairs are not contracted again
    monkeypatch.setattr(splits, "components_by_contraction", never)
    splits.execute_split(df, nodes, "connected", 0.2, 0.1, 5)
