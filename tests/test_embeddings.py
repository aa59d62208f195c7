import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import skew
from linkloom.functions.pairs import mirror, undirected_pairs
from linkloom.operators import clean
from linkloom.operators.embeddings import graphsage as sage
from linkloom.operators.embeddings import node2vec as n2v
from linkloom.operators.embeddings import temporal
from linkloom.operators.embeddings.fastrp import fastrp
from linkloom.operators.embeddings.hashgnn import hashgnn
from linkloom.streaming import collapse, keyed, memory


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(4)
    rows = [(str(a), str(b), str(int(t))) for a, b, t in zip(rng.integers(0, 15, 90), rng.integers(0, 15, 90), rng.integers(0, 12, 90))]
    edges = clean.clean_edges(spark.createDataFrame(rows, "src string, dst string, ts string"), "ts").persist()
    return clean.assign_nid(clean.nodes_from_edges(edges)).persist(), edges


def neighbours(edges):
    out = {}
    for r in edges.select("src", "dst").distinct().collect():
        out.setdefault(r["src"], set()).add(r["dst"])
        out.setdefault(r["dst"], set()).add(r["src"])
    return out


@pytest.mark.parametrize(("p", "q"), [(1.0, 1.0), (4.0, 0.25)])
def test_walks_follow_edges(spark, graph, p, q):
    nodes, edges = graph
    lone = nodes.select("id", "nid").unionByName(spark.createDataFrame([("zz", 999)], "id string, nid long"))
    near = neighbours(edges)
    walks = n2v.random_walks(lone, edges, 5, 3, p, q).collect()
    assert len(walks) == 3 * lone.count() and len({r["walk"] for r in walks}) == len(walks)
    for r in walks:
        path = r["path"]
        assert path == ["zz"] or (len(path) == 5 and all(b in near[a] for a, b in zip(path, path[1:])))


def test_biased_steps_have_the_right_weights(spark):
    # from node 0 over 1: back to 0 has weight 1/p, 2 is shared with 0 (1), 3 is far (1/q)
    edges = spark.createDataFrame([("0", "1"), ("1", "2"), ("0", "2"), ("1", "3")], "src string, dst string")
    placed, spans = n2v.adjacency(edges)
    walks = spark.range(6000).select(F.col("id").alias("walk"), F.lit("0").alias("prev"), F.lit("1").alias("cur"), F.array(F.lit("1")).alias("path"))
    out = n2v._biased_step(walks, placed, spans, None, "s", 2, 4.0, 0.5).groupBy("next").count().collect()
    share = {r["next"]: r["count"] / 6000 for r in out}
    total = 0.25 + 1 + 2
    assert abs(share["0"] - 0.25 / total) < 0.03 and abs(share["2"] - 1 / total) < 0.03 and abs(share["3"] - 2 / total) < 0.03


def test_co_occurrences(spark):
    walks = spark.createDataFrame([(0, ["a", "b", "c", "d"])], "walk long, path array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in n2v.co_occurrences(walks, 2).collect()}
    want = {}
    path = "abcd"
    for i, a in enumerate(path):
        for j, b in enumerate(path):
            if i != j and abs(i - j) <= 2:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def sequential_memory(events, base, dim, time_dim, tau, seed):
    """The recurrence itself, event by event."""
    matrix = temporal.projection(dim, time_dim, seed)
    freq = np.array([1.0 / (10.0 ** (4.0 * j / max(time_dim - 1, 1))) for j in range(time_dim)])
    m, last = {}, {}
    for ts, src, dst in sorted(events, key=lambda e: (e[0], e[2])):
        gap = ts - last.get(src, ts)
        code = np.concatenate([base[dst], np.cos(gap * freq)])
        m[src] = np.exp(-gap / tau) * m.get(src, np.zeros(dim)) + matrix @ code
        last[src] = ts
    return m


@pytest.fixture(scope="module")
def want_memory(spark, graph):
    nodes, edges = graph
    events = [tuple(r) for r in temporal.temporal_events(edges).collect()]
    ids = sorted({e[2] for e in events})
    signs = spark.createDataFrame([(i,) for i in ids], "dst string").select("dst", temporal._signs(6, "42", F.col("dst")).alias("b"))
    base = {r["dst"]: np.array(r["b"]) for r in signs.collect()}
    m = sequential_memory(events, base, 6, 4, 5.0, 42)
    recent = {}
    for ts, src, dst in sorted(events, key=lambda e: (-e[0], e[2])):
        recent.setdefault(src, [])
        if len(recent[src]) < 3:
            recent[src].append(dst)
    return {n: (m[n] + np.mean([m[x] for x in recent[n]], axis=0)) / 2 for n in m}


def test_memory_equals_the_recurrence(spark, graph, want_memory, monkeypatch):
    nodes, edges = graph
    for hot in (10**6, 10):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        got = {r["node"]: np.array(r["vec"]) for r in temporal.temporal_memory(nodes, edges, 6, 4, 3, 5.0).collect()}
        assert all(np.allclose(got[n], want_memory[n], atol=1e-8) for n in want_memory)
    early = temporal.temporal_memory(nodes, edges, 6, 4, 3, 5.0, as_of=-1.0).collect()
    assert all(not np.any(r["vec"]) for r in early) and len(early) == nodes.count()


def stream_of(spark, edges, folder):
    rows = edges.select("src", "dst", F.explode("timestamps").alias("ts"))
    for number, (lo, hi) in enumerate([(0, 4), (4, 5), (5, 99)]):
        rows.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(f"{folder}/p={number}")
    return spark.readStream.schema("src string, dst string, ts double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/p=*")


def test_streamed_memory_equals_the_batch(spark, graph, want_memory, tmp_path):
    nodes, edges = graph
    events = stream_of(spark, edges, str(tmp_path / "in"))
    memory.stream_memory(events, str(tmp_path / "out"), str(tmp_path / "check"), 6, 4, 5.0, 3).awaitTermination()
    got = {r["node"]: np.array(r["vec"]) for r in memory.current_memory(spark, str(tmp_path / "out"), nodes, 6, 4).collect()}
    assert all(np.allclose(got[n], want_memory[n], atol=1e-8) for n in want_memory)


def test_streamed_memory_takes_late_and_repeated_events(spark, graph, want_memory, tmp_path):
    nodes, edges = graph
    rows = edges.select("src", "dst", F.explode("timestamps").alias("ts"))
    draw = F.pmod(F.xxhash64("src", "dst", "ts"), F.lit(3))
    folder = str(tmp_path / "in")
    for number in range(3):  # no order of time; every second event of a batch comes again, turned round, with the next
        again = rows.filter((draw == number - 1) & (F.xxhash64("dst", "ts") % 2 == 0)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ts")
        rows.filter(draw == number).unionByName(again).coalesce(1).write.parquet(f"{folder}/p={number}")
    events = spark.readStream.schema("src string, dst string, ts double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/p=*")
    memory.stream_memory(events, str(tmp_path / "out"), str(tmp_path / "check"), 6, 4, 5.0, 3).awaitTermination()
    got = {r["node"]: np.array(r["vec"]) for r in memory.current_memory(spark, str(tmp_path / "out"), nodes, 6, 4).collect()}
    assert all(np.allclose(got[n], want_memory[n], atol=1e-8) for n in want_memory)


def test_keyed_memory_equals_the_batch(spark, graph, want_memory, tmp_path):
    nodes, edges = graph
    # memories do not depend on where time begins; a stream's watermark begins at 0, behind which nothing may come
    rows = edges.select("src", "dst", F.explode("timestamps").alias("ts")).withColumn("ts", F.col("ts") + 30)
    folder, draw = str(tmp_path / "in"), F.pmod(F.xxhash64("src", "dst", "ts"), F.lit(3))
    part = F.floor((F.col("ts") - 30) / 3)  # later files hold late events and, turned round, repeated ones
    late = rows.withColumn("p", F.when(draw == 0, part + 1).otherwise(part))
    again = rows.filter(draw == 1).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ts").withColumn("p", part + 1)
    parts = late.unionByName(again).persist()
    last = int(parts.agg(F.max("p")).first()[0])
    for p in range(last + 1):
        parts.filter(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(None, None, 1000.0)], "src string, dst string, ts double").write.mode("append").parquet(folder)
    events = spark.readStream.schema("src string, dst string, ts double").option("maxFilesPerTrigger", 1).parquet(folder)
    query = keyed.stream_keyed_memory(events, str(tmp_path / "out"), str(tmp_path / "check"), "6 days", dim=6, time_dim=4, tau=5.0, k=3)
    query.awaitTermination()
    got = {r["node"]: np.array(r["vec"]) for r in memory.current_memory(spark, str(tmp_path / "out"), nodes, 6, 4).collect()}
    assert all(np.allclose(got[n], want_memory[n], atol=1e-8) for n in want_memory)
    assert query.lastProgress["stateOperators"][0]["numRowsDroppedByWatermark"] == 0
    written = [spark.read.parquet(f"{tmp_path}/out/state/batch={b['batchId']}").count() for b in query.recentProgress]
    assert len(written) > 3 and all(n <= nodes.count() for n in written)


def test_streamed_edges_equal_the_batch_and_compact(spark, graph, tmp_path):
    _, edges = graph
    keep = lambda df: sorted((r["src"], r["dst"], tuple(r["timestamps"])) for r in df.collect())
    path = str(tmp_path / "out")
    collapse.stream_edges(stream_of(spark, edges, str(tmp_path / "in")), path, str(tmp_path / "check")).awaitTermination()
    assert keep(collapse.current_edges(spark, path)) == keep(edges)
    collapse.compact(spark, path, str(tmp_path / "folded"))
    assert keep(collapse.current_edges(spark, str(tmp_path / "folded"))) == keep(edges)


@pytest.mark.parametrize("aggregator", ["mean", "max"])
def test_sage_gradient_is_the_derivative(aggregator):
    rng = np.random.default_rng(0)
    own, near, mask = rng.normal(size=(5, 4)), rng.normal(size=(5, 3, 4)), (rng.random((5, 3)) > 0.3).astype(float)
    near *= mask[:, :, None]
    mask[4] = 0.0
    w1, w2, g = rng.normal(size=(6, 4)), rng.normal(size=(6, 12)), rng.normal(size=(5, 6))
    loss = lambda a, b: float((sage._forward(own, near, mask, a, b, aggregator)[0] * g).sum())
    g1, g2 = sage._backward(g, own, near, mask, w1, w2, sage._forward(own, near, mask, w1, w2, aggregator)[1])
    for w, grad, pick in ((w1, g1, 0), (w2, g2, 1)):
        for i, j in [(0, 0), (2, 3), (5, 1)]:
            step = np.zeros_like(w)
            step[i, j] = 1e-6
            up, down = ((w1 + step, w2), (w1 - step, w2)) if pick == 0 else ((w1, w2 + step), (w1, w2 - step))
            assert abs((loss(*up) - loss(*down)) / 2e-6 - grad[i, j]) < 1e-4
    h1 = np.maximum(near @ w1.T, 0.0)
    plain = np.array([(np.max if aggregator == "max" else np.mean)(h[m > 0], axis=0) if m.any() else np.zeros(6) for h, m in zip(h1, mask)])
    assert np.allclose(sage._forward(own, near, mask, w1, w2, aggregator)[1][3][:, 6:], plain)


def test_sage_model_is_kept_and_embeds_new_nodes(spark, graph, tmp_path):
    nodes, edges = graph
    known = nodes.withColumn("f", F.pmod(F.xxhash64("id"), F.lit(7)).cast("double"))
    model, ctx = sage.fit_graphsage(known, edges, ["f"], 6, (4, 3), epochs=1, steps_per_epoch=1, aggregator="max")
    model.save(spark, str(tmp_path / "model"))
    again = sage.SageModel.load(spark.newSession(), str(tmp_path / "model"))
    vectors = lambda df: {r["node"]: r["vec"] for r in df.collect()}
    first = vectors(model.embed_contexts(ctx))
    assert vectors(again.embed(known, edges)) == first
    far = spark.createDataFrame([("new", "newer")], "src string, dst string")  # a part of the graph that training has not seen
    more = known.select("id", "f").unionByName(spark.createDataFrame([("new", 3.0), ("newer", 1.0)], "id string, f double"))
    got = vectors(again.embed(more, edges.select("src", "dst").unionByName(far)))
    assert {n: got[n] for n in first} == first and len(got) == len(first) + 2 and np.isclose(np.linalg.norm(got["new"]), 1)


def _step_by_pairs(pairs, contexts, w1, w2, size):
    """Gradients of a step with both contexts of a pair side by side."""
    total, loss = [np.zeros_like(w1), np.zeros_like(w2)], 0.0
    for s, t, y in pairs:
        sides = []
        for own, near in (contexts[s], contexts[t]):
            block, mask = np.zeros((1, size, len(own))), np.zeros((1, size))
            for j, x in enumerate(near[:size]):
                block[0, j], mask[0, j] = x, 1.0
            sides.append((np.array([own]), block, mask))
        (zs, save_s), (zt, save_t) = (sage._forward(*x, w1, w2) for x in sides)
        p = 1 / (1 + np.exp(-4.0 * (zs * zt).sum()))
        loss -= y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)
        for grad, side, save in ((4 * (p - y) * zt, sides[0], save_s), (4 * (p - y) * zs, sides[1], save_t)):
            for out, g in zip(total, sage._backward(grad, *side, w1, w2, save)):
                out += g
    return total, loss


def test_sage_steps_move_vectors_and_not_contexts(spark, graph, monkeypatch):
    """Gradients over cells are those over pairs with both contexts; no stored pair holds a context; ends without one are left out."""
    nodes, edges = graph
    known = nodes.withColumn("f", F.pmod(F.xxhash64("id"), F.lit(7)).cast("double"))
    stored, steps = [], []
    bucketed, gradients = sage.bucketed, sage._gradients
    monkeypatch.setattr(sage, "bucketed", lambda df, *a, **k: stored.append(set(df.columns)) or bucketed(df, *a, **k))
    monkeypatch.setattr(sage, "_gradients", lambda *a: steps.append((a, gradients(*a))) or steps[-1][1])
    monkeypatch.setattr(sage, "BLOCKS", 3)
    monkeypatch.setattr(sage, "PAIRS", 5)
    # weights change in place, so only the first step is looked at
    sage.fit_graphsage(known, edges, ["f"], 6, (4, 3), epochs=1, steps_per_epoch=1)
    assert stored == [{"node", "own", "near"}, {"part", "s", "t", "label", "cell"}]
    (pairs, ctx, blocks, w1, w2, size, _), _ = steps[0]
    contexts = {r["node"]: (r["own"], r["near"]) for r in ctx.collect()}
    rows = [(r["s"], r["t"], r["label"]) for r in pairs.collect()]
    assert blocks == 3 and pairs.select("cell").distinct().count() > 3
    g1, g2, loss, seen = gradients(pairs, ctx, blocks, w1, w2, size)
    (want1, want2), want_loss = _step_by_pairs(rows, contexts, w1, w2, size)
    assert seen == len(rows) and np.allclose(g1, want1) and np.allclose(g2, want2) and np.isclose(loss, want_loss)
    gone = sorted(contexts)[0]
    left = [r for r in rows if gone not in r[:2]]
    g1, _, loss, seen = gradients(pairs, ctx.filter(F.col("node") != gone), blocks, w1, w2, size)
    (want1, _), want_loss = _step_by_pairs(left, contexts, w1, w2, size)
    assert seen == len(left) < len(rows) and np.allclose(g1, want1) and np.isclose(loss, want_loss)
    assert sage.blocks_for(10**9) > 3 and sage._gradients(pairs.limit(0), ctx, blocks, w1, w2, size)[3] == 0


def test_neighbour_samples_are_bounded_and_real(spark, graph):
    _, edges = graph
    near = neighbours(edges)
    steps = mirror(undirected_pairs(edges))
    got = {}
    for r in sage.sampled_neighbors(steps, 3, "x").collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    assert all(v <= near[k] and len(v) == min(3, len(near[k])) for k, v in got.items()) and set(got) == set(near)


def test_hash_and_projection_survive_hot_keys(spark, graph, monkeypatch):
    nodes, edges = graph

    def answers():
        rp = {r["node"]: np.round(r["vec"], 9).tolist() for r in fastrp(nodes, edges, 8).collect()}
        hg = {r["node"]: r["vec"] for r in hashgnn(nodes, edges, 16, 2, 3).collect()}
        return rp, hg

    plain = answers()
    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    assert answers() == plain


def test_fastrp_matches_numpy(spark, graph):
    nodes, edges = graph
    ids = [r["id"] for r in nodes.orderBy("nid").collect()]
    from linkloom.operators.embeddings.fastrp import base_vectors

    base = {r["node"]: r["vec"] for r in base_vectors(nodes, 8, 42).collect()}
    n0 = np.array([base[i] for i in ids])
    near = neighbours(edges)
    walk = np.array([[1.0 / len(near[a]) if b in near[a] else 0.0 for b in ids] for a in ids])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = unit(walk @ n0) + unit(walk @ walk @ n0)
    got = {r["node"]: r["vec"] for r in fastrp(nodes, edges, 8).collect()}
    assert np.allclose(np.array([got[i] for i in ids]), want, atol=1e-9)


def test_padding_takes_no_step_per_row():
    """Lists of any length, also none and longer than the sample, from a slice of a batch; time for many rows."""
    import time

    import pyarrow as pa

    own = pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    near = pa.array([[[9.0, 9.0]], [], [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]], [[7.0, 8.0]]])
    first, block, mask = sage._padded(own.slice(1), near.slice(1), 2)
    assert first.tolist() == [[1, 2], [3, 4], [5, 6]] and mask.tolist() == [[0, 0], [1, 1], [1, 0]]
    assert block.tolist() == [[[0, 0], [0, 0]], [[1, 1], [2, 2]], [[7, 8], [0, 0]]]
    assert sage._padded(own.slice(1, 1), near.slice(1, 1), 2)[1].shape == (1, 2, 2)
    rows = 20_000
    values = pa.array(np.ones(rows * 25 * 6))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * 25 * 6 + 1, 6), pa.int32()), values)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * 25 + 1, 25), pa.int32()), inner)
    begun = time.process_time()
    assert sage._padded(inner.slice(0, rows), lists, 25)[1].sum() == rows * 25 * 6
    assert time.process_time() - begun < 1.0
