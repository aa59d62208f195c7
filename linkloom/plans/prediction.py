"""One whole prediction run and the rounds that extend its snapshot."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import first_rows
from ..functions.scratch import cut, path_exists
from ..operators import linkpred as lp
from ..operators import predicted as pr
from ..operators.clean import assign_nid
from ..operators.embeddings.families import embed
from ..operators.embeddings.store import infer_dim, load_embeddings, write_embeddings
from ..operators.splits import Split, execute_split, split_nodes, split_report
from ..sources.snapshots import FAMILIES, SnapshotStore


@dataclass
class PredictionRun:
    metrics: DataFrame
    recognized: DataFrame
    chosen: DataFrame
    nodes: DataFrame
    edges: DataFrame
    known: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def pairs_of(split: DataFrame, name: str) -> DataFrame:
    return split.filter(F.col("set") == name).select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()


def evaluate(sets: dict[str, DataFrame], model) -> DataFrame:
    """Metrics per set as rows, from one pass over all sets; an empty set has null metrics."""
    rows = None
    for name, part in sets.items():
        tagged = part.select(F.lit(name).alias("set"), "label", "features")
        rows = tagged if rows is None else rows.unionByName(tagged)
    names = rows.sparkSession.createDataFrame([(n,) for n in sets], "set string")
    metrics = lp.binary_metrics(lp.score(rows, model), by="set")
    return names.join(metrics, "set", "left").na.fill(0, ["count_pos", "count_neg"])


def run_link_prediction(
    nodes: DataFrame,
    edges: DataFrame,
    split: Split,
    emb: DataFrame,
    family: str = "FastRP",
    k: int = 100,
    threshold: float = 0.5,
    multiplier: int = 20,
    ratio: float = 1.0,
    evaluation_threshold: float = 0.5,
    seed: int | str = 42,
    known: DataFrame | None = None,
    pool: DataFrame | None = None,
) -> PredictionRun:
    """Fit on the train pairs, evaluate, choose ``k`` new pairs and build the predicted snapshot rows.

    ``nodes`` has ``id`` and ``nid``; ``known`` holds pairs predicted before (``family, s, t``);
    ``pool`` is a candidate pool that is there already.
    """
    seconds, t0 = {}, time.perf_counter()
    emb = cut(emb, "emb")
    pos = {s: cut(pairs_of(split.edges, s), "pos") for s in ("train", "val", "test")}
    sets = {}
    for name in pos:
        at = lp.snapshot_cutoff(pos[name], edges)
        sets[name] = cut(lp.training_set(pos[name], emb, nodes, edges, ratio, at, f"{seed}|{name}"), "set")
    model = lp.fit_logistic(sets["train"])
    metrics = cut(evaluate({"train": sets["train"], "validation": sets["val"], "test": sets["test"]}, model), "metrics")
    recognized = lp.recognized_test_pairs(lp.score(lp.hadamard(pos["test"], emb), model), evaluation_threshold)
    spark = nodes.sparkSession
    id_type = dict(nodes.dtypes)["id"]
    known = known if known is not None else spark.createDataFrame([], f"family string, s {id_type}, t {id_type}")
    avoid = lp.avoid_set(known.filter(F.col("family") == family), *pos.values())
    used = known.filter(F.col("family") == family)
    if pool is None:
        pool = lp.candidate_pool(nodes, edges, lp.pool_size(remaining_pairs(k, multiplier)), f"{seed}|pool")
    pool = cut(lp.unused(pool, used), "pool")
    scored = cut(lp.score(lp.hadamard(pool, emb), model), "scored")
    chosen = cut(lp.select_threshold_first(scored, k, threshold, avoid).select("s", "t", "probability"), "chosen")
    seconds["link_prediction_seconds"] = time.perf_counter() - t0
    new_nodes, rows = pr.snapshot_rows(edges, nodes, chosen)
    return PredictionRun(metrics, recognized, chosen, new_nodes, rows, pr.remember_predicted(known, chosen, family), seconds)


def remaining_pairs(k: int, multiplier: int) -> int:
    return max(k * multiplier, k + 50)


def stored_pool(store: SnapshotStore, base: str, nodes: DataFrame, edges: DataFrame, size: int, seed: int | str = "pool", version: int = 1) -> DataFrame:
    """Candidate pool kept by snapshot, seed and version; a stored one that is large enough is read, not drawn."""
    table = f"pool-{seed}-{version}".replace("|", "-")
    if not store.has(base, table) or store.read(base, table).agg(F.max("wanted").alias("n")).first()["n"] < size:
        store.write(base, table, lp.candidate_pool(nodes, edges, size, seed, version).withColumn("wanted", F.lit(size)))
    return first_rows(store.read(base, table).drop("wanted"), [F.col("pool_pos").asc()], size)


def recorded_run(
    store: SnapshotStore,
    base: str,
    nodes: DataFrame,
    edges: DataFrame,
    family: str = "FastRP",
    mode: str = "temporal",
    test: float = 0.1,
    val: float = 0.1,
    k: int = 100,
    threshold: float = 0.5,
    dim: int = 128,
    multiplier: int = 20,
    seed: int | str = 42,
    **options,
) -> PredictionRun:
    """A whole run whose split, vectors, pool, pairs, metrics and times stay in the store.

    The split of the same settings is used again; other settings for a snapshot that has a split
    are an error.  Tables of ``<base>-predicted-<family>``: ``nodes``, ``edges``, ``metrics``,
    ``test_pairs``, ``evaluation_pairs``, ``recognized``, ``chosen``, ``known``.
    """
    spark, temporal, t0 = store.spark, mode == "temporal", time.perf_counter()
    decision, split_name = store.reuse_split(base, temporal, test, val)
    if decision == "locked":
        raise ValueError(f"'{base}' has the split '{split_name}' with other settings")
    if decision == "rebuild":
        split_name = f"{base}-split"
        store.write(split_name, "edges", execute_split(edges, nodes, mode, test, val, seed).edges)
        store.remember_split(base, temporal, test, val, split_name)
    rows = store.edges(split_name)
    split = Split(rows, split_nodes(rows, nodes), split_report(rows, not temporal))
    t1 = time.perf_counter()
    folder = embedding_folder(store, base)
    write_embeddings(folder, embed(family, nodes, split.part("train"), dim, **options), family)
    emb = load_embeddings(spark, folder, family)
    t2 = time.perf_counter()
    name = store.predicted_name(base, family)
    known = store.read(name, "known") if store.has(name, "known") else None
    pool = stored_pool(store, base, nodes, edges, lp.pool_size(remaining_pairs(k, multiplier)), f"{seed}|pool")
    run = run_link_prediction(nodes, edges, split, emb, family, k, threshold, multiplier, seed=seed, known=known, pool=pool)
    materialize_predicted(store, base, family, run)
    held = {"test_pairs": pairs_of(rows, "test"), "evaluation_pairs": pairs_of(rows, "val")}
    for table, df in (held | {"metrics": run.metrics, "recognized": run.recognized, "chosen": run.chosen, "known": run.known}).items():
        store.write(name, table, df)
    run.seconds |= {"split_seconds": t1 - t0, "embedding_seconds": t2 - t1, "predicted_db_creation_seconds": time.perf_counter() - t2}
    tested = store.read(name, "metrics").filter("set = 'test'").first().asDict()
    now = datetime.now(UTC).isoformat(timespec="seconds")
    store.append_run_log(
        {"timestamp_utc": now, "base_db": base, "embedding_family": family, "predict_k": k, "prob_threshold": threshold,
         "predicted_db_name": name, "split_temporal_mode": mode, "split_test_holdout": test, "split_val_holdout": val,
         **run.seconds, **{f"test_{m}": tested[m] for m in ("auc", "ap", "accuracy", "precision", "recall", "f1")}}
    )
    return run


def embedding_folder(store: SnapshotStore, base: str) -> str:
    return f"{store.root}/{base}/_embeddings"


def materialize_predicted(store: SnapshotStore, base: str, family: str, run: PredictionRun) -> str:
    """Replace ``<base>-predicted-<family>`` by the rows of a run."""
    t0 = time.perf_counter()
    name = store.predicted_name(base, family)
    store.write(name, "nodes", run.nodes)
    t1 = time.perf_counter()
    store.write(name, "edges", run.edges, partition_by="predicted")
    run.seconds["predicted_graph_projection_seconds"] = time.perf_counter() - t1
    run.seconds["materialize_prediction_db_seconds"] = time.perf_counter() - t0
    return name


def iteration_split(edges: DataFrame, nodes: DataFrame) -> Split:
    """Test is the newest time of the snapshot, everything before is train."""
    return execute_split(edges, nodes, "temporal", 0.0, 0.0, test_times=[pr.max_timestamp(edges)], val_times=[])


def next_round(
    nodes: DataFrame,
    edges: DataFrame,
    family: str,
    k: int = 100,
    threshold: float = 0.5,
    multiplier: int = 20,
    ratio: float = 1.0,
    dim: int = 128,
    seed: int | str = 42,
    mode: str = "latest",
    **options,
) -> tuple[DataFrame, dict]:
    """Chosen ``(s, t, probability)`` of one round and its counts.

    ``mode='latest'`` holds out the newest time and takes the best ``k``; ``'connected'`` is the
    older round with a 10 % connected hold-out and the threshold-first choice.
    """
    if mode == "latest":
        split = iteration_split(edges, nodes)
    else:
        split = execute_split(edges, nodes, "connected", 0.1, 0.0, seed)
    emb = cut(embed(family, nodes, split.part("train"), dim, later_round=True, **options), "emb")
    # fixed rule: only nodes with a vector can be drawn, by their own dense numbers
    drawn = cut(assign_nid(nodes.select("id").join(emb.select(F.col("node").alias("id")), "id", "left_semi")), "drawn")
    train = cut(
        lp.training_set(pairs_of(split.edges, "train"), emb, drawn, edges, ratio, None, f"{seed}|train"), "train"
    )
    counts = train.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    if not counts["pos"] or not counts["neg"]:
        raise ValueError("a round needs train pairs with vectors and at least one sampled non-edge")
    model = lp.fit_logistic(train)
    want = max(1, int(k))
    pool = lp.sample_negatives(drawn, edges, max(want * max(2, int(multiplier)), want + 5), None, f"{seed}|pool")
    scored = cut(
        lp.score(lp.hadamard(pool.withColumnRenamed("draw", "pool_pos"), emb), model), "scored"
    )
    select = lp.select_top_k if mode == "latest" else lp.select_threshold_first
    report = lp.selection_report(scored, threshold).first().asDict()
    report |= {"train_pairs": counts["pos"], "neg_train_pairs": counts["neg"]}
    return cut(select(scored, want, threshold).select("s", "t", "probability"), "chosen"), report


def iterate(
    store: SnapshotStore, base: str, family: str, rounds: int = 1, k: int = 100, threshold: float = 0.5, **options
) -> list[dict]:
    """Extend the predicted snapshot round by round; every round starts from the stored table and rewrites the parts its new edges fall into."""
    if family not in FAMILIES:
        raise ValueError(f"unknown embedding family '{family}'")
    name = store.predicted_name(base, family)
    if not store.has(name, "edges"):
        raise ValueError(f"no predicted snapshot '{name}'; run the first prediction")
    if "dim" not in options and path_exists(store.spark, f"{embedding_folder(store, base)}/family={family}"):
        options["dim"] = infer_dim(load_embeddings(store.spark, embedding_folder(store, base), family))
    reports = []
    for _ in range(rounds):
        edges, nodes = store.edges(name), store.nodes(name)
        before = pr.round_counters(edges).first()
        chosen, report = next_round(nodes, edges, family, k, threshold, seed=f"{base}|{before['max_round']}", **options)
        store.append_edges(name, cut(pr.round_rows(edges, chosen), "round"))
        after = pr.round_counters(store.edges(name)).first()
        reports.append({"round": after["max_round"], "ts": after["max_ts"], **report})
    return reports
