"""Comparing prediction sets across families and against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_index
from ..functions.pairs import pair_key

GROUND_TRUTH = "Ground Truth"


def _percent(common: Column, base: Column) -> Column:
    return F.when(base > 0, common / base * 100.0).otherwise(F.lit(0.0))


def pair_sets(pairs: DataFrame) -> DataFrame:
    """Distinct ``(family, key)`` with the unordered text key."""
    return pairs.select("family", pair_key(F.col("s"), F.col("t")).alias("key")).distinct()


def _sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two pair sets and of their intersection, by one grouping on the key."""
    keyed = a.select(pair_key(F.col("s"), F.col("t")).alias("key"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(pair_key(F.col("s"), F.col("t")).alias("key"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    flags = keyed.groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return flags.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("size_a"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("size_b"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("common"),
    )


def overlap_pct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common pairs as a percentage of the smaller set; 0 if one is empty."""
    return _sizes(a, b).withColumn("overlap_pct", _percent(F.col("common"), F.least("size_a", "size_b")))


def gt_coverage_pct(a: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the ground truth that is found."""
    return _sizes(a, truth).withColumn("coverage_pct", _percent(F.col("common"), F.col("size_b")))


def comparison_matrix(pairs: DataFrame, truth: DataFrame, families: list[str]) -> DataFrame:
    """Matrix over families and ground truth as ``(row, col, pct)`` rows.

    Pairs are grouped by key into one mark per family that holds them, so the counts per family
    pair need no join of the pair sets, and repeated pairs need no step of their own.
    """
    names = [*families, GROUND_TRUTH]
    keyed = lambda rows: rows.select("family", pair_key(F.col("s"), F.col("t")).alias("key"))
    tagged = keyed(pairs.filter(F.col("family").isin(families))).unionByName(keyed(truth.select(F.lit(GROUND_TRUTH).alias("family"), "s", "t")))
    flags = tagged.groupBy("key").agg(*[F.max(F.when(F.col("family") == n, 1).otherwise(0)).alias(f"f{i}") for i, n in enumerate(names)])
    counts = flags.agg(
        *[
            F.coalesce(F.sum(F.col(f"f{i}") * F.col(f"f{j}")), F.lit(0)).alias(f"c{i}_{j}")
            for i in range(len(names))
            for j in range(len(names))
        ]
    )
    last = len(names) - 1

    def cell(i: int, j: int) -> Column:
        common = F.col(f"c{i}_{j}")
        if last in (i, j):
            base = F.col(f"c{last}_{last}")
        else:
            base = F.least(F.col(f"c{i}_{i}"), F.col(f"c{j}_{j}"))
        return F.struct(F.lit(names[i]).alias("row"), F.lit(names[j]).alias("col"), _percent(common, base).alias("pct"))

    cells = F.array(*[cell(i, j) for i in range(len(names)) for j in range(len(names))])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def probability_summary(series: DataFrame) -> DataFrame:
    """Per family: count, time range, mean and largest probability."""
    return series.groupBy("family").agg(
        F.count(F.lit(1)).alias("predicted_edges"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        F.avg("probability").alias("mean_probability"),
        F.max("probability").alias("max_probability"),
    )


def probability_distribution(series: DataFrame) -> DataFrame:
    """Per family and time: range, exact quartiles and a ten-bin histogram of the probability.

    Rows are indexed once in (family, time, probability) order; a quartile is read at its
    place by an equi-join on the unique index, so no group is gathered in one task.
    """
    keys = ["family", "timestamp"]
    # the pair breaks ties, so equal probabilities do not gather in one range
    rows = series.select(*keys, "probability", F.xxhash64("s", "t").alias("tie"))
    order = [F.col("family"), F.col("timestamp"), F.col("probability"), F.col("tie")]
    placed = global_index(rows, order, "place")
    p = F.col("probability")
    bins = F.least(F.floor(p * 10), F.lit(9))
    groups = placed.groupBy(*keys).agg(
        F.min("place").alias("start"),
        F.count(F.lit(1)).alias("edges"),
        F.min(p).alias("p_min"),
        F.max(p).alias("p_max"),
        *[F.count_if(bins == b).alias(f"bin{b}") for b in range(10)],
    )
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    spots = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(q) * (F.col("edges") - 1)).alias("at")) for n, q in names.items()])
    wanted = groups.select(*keys, "start", F.explode(spots).alias("w")).select(
        *keys, "w.name", (F.col("w.at") - F.floor("w.at")).alias("part"),
        F.explode(F.array(F.struct(F.lit(0).alias("up"), (F.col("start") + F.floor("w.at")).alias("place")),
                          F.struct(F.lit(1).alias("up"), (F.col("start") + F.ceil("w.at")).alias("place")))).alias("e"),
    )
    read = wanted.select(*keys, "name", "part", "e.up", "e.place").join(placed.select("place", "probability"), "place")
    share = F.when(F.col("up") == 1, F.col("part")).otherwise(1 - F.col("part"))
    quartiles = read.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == n, share * p)).alias(n) for n in names])
    return groups.drop("start").join(quartiles, keys)


def common_round_range(series: DataFrame) -> DataFrame:
    """Rounds that all families have: ``(lo, hi)`` or no row if the ranges are disjoint."""
    rounds = series.filter(F.col("predicted_timestep") > 0)
    ranges = rounds.groupBy("family").agg(F.min("predicted_timestep").alias("a"), F.max("predicted_timestep").alias("b"))
    return ranges.agg(F.max("a").alias("lo"), F.min("b").alias("hi")).filter("lo is not null and lo <= hi")


def filter_rounds(series: DataFrame, lo: int, hi: int) -> DataFrame:
    return series.filter(F.coalesce("predicted_timestep", F.lit(0)).between(lo, hi))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Per family the test metrics, else validation, else train (``set`` names the source)."""
    rank = F.when(F.col("set") == "test", 0).when(F.col("set") == "validation", 1).otherwise(2)
    best = F.min_by(F.struct(*metrics.columns), rank).alias("m")
    return metrics.groupBy(F.col("family").alias("__f")).agg(best).select("m.*")
