"""Pairs without an edge, chosen by their rank.

Pairs of numbered nodes ``a < b`` stand in one long row, and a pair's place in it is known from its numbers alone.
With the places of the edges in order, the edge of rank r at place p has ``p - r`` open places before it; so the i-th
open pair stands at place ``i`` plus the number of edges whose ``p - r`` is at most ``i``, a running count in one order
of edges and draws.  Draws are the first numbers of a keyed permutation of ``0 .. open pairs - 1``, so none comes twice,
none has to be drawn again, and a larger sample begins with the smaller one.  The work is that of sorting edges and
draws, whether the graph is nearly empty or nearly complete.  If all open pairs are wanted, nothing is drawn or sorted:
the gaps between the edges are written out, and a pair's draw is its place under the inverse permutation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shuffled_index, unshuffled_index
from ..functions.ordering import global_index, running_sums
from ..functions.pairs import canonical, canonical_parsed, id_order, parsed_id
from ..functions.scratch import cut

# Fixed value: places of pairs fit in 63 bits up to so many nodes.
MOST_NODES = 4_000_000_000
# Pairs that one row of a gap stands for, pairs that one task writes out, and nodes that go to all tasks;
# beyond those, pairs of one cell, which takes the names of one block of ``GAP_PAIRS`` nodes.
GAP_PAIRS = 10_000
TASK_PAIRS = 5_000_000
SENT_NODES = 200_000
CELL_PAIRS = 50_000_000


def dense_numbers(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Stored ``(id, nid)`` with numbers ``0 .. n - 1``, and ``n``.

    Numbers that are there already and dense are kept; otherwise the distinct ids are numbered in their order.
    """
    if "nid" in nodes.columns:
        told = nodes.agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("nid").alias("numbers"),
            F.min("nid").alias("low"), F.max("nid").alias("high"),
        ).first()
        n = told["rows"]
        if n == told["ids"] == told["numbers"] and (n == 0 or (told["low"], told["high"]) == (0, n - 1)):
            return nodes.select("id", F.col("nid").cast("bigint").alias("nid")), n
    numbers = cut(global_index(nodes.select("id").na.drop().distinct(), id_order("id"), "nid"), "numbers")
    return numbers, numbers.count()


def _triangle(k: Column) -> Column:
    """``k (k + 1) / 2`` without a product beyond 63 bits."""
    return F.when(k % 2 == 0, (k / 2).cast("bigint") * (k + 1)).otherwise(((k + 1) / 2).cast("bigint") * k)


def pair_place(a: Column, b: Column, n: int) -> Column:
    """Place of the pair ``a < b`` among all pairs of ``0 .. n - 1``, ordered by ``a``, then ``b``."""
    last = F.lit(n * (n - 1) // 2 - 1)
    return last - _triangle(F.lit(n - 2) - a) - (F.lit(n - 1) - b)


def pair_at(place: Column, n: int) -> tuple[Column, Column]:
    """The inverse of :func:`pair_place`: the root in floating point is off by one at most, whole numbers mend it."""
    back = F.lit(n * (n - 1) // 2 - 1) - place
    rough = F.floor(F.sqrt(back.cast("double") * 2.0 + 0.25) - 0.5).cast("bigint")
    row = F.when(_triangle(rough) > back, rough - 1).when(_triangle(rough + 1) <= back, rough + 1).otherwise(rough)
    return F.lit(n - 2) - row, F.lit(n - 1) - (back - _triangle(row))


@dataclass
class OpenPairs:
    """``keys``: per edge the number of open places before it and its rank; ``missing``: number of open pairs."""

    numbers: DataFrame
    n: int
    keys: DataFrame
    missing: int

    def first(self, k: int, seed: int | str) -> DataFrame:
        """``(s, t, draw)``: the pairs of draws ``0 .. k - 1``, all open pairs if there are fewer."""
        wanted = max(0, min(int(k), self.missing))
        if wanted == self.missing:
            return self._every(seed)
        spark = self.keys.sparkSession
        draws = spark.range(wanted).select(
            F.col("id").alias("draw"), shuffled_index(F.col("id"), max(self.missing, 1), seed).alias("key")
        )
        # stored, as cutting an order into ranges reads its rows twice and a key takes many hashes
        draws = cut(draws, "draws")
        edge = self.keys.select("key", F.lit(1).alias("edge"), "rank", F.lit(None).cast("bigint").alias("draw"))
        drawn = draws.select("key", F.lit(0).alias("edge"), F.lit(-1).cast("bigint").alias("rank"), "draw")
        # a hub's edges may all have one key, so the rank is part of the order that is cut into ranges
        order = [F.col("key").asc(), F.col("edge").desc(), F.col("rank").asc()]
        counted = running_sums(edge.unionByName(drawn), order, {"before": "edge"}).filter("draw is not null")
        a, b = pair_at(F.col("key") + F.col("before"), max(self.n, 2))
        pairs = counted.select(a.alias("a"), b.alias("b"), "draw")
        by_a = self.numbers.select(F.col("nid").alias("a"), F.col("id").alias("s"))
        by_b = self.numbers.select(F.col("nid").alias("b"), F.col("id").alias("t"))
        return canonical(pairs.join(by_a, "a").join(by_b, "b").select("s", "t", "draw"), "s", "t")

    def _every(self, seed: int | str) -> DataFrame:
        """``(s, t, draw)`` for all open pairs, gap by gap; pairs go through no shuffle."""
        spark, n = self.keys.sparkSession, max(self.n, 2)
        long = lambda x: F.lit(x).cast("bigint")
        edges = self.n * (self.n - 1) // 2 - self.missing
        one = spark.range(1)
        # before the edge of rank r stand the open pairs from the key of the edge before it on, each after r edges
        starts = self.keys.select((F.col("rank") + 1).alias("before"), F.col("key").alias("start")).unionByName(one.select(long(0).alias("before"), long(0).alias("start")))
        stops = self.keys.select(F.col("rank").alias("before"), F.col("key").alias("stop")).unionByName(one.select(long(edges).alias("before"), long(self.missing).alias("stop")))
        gaps = starts.join(stops, "before").filter("start < stop")
        low, high = pair_at(F.col("start") + F.col("before"), n), pair_at(F.col("stop") - 1 + F.col("before"), n)
        gaps = gaps.select("before", low[0].alias("a1"), low[1].alias("b1"), high[0].alias("a2"), high[1].alias("b2"))
        rows = gaps.withColumn("a", F.explode(F.sequence("a1", "a2"))).select(
            "before", "a", F.when(F.col("a") == F.col("a1"), F.col("b1")).otherwise(F.col("a") + 1).alias("b1"),
            F.when(F.col("a") == F.col("a2"), F.col("b2")).otherwise(long(n - 1)).alias("b2"),
        ).filter("b1 <= b2")
        kind = dict(self.numbers.dtypes)["id"]
        known = self.numbers.select("nid", parsed_id(F.col("id"), kind).alias("end"))
        pairs = self._by_name(rows, F.broadcast(known)) if self.n <= SENT_NODES else self._by_block(rows, known)
        key = pair_place(F.col("a"), F.col("b"), n) - F.col("before")
        drawn = pairs.select("s", "t", unshuffled_index(key, max(self.missing, 1), seed).alias("draw"))
        return canonical_parsed(drawn, "s", "t", kind).select("s", "t", "draw")

    def _by_name(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """``(before, a, b, s, t)`` for the pairs of each ``a`` with ``b1 .. b2``; every task has all names."""
        cuts = rows.withColumn("low", F.explode(F.expr(f"sequence(b1, b2, {GAP_PAIRS}L)")))
        lumps = cuts.select("before", "a", "low", F.least(F.col("low") + GAP_PAIRS - 1, F.col("b2")).alias("high"))
        lumps = lumps.join(known.select(F.col("nid").alias("a"), F.col("end").alias("s")), "a")
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.missing // TASK_PAIRS + 1)
        pairs = lumps.repartition(tasks, "a", "low").withColumn("b", F.explode(F.sequence("low", "high")))
        return pairs.join(known.select(F.col("nid").alias("b"), F.col("end").alias("t")), "b")

    def _by_block(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """:meth:`_by_name` for more names than a task takes: those of ``GAP_PAIRS`` numbers in a row go to the cells of their pairs as one row."""
        name = F.transform(F.sort_array(F.collect_list(F.struct("nid", "end"))), lambda x: x["end"])
        blocks = known.groupBy(F.expr(f"nid div {GAP_PAIRS}").alias("block")).agg(name.alias("names"))
        slots = self.missing // CELL_PAIRS // (self.n // GAP_PAIRS + 1) + 1
        named = rows.join(known.select(F.col("nid").alias("a"), F.col("end").alias("s")), "a")
        cuts = named.withColumn("block", F.explode(F.expr(f"sequence(b1 div {GAP_PAIRS}, b2 div {GAP_PAIRS})")))
        start = F.col("block") * GAP_PAIRS
        lumps = cuts.select(
            "before", "a", "s", "block", F.pmod(F.xxhash64("a"), F.lit(slots)).alias("slot"),
            F.greatest(F.col("b1"), start).alias("low"), F.least(F.col("b2"), start + GAP_PAIRS - 1).alias("high"),
        )
        sent = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
        tasks, keys = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.missing // CELL_PAIRS + 1), ["block", "slot"]
        cells = lumps.repartition(tasks, *keys).join(sent.repartition(tasks, *keys), keys)
        ends = F.slice("names", (F.col("low") - start + 1).cast("int"), (F.col("high") - F.col("low") + 1).cast("int"))
        pairs = cells.select("before", "a", "s", "low", F.posexplode(ends).alias("at", "t"))
        return pairs.select("before", "a", (F.col("low") + F.col("at")).alias("b"), "s", "t")


def open_pairs(nodes: DataFrame, edges: DataFrame) -> OpenPairs:
    """Pairs of ``nodes`` that have no edge, whatever the direction, type or number of edges of the others.

    Edges with an end outside ``nodes`` and loops count for nothing.
    """
    numbers, n = dense_numbers(nodes)
    if n > MOST_NODES:
        raise OverflowError(f"places of pairs of {n} nodes are beyond 63 bits")
    of = lambda end, name: numbers.select(F.col("id").alias(end), F.col("nid").alias(name))
    # the same pair may come in several rows and either way round: one distinct step over numbers is enough
    ends = edges.select("src", "dst").join(of("src", "x"), "src").join(of("dst", "y"), "dst")
    place = pair_place(F.least("x", "y"), F.greatest("x", "y"), max(n, 2))
    places = ends.filter("x <> y").select(place.alias("place")).distinct()
    ranked = global_index(places, [F.col("place").asc()], "rank")
    keys = ranked.select((F.col("place") - F.col("rank")).alias("key"), "rank")
    return OpenPairs(numbers, n, keys, n * (n - 1) // 2 - ranked.count())
