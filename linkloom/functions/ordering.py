"""Global order without a one-partition window.

A place in the order is a partition number and a place in it of 33 bits, so a range partition may
hold 8.6 billion rows.

``Window.orderBy`` without a partition pulls all rows into one task.  Here rows are
range-partitioned and sorted, written once, and the driver sees only one row of
totals per partition (their number is the partition count, not the data).
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return cut(spread.withColumn("__place", place), "ranged").withColumns(
        {
            "__part": F.shiftright("__place", 33).cast("int"),
            "__pos": F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )


def _part_offsets(ranged: DataFrame, totals: dict[str, Column], start: float = 0) -> DataFrame:
    """Exclusive running totals per partition; one row per partition, so broadcast is safe."""
    names = list(totals)
    rows = ranged.groupBy("__part").agg(*[c.alias(n) for n, c in totals.items()]).orderBy("__part").collect()
    columns = [list(accumulate((r[n] or 0 for r in rows), initial=start))[:-1] for n in names]
    data = [(r["__part"], *vals) for r, vals in zip(rows, zip(*columns))] if rows else []
    types = dict(ranged.groupBy("__part").agg(*[c.alias(n) for n, c in totals.items()]).dtypes)
    schema = "__part int, " + ", ".join(f"__off_{n} {types[n]}" for n in names)
    return F.broadcast(ranged.sparkSession.createDataFrame(data, schema))


def global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Dense 0-based index in ``order``; the order must be total for a stable result."""
    ranged = _ranged(df, order)
    offsets = _part_offsets(ranged, {"n": F.count(F.lit(1))})
    return ranged.join(offsets, "__part").select(
        *df.columns, (F.col("__pos") + F.col("__off_n")).cast("bigint").alias(name)
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``{new_column: column}`` over the whole frame in ``order``."""
    ranged = _ranged(df, order)
    offsets = _part_offsets(ranged, {new: F.sum(old) for new, old in sums.items()})
    # a window group is one range partition, so it is bounded like any partition
    inside = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(old).over(inside).alias(f"__in_{new}") for new, old in sums.items()])
    return out.join(offsets, "__part").select(
        *df.columns, *[(F.col(f"__in_{new}") + F.col(f"__off_{new}")).alias(new) for new in sums]
    )


def previous_row(df: DataFrame, group: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """``lag`` per group without a window over the group: ``{new_column: column}``.

    Rows are dealt once in (group, order); the previous row is looked for inside the range partition, and that of its first
    row is the last one of the partition before, so a group holding a third of all rows is spread like the others.
    """
    ranged = _ranged(df, [F.col(g).asc() for g in group] + list(order))
    before = list(dict.fromkeys([*group, *columns.values()]))
    ends = ranged.groupBy("__part").agg(F.max("__pos").alias("last")).orderBy("__part").collect()
    follows = [(a["__part"], a["last"], b["__part"]) for a, b in zip(ends, ends[1:])]
    places = df.sparkSession.createDataFrame(follows, "__part int, __pos bigint, __next int")
    # one row per partition, as in _part_offsets
    last = ranged.join(F.broadcast(places), ["__part", "__pos"]).select(F.col("__next").alias("__part"), *[F.col(c).alias(f"__l_{c}") for c in before])
    inside = Window.partitionBy("__part").orderBy("__pos")
    lagged = ranged.select("*", *[F.lag(c).over(inside).alias(f"__b_{c}") for c in before]).join(F.broadcast(last), "__part", "left")
    first = F.col("__pos") == 0
    value = {c: F.when(first, F.col(f"__l_{c}")).otherwise(F.col(f"__b_{c}")) for c in before}
    keep = ~first | F.col("__part").isin([f[2] for f in follows])
    for g in group:
        keep = keep & F.col(g).eqNullSafe(value[g])
    return lagged.select(*df.columns, *[F.when(keep, value[old]).alias(new) for new, old in columns.items()])


def first_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in a total order, in one way for every ``k``.

    Rows are dealt by hash over as many salts as there are shuffle partitions; only the first
    ``k`` of a salt can be among the first ``k`` of all (the limit also runs before the shuffle).
    What is left is ranked over range partitions, so no task sees more than its share.
    """
    if k <= 0:
        return df.limit(0)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    near = salted.withColumn("__near", F.row_number().over(Window.partitionBy("__salt").orderBy(*order))).filter(F.col("__near") <= k)
    ranked = global_index(near.select(*df.columns), order, "__rank")
    return ranked.filter(F.col("__rank") < k).drop("__rank")
