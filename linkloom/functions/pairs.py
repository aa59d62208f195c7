"""Rules for node ids and unordered pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as a number in text (no type suffixes, no NaN words).
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_number(col: Column) -> Column:
    """The value as double where its text is a number, else null."""
    text = col.cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))


# Fixed value: whole numbers, which compare without rounding.
WHOLE_TEXT = r"^\s*[+-]?[0-9]+\s*$"

# Column types that compare as numbers without looking at text.
WHOLE_TYPES = {"tinyint", "smallint", "int", "bigint"}
FRACTION_TYPES = {"float", "double"}


def as_whole(col: Column) -> Column:
    """The value as a decimal of up to 38 digits where its text is a whole number, else null."""
    text = col.cast("string")
    return F.when(text.rlike(WHOLE_TEXT), F.trim(text).try_cast("decimal(38,0)"))


def _with_sign(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``__sign``: order of the two ends (-1, 0, 1), each text parsed once per row.

    Two ends that are numbers compare by value (``1`` is ``1.0``), all others as text.  Whole
    numbers compare exactly; only if one of the two has a fraction or exponent are they doubles.
    Two whole numbers that no decimal holds compare as text if their doubles are equal.
    """
    types = dict(df.dtypes)
    if {types[a], types[b]} <= WHOLE_TYPES or {types[a], types[b]} <= FRACTION_TYPES:
        return df.withColumn("__sign", _sign(F.col(a), F.col(b)))
    parsed = df.withColumns({"__x": as_number(F.col(a)), "__y": as_number(F.col(b)), "__i": as_whole(F.col(a)), "__j": as_whole(F.col(b))})
    whole = F.col("__i").isNotNull() & F.col("__j").isNotNull()
    numeric = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    too_long = F.col(a).cast("string").rlike(WHOLE_TEXT) & F.col(b).cast("string").rlike(WHOLE_TEXT)
    by_text = _sign(F.col(a).cast("string"), F.col(b).cast("string"))
    by_double = _sign(F.col("__x"), F.col("__y"))
    sign = F.when(whole, _sign(F.col("__i"), F.col("__j"))).when(numeric & ~(too_long & (F.col("__x") == F.col("__y"))), by_double)
    return parsed.withColumn("__sign", sign.otherwise(by_text)).drop("__x", "__y", "__i", "__j")


def _sign(x: Column, y: Column) -> Column:
    """Order of two values; a null end is neither less nor more."""
    return F.when(x > y, 1).when(x < y, -1).otherwise(0)


def _swapped(df: DataFrame, a: str, b: str) -> DataFrame:
    swap = F.col("__sign") > 0
    return df.withColumns(
        {a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))}
    ).drop("__sign")


def parsed_id(col: Column, kind: str) -> Column:
    """An id of type ``kind`` with all that :func:`canonical` reads from it, for ends that stand in many pairs."""
    if kind in WHOLE_TYPES | FRACTION_TYPES:
        return F.struct(col.alias("id"))
    text = col.cast("string")
    return F.struct(col.alias("id"), text.alias("text"), as_number(col).alias("x"), as_whole(col).alias("i"), text.rlike(WHOLE_TEXT).alias("whole"))


def canonical_parsed(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """:func:`canonical` for two ends from :func:`parsed_id`, which become plain ids; no text is parsed."""
    p, q = F.col(a), F.col(b)
    if kind in WHOLE_TYPES | FRACTION_TYPES:
        sign = _sign(p["id"], q["id"])
    else:
        numeric = p["x"].isNotNull() & q["x"].isNotNull()
        too_long = p["whole"] & q["whole"] & (p["x"] == q["x"])
        sign = F.when(p["i"].isNotNull() & q["i"].isNotNull(), _sign(p["i"], q["i"])).when(numeric & ~too_long, _sign(p["x"], q["x"]))
        sign = sign.otherwise(_sign(p["text"], q["text"]))
    return _swapped(df.withColumns({"__sign": sign, a: p["id"], b: q["id"]}), a, b)


def canonical(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Swap the two endpoint columns wherever they are out of order."""
    return _swapped(_with_sign(df, a, b), a, b)


def distinct_ends(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Rows whose two ends are not the same id."""
    return _with_sign(df, a, b).filter("__sign <> 0").drop("__sign")


def out_of_order(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``df`` with ``swapped``: whether :func:`canonical` does not tell the row's order, as for different texts of one value."""
    equal = (F.col("__sign") == 0) & (F.col(a) != F.col(b))
    return _with_sign(df, a, b).withColumn("swapped", (F.col("__sign") > 0) | equal).drop("__sign")


def canonical_distinct(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Both rules in one pass over the ends."""
    return _swapped(_with_sign(df, a, b).filter("__sign <> 0"), a, b)


def pair_key(a: Column, b: Column) -> Column:
    """Unordered text key ``a|b``."""
    left, right = F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))
    return F.concat_ws("|", F.least(left, right), F.greatest(left, right))


def id_order(col: str) -> list[Column]:
    """Sort keys of the id order: numbers by value first (whole ones exactly), then text."""
    number = as_number(F.col(col))
    return [number.asc_nulls_last(), as_whole(F.col(col)).asc_nulls_last(), F.col(col).cast("string").asc()]


#: Longest id of digits that :func:`packed` takes: 11 to this power fits into 63 bits.
PACKED_DIGITS = 18
_DIGITS, _PLACES = "0123456789", "123456789A"


def packable(*cols: str) -> Column:
    """Whether the ids are texts of a few digits and nothing else."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).rlike(f"^[0-9]{{1,{PACKED_DIGITS}}}\\z")
    return F.coalesce(out, F.lit(False))


def packed(col: Column, places: int) -> Column:
    """A number for a text of at most ``places`` digits, in the order of the texts: places to the base of 11, one beyond the end is 0."""
    return F.conv(F.rpad(F.translate(col, _DIGITS, _PLACES), places, "0"), 11, 10).cast("bigint")


def unpacked(col: Column) -> Column:
    """The text that :func:`packed` has made the number of."""
    return F.translate(F.rtrim(F.conv(col.cast("string"), 10, 11), F.lit("0")), _PLACES, _DIGITS)


def mirror(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, in one pass over the input."""
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(ends).alias("__ends"), *rest).select("__ends.src", "__ends.dst", *rest)


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Distinct pairs of edges that are already canonical (see ``canonical``)."""
    return edges.select("src", "dst").distinct()
