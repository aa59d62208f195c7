"""Places of regular-expression matches as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_spans(text: Column, pattern: str, gate: str | None = None) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<s int, e int, m string>>`` in code points, end exclusive.

    The text is split at the matches, so the places are running sums of the lengths of the pieces
    between them and of the matches.  ``text`` is only split if it has a match at all; ``gate`` is a
    cheaper pattern that every text with a match has.
    """
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def place(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["gap"])
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        pairs = F.transform(c["hits"], lambda m, i: F.struct(c["gaps"][i].alias("gap"), m.alias("m")))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    found = F.element_at(F.transform(F.array(cut), place), 1)
    return F.when(_has(text, pattern, gate), found).otherwise(none)


def replace_matches(text: Column, pattern: str, swap, gate: str | None = None) -> Column:
    """``text`` with every match ``m`` replaced by ``swap(m)``."""
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def weave(c: Column) -> Column:
        done = F.struct(c["gaps"].alias("gaps"), F.transform(c["hits"], swap).alias("hits"))
        put = lambda d: F.array_join(F.transform(d["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(d["hits"], i), F.lit("")))), "")
        return F.element_at(F.transform(F.array(done), put), 1)

    found = F.element_at(F.transform(F.array(cut), weave), 1)
    return F.when(_has(text, pattern, gate), found).otherwise(text)


def _has(text: Column, pattern: str, gate: str | None) -> Column:
    return text.rlike(pattern) if gate is None else text.rlike(gate) & text.rlike(pattern)
