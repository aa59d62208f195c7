"""Awkward document rows that every operator must take: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string, h double"
LONG = " ".join(f"w{i % 977} x{i % 13}," for i in range(9000))
TEXTS = [
    None, "", " \t\n", "one", "two words", LONG, "a b c d e f g h " * 40,
    "Same text here, word for word, twice over and then some more of it.\nAgain\n\nAgain\nagain #$% <b>|x|</b>",
]


def awkward(spark, more=()):
    rows = [(i, t, "en", "s", None, "x", float(i)) for i, t in enumerate(TEXTS)]
    rows += [(len(TEXTS) - 1, TEXTS[-1], None, None, 3, None, None), (90, TEXTS[-1], "de", "s", 1, "y", None), (None, "no id at all " * 9, None, None, None, None, None)]
    rows += [(100 + i, t, "en", "s", len(t or ""), None, None) for i, t in enumerate(more)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
