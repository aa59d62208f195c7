"""Secrets in texts: fixed patterns, and sliding-window entropy per character class.

Everything is a DataFrame expression on one row.  Candidate strings are runs of key-like characters
with a digit in them; a window of ``WINDOW`` characters slides over each, its character counts and its
sum of ``n log2 n`` change by the one character that enters and the one that leaves, and where the
entropy of a window that lies wholly within a class reaches the class's threshold, the window is part
of a span.  Every class looks at every candidate, the hexadecimal one at any mix of cases.  Windows that
touch a match of the allow list, that lie inside a fixed-pattern span, or, in the wider class, inside a
hexadecimal span, do not count.

Null and empty texts have no spans, null and repeated ids are kept as rows, other columns are ignored.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_column
from .spans import match_spans

# The patterns and lengths of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run is taken whole or, if it has under 16 characters, not at all
HEX = r"[0-9a-f]{32,}"  # likewise, 32 characters

WINDOW = 20
#: Class, its characters, and the entropy in bits from which a window counts.
CLASSES = (
    ("hex_entropy", "0123456789abcdef", 3.0),
    ("base64_entropy", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
#: Runs of candidate characters, with a digit; the look-behind keeps the search linear in long runs.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
#: Places in candidates that are no secrets: UUIDs, paths of words with a row of digits each at most, alphabets and digit rows.
ALLOWED = (
    r"(?<![^/])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![^/])",
    r"^/?(?:[a-z]++/)++[a-z]*+(?:[0-9]++[a-z]*+)?(?:[_-]++[a-z]*+(?:[0-9]++[a-z]*+)?)*+$",
    r"(?i)abcdefghij|0123456789|qwertyuiop|example|placeholder",
    r"^[0-9/_=+-]+$",
)
SPAN = "array<struct<s:int,k:int,e:int>>"


def _spread(n: Column) -> Column:
    """``n log2 n``, 0 at 0."""
    return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def entropy_spans(candidate: Column, alphabet: str, threshold: float, window: int = WINDOW, counts=lambda s, e: F.lit(True)) -> Column:
    """Merged windows ``array<struct<s,e>>`` of one string whose characters are all in ``alphabet`` and spread enough, where ``counts(s, e)``."""
    size, most = len(alphabet), log2(window)
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("n"), F.lit(0).alias("inside"), F.lit(0.0).cast("double").alias("sum"), none.alias("out")
    )

    def slide(places: Column) -> Column:
        """The windows over the characters' places in the alphabet (from 1; 0: none), each looked up by its index."""
        place = lambda i: F.coalesce(F.get(places, i), F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            def move(x: Column) -> Column:
                came, went = x["came"], x["went"]
                n = acc["n"]
                before = F.coalesce(F.get(n, went - 1), F.lit(0))
                after = F.coalesce(F.get(n, came - 1), F.lit(0)) - (came == went).cast("int")
                out = F.when(went > 0, _spread(before - 1) - _spread(before)).otherwise(F.lit(0.0))
                inn = F.when(came > 0, _spread(after + 1) - _spread(after)).otherwise(F.lit(0.0))
                total = acc["sum"] + out + inn
                inside = acc["inside"] + (came > 0).cast("int") - (went > 0).cast("int")
                s, e = i - (window - 1), i + 1
                hit = (inside == window) & (F.lit(most) - total / window >= threshold - 1e-12) & counts(s, e)
                spans = acc["out"]
                last = F.element_at(spans, -1)
                joined = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["s"].alias("s"), e.alias("e"))))
                added = F.concat(spans, F.array(F.struct(s.alias("s"), e.alias("e"))))
                touches = (F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["e"] >= s)
                moved = F.transform(n, lambda v, j: v + (j + 1 == came).cast("int") - (j + 1 == went).cast("int"))
                return F.struct(
                    F.when(came == went, n).otherwise(moved).alias("n"), inside.alias("inside"), total.alias("sum"),
                    F.when(hit & touches, joined).when(hit, added).otherwise(spans).alias("out"),
                )

            return let(F.struct(place(i).alias("came"), F.when(i >= window, place(i - window)).otherwise(F.lit(0)).alias("went")), move)

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda acc: acc["out"])

    # one pass over the string: a character by its index in a string would be looked for from the start each time
    return let(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c)), slide)


def added_spans(body: Column, base: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Entropy spans of a text with the spans ``base`` as ``SPAN``."""
    places = "array<struct<s:int,e:int>>"

    def of_class(x: Column, k: int, benign: Column, known: Column) -> Column:
        kind, alphabet, threshold = CLASSES[k]
        clear = lambda s, e: ~F.exists(benign, lambda b: (b["s"] < e) & (s < b["e"])) & ~F.exists(known, lambda b: (b["s"] <= s) & (e <= b["e"]))
        own = entropy_spans(F.lower(x["m"]) if kind == "hex_entropy" else x["m"], alphabet, threshold, counts=clear)
        return F.transform(own, lambda y: F.struct(y["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), y["e"].alias("e"))).cast(SPAN)

    def of_candidate(x: Column) -> Column:
        near = F.filter(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        known = F.transform(near, lambda b: F.struct((b["s"] - x["s"]).alias("s"), (b["e"] - x["s"]).alias("e"))).cast(places)
        pattern = "|".join(f"(?:{a})" for a in allowed)
        skip = F.transform(match_spans(x["m"], pattern), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"))) if allowed else F.array()

        def of_classes(c: Column) -> Column:
            # a window of hexadecimal digits is also one of the wider class
            def wider(first: Column) -> Column:
                inner = F.transform(first, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"))).cast(places)
                return F.concat(first, of_class(x, 1, c["skip"], F.concat(c["known"], inner)))

            return let(of_class(x, 0, c["skip"], c["known"]), wider)

        found = let(F.struct(skip.cast(places).alias("skip"), known.alias("known")), of_classes)
        return F.transform(found, lambda y: F.struct((x["s"] + y["s"]).alias("s"), y["k"].alias("k"), (x["s"] + y["e"]).alias("e")))

    return F.flatten(F.transform(match_spans(body, CANDIDATE, "[0-9]"), of_candidate)).cast(SPAN)


def base_spans(body: Column) -> Column:
    mark = lambda spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    long_enough = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_MIN
    assign = mark(F.filter(match_spans(body, ASSIGN, "[:=]"), long_enough), 0)
    return F.sort_array(F.concat(assign, mark(match_spans(body, ACCESS, "AKIA"), 1), mark(match_spans(body, HEX), 2)))


def _written(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans (struct s, k, e; k is a place in ``KINDS``)."""
    body = docs.select("doc_id", text_column(text).alias("__body"))
    both = lambda base: F.struct(base.alias("base"), added_spans(F.col("__body"), base, allowed).alias("more"))
    told = body.select("doc_id", let(base_spans(F.col("__body")), both).alias("__s"))
    return told.select("doc_id", F.col("__s.base").alias("base"), F.col("__s.more").alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind and the spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
