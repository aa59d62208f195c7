"""Quality filter learned as an ordered list of threshold rules, applied as one Spark expression.

Statistics of whole texts are DataFrame expressions, one pass and no shuffle.  Rules come from a
bounded sample of labelled rows: sequential covering grows a conjunction of thresholds by FOIL gain on
two thirds of the sample, cuts its tail back on the other third, keeps it if it is precise enough, takes
its rows out and goes on.  Every step is one grouped count over the stored sample; only counts per
feature and bin come to the driver.

Null texts have no words; null ids are kept; rows are judged one by one, so repeated rows get the same
verdict; without labels of both kinds there are no rules and only the fixed limits hold; columns other
than those named do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from .common import let, text_column

WS = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features that rules may use, from the counts; each is a number for every text.
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "line_words", "variety")
MAX_ROWS, BINS, MAX_RULES, MAX_TERMS, PRECISION = 6000, 24, 8, 4, 0.97


def _kept_chars(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three that stands twice or more; ``words`` must be computed already."""
    n = F.size(words)
    at = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), at)).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.transform(F.filter(s, same), lambda x: x["i"])

        spread = lambda r: F.size(F.array_distinct(F.concat(r, F.transform(r, lambda i: i + 1), F.transform(r, lambda i: i + 2))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, twice), spread))

    return let(windows, covered).cast("long")


def statistics(text: str = "text") -> Column:
    """Struct of the counts and features of one text."""
    body = text_column(text)
    trimmed = F.btrim(body, F.lit(BLANKS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{WS}]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).alias("kinds"), _repeat_words(w).alias("rep")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    parts = F.struct(
        by_words.alias("w"), by_lines.alias("l"), _kept_chars(body, f"[{WS}]+").alias("chars"),
        _kept_chars(body, "[^#*$%&|<>]+").alias("symbols"), _kept_chars(body, "\\P{Lu}+").alias("upper"),
        _kept_chars(body, "[^!?;:]+").alias("marks"), _kept_chars(body, "[^0-9]+").alias("digits"),
    )

    def shape(p: Column) -> Column:
        share = lambda a, b: a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))
        return F.struct(
            p["w"]["n"].alias("n_words"), p["chars"].alias("word_chars"), p["symbols"].alias("n_symbols"),
            p["l"]["dup"].alias("n_dup_lines"), p["w"]["rep"].alias("n_repeat_words"),
            share(p["chars"], p["w"]["n"]).alias("mean_word"), share(p["symbols"], p["chars"]).alias("symbols"),
            share(p["l"]["dup"], p["l"]["n"]).alias("dup_lines"), share(p["w"]["rep"], p["w"]["n"]).alias("repeats"),
            share(p["upper"], p["chars"]).alias("upper"), share(p["marks"], p["w"]["n"]).alias("marks"),
            share(p["digits"], p["chars"]).alias("digits"), share(p["w"]["n"], p["l"]["n"]).alias("line_words"),
            share(p["w"]["kinds"], p["w"]["n"]).alias("variety"),
        )

    return let(parts, shape)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def holds(self, s: Column) -> Column:
        return s[self.feature] > self.threshold if self.above else s[self.feature] <= self.threshold


Rule = tuple[Term, ...]


def rule_holds(rule: Rule, s: Column) -> Column:
    found = F.lit(True)
    for term in rule:
        found = found & term.holds(s)
    return found


def verdict(rules: list[Rule], s: Column) -> Column:
    """Number (from 1) of the first rule that rejects the text, null if none does."""
    found = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        found = found.when(rule_holds(rule, s), F.lit(i))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text") -> DataFrame:
    """``bad, prune, s`` of at most ``max_rows`` labelled ids, taken by hash; ids with both labels are left out."""
    one = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    picked = one.where("lo = hi").orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select("__id", (F.col("lo") == 0).alias("bad"))
    rows = docs.select(F.col("doc_id").alias("__id"), text_column(text).alias("text")).join(F.broadcast(picked), "__id")  # max_rows ids at most
    return rows.select("bad", (F.pmod(F.xxhash64("__id", F.lit("prune")), F.lit(3)) == 0).alias("prune"), statistics().alias("s"))


def learn_rules(sample: DataFrame, max_rules: int = MAX_RULES, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules that reject, from the rows that the fixed limits let pass."""
    # stored before the filter, which would otherwise be worked out for every document below the join
    rows = cut(sample, "labelled").where(~base_failed(F.col("s")))
    grow = rows.where("not prune")
    steps = [i / BINS for i in range(1, BINS)]
    edges = grow.select(*[F.percentile_approx(F.col(f"s.{f}").cast("double"), steps, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(edges[f] or [])) for f in FEATURES}
    places = F.array(*[sum((F.when(F.col(f"s.{f}") > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in FEATURES])
    rows = cut(rows.withColumn("places", places), "binned")
    rules: list[Rule] = []
    s, bad, good = F.col("s"), F.sum(F.col("bad").cast("int")), F.sum((~F.col("bad")).cast("int"))
    while len(rules) < max_rules:
        left = rows.where(verdict(rules, s).isNull())
        terms: list[Term] = []
        while len(terms) < MAX_TERMS:
            counted = left.where(~F.col("prune") & rule_holds(tuple(terms), s)).select("bad", F.posexplode("places").alias("f", "bin"))
            by = {(r["f"], r["bin"]): (r["p"], r["n"]) for r in counted.groupBy("f", "bin").agg(bad.alias("p"), good.alias("n")).collect()}
            all_p, all_n = (sum(v[k] for (f, _), v in by.items() if f == 0) for k in (0, 1))
            if not all_p or not all_n:
                break
            best = _best_term(by, cuts, all_p, all_n)
            if best is None:
                break
            terms.append(best)
        if not terms:
            break
        tails = [tuple(terms[:k]) for k in range(1, len(terms) + 1)]
        sums = [F.sum((rule_holds(t, s) & (F.col("bad") == b) & (F.col("prune") == c)).cast("int")).alias(f"{name}{k}") for k, t in enumerate(tails) for name, b, c in (("p", True, True), ("n", False, True), ("gp", True, False), ("gn", False, False))]
        seen = left.agg(*sums).first().asDict()
        value = lambda k: ((seen[f"p{k}"] or 0) + 1) / ((seen[f"p{k}"] or 0) + (seen[f"n{k}"] or 0) + 2)
        k = max(range(len(tails)), key=lambda k: (value(k), -k))
        hit, miss = ((seen[f"{a}{k}"] or 0) + (seen[f"g{a}{k}"] or 0) for a in ("p", "n"))
        if hit < 2 or hit < precision * (hit + miss):
            break
        rules.append(tails[k])
    return rules


def _best_term(by: dict, cuts: dict[str, list[float]], all_p: int, all_n: int) -> Term | None:
    """Threshold with the largest FOIL gain over rows with ``all_p`` bad and ``all_n`` good ones."""
    before, best, gain = log2(all_p / (all_p + all_n)), None, 1e-9
    for i, f in enumerate(FEATURES):
        p = n = 0
        for place, threshold in enumerate(cuts[f]):  # bin k holds values above k thresholds
            got = by.get((i, place), (0, 0))
            p, n = p + got[0], n + got[1]
            for above, a, b in ((False, p, n), (True, all_p - p, all_n - n)):
                if a and (own := a * (log2(a / (a + b)) - before)) > gain:
                    best, gain = Term(f, above, threshold), own
    return best


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the number of the rejecting ``rule``."""
    s = F.col("__s")
    rule = verdict(rules, s)
    return docs.select("doc_id", statistics(text).alias("__s")).select(
        "doc_id", *[s[c].alias(c) for c in COUNTS], base_failed(s).alias("base_failed"),
        (~base_failed(s) & rule.isNull()).alias("kept"), rule.cast("int").alias("rule"),
    )


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept, all columns as they were."""
    return docs.where(let(statistics(text), lambda s: ~base_failed(s) & verdict(rules, s).isNull()))
